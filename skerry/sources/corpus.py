"""Corpus files, evaluation sets, manifests and reports: reading and writing."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.functions.text import front_matter, page_doc_id, resolved_title
from skerry.operators.evaluate import MEASURES
from skerry.operators.manifest import upsert
from skerry.schemas import EVAL_ITEM, PAGE
from skerry.session import cut


def load_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id (the file's name), title, body, meta of the ``.md`` and ``.txt`` files of a folder, not of its subfolders,
    and of the pages that ``write_corpus`` put there; of two with one name the file's."""
    parts = []
    for glob in ("*.md", "*.txt"):
        files = spark.read.option("pathGlobFilter", glob).text(folder, wholetext=True).select("value", F.col("_metadata.file_name").alias("name"))
        parts.append(files)
    rows = parts[0].unionByName(parts[1]).select("value", F.url_decode("name").alias("name"))
    if exists(spark, f"{folder}/pages"):
        pages = spark.read.parquet(f"{folder}/pages").select(F.col("content").alias("value"), F.col("doc_id").alias("name"))
        rows = rows.unionByName(pages.dropDuplicates(["name"]).join(rows.select("name"), "name", "left_anti"))
    meta, body = front_matter(F.col("value"))
    docs = rows.select(F.col("name").alias("doc_id"), meta.alias("meta"), body.alias("body"))
    return docs.select("doc_id", resolved_title(F.col("meta"), F.col("body"), F.col("doc_id")).alias("title"), "body", "meta")


def corpus_page(docs: DataFrame) -> DataFrame:
    """doc_id and content of the files to write for wiki, title, universe, source, scraped, body."""
    head = F.concat_ws("\n", F.lit("---"), *[F.concat(F.lit(f"{x}: "), F.coalesce(x, F.lit(""))) for x in ("title", "universe", "source", "scraped")], F.lit("---"))
    text = F.concat(head, F.lit("\n\n# "), F.coalesce("title", F.lit("")), F.lit("\n\n"), F.col("body"), F.lit("\n"))
    return docs.select(page_doc_id(F.col("wiki"), F.col("title")).alias("doc_id"), text.alias("content"))


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def write_corpus(pages: DataFrame, folder: str) -> None:
    """Add pages (doc_id, content), one row each, to a Parquet table in the corpus folder; a hundred million tiny files would serve no one."""
    pages.select("doc_id", "content").write.mode("append").parquet(f"{folder}/pages")


def update_manifest(spark: SparkSession, folder: str, results: DataFrame) -> DataFrame:
    """The manifest of the corpus folder with ``results`` in place of rows with the same wiki and slug; it is written anew."""
    path = f"{folder}/manifest"
    names = ["wiki", "slug", "title", "ok", "path", "url", "chars", "error", "scraped_at", "arrived_at"]
    now = F.current_timestamp().cast("timestamp_ntz")
    new = results.withColumn("scraped_at", now).withColumn("arrived_at", now).select(*names)
    old = spark.read.parquet(path) if exists(spark, path) else new.limit(0)
    merged = cut(upsert(old, new).select(*names))
    merged.write.mode("overwrite").parquet(path)
    return merged


def load_eval_set(spark: SparkSession, path: str) -> DataFrame:
    """The questions of a JSON evaluation set in file order (pos), with defaults for what is missing."""
    rows = spark.read.schema(f"questions array<{EVAL_ITEM.simpleString()}>").json(path, multiLine=True)
    rows = rows.select(F.posexplode("questions").alias("pos", "q"))
    none = F.expr("cast(array() as array<string>)")
    return rows.select(
        "pos", F.coalesce("q.id", F.concat(F.lit("q"), (F.col("pos") + 1).cast("string"))).alias("id"), F.coalesce("q.category", F.lit("uncategorized")).alias("category"),
        F.coalesce("q.question", F.lit("")).alias("question"), F.coalesce("q.relevant_docs", none).alias("relevant_docs"),
        F.coalesce("q.reference_answer", F.lit("")).alias("reference_answer"), F.coalesce("q.answerable", F.lit(True)).alias("answerable"),
    )


def chosen_questions(questions: DataFrame, category: str | None = None, limit: int | None = None) -> DataFrame:
    """Of one category, then the first ``limit`` in file order; None or 0 is no limit. No question left is an error."""
    rows = questions if category is None else questions.filter(F.col("category") == category)
    rows = rows.orderBy("pos").limit(limit) if limit else rows
    if rows.isEmpty():
        raise ValueError("no question is left to evaluate")
    return rows


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The pages of a manifest; a malformed one counts as empty."""
    rows = spark.read.schema(f"pages array<{PAGE.simpleString()}>").json(path, multiLine=True, mode="PERMISSIVE")
    return rows.filter("pages is not null").select(F.inline("pages"))


def write_report(report: DataFrame, results: DataFrame, config: dict[str, object], path: str) -> None:
    """An evaluation as JSON: ``summary`` is one row of config, run_at, overall and by_category, ``questions`` a row per question."""
    spark = report.sparkSession
    measures = [c for c in report.columns if c not in ("category", "overall")]
    scores = F.struct(*measures)
    rows = report.select("overall", F.coalesce("category", F.lit("uncategorized")).alias("c"), scores.alias("s"))
    one = rows.agg(F.max(F.when(F.col("overall"), F.col("s"))).alias("overall"), F.map_from_entries(F.collect_list(F.when(~F.col("overall"), F.struct("c", "s")))).alias("by_category"))
    told = F.from_json(F.lit(json.dumps(config)), spark.range(1).select(F.schema_of_json(F.lit(json.dumps(config)))).first()[0])
    one = one.select(told.alias("config"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("run_at"), "overall", "by_category")
    one.coalesce(1).write.mode("overwrite").json(f"{path}/summary", ignoreNullFields=False)
    named = ["category", "question", "answerable", "answer", "reference_answer", "relevant_docs", "retrieved_docs"]
    kept = [m for m in MEASURES if m in results.columns]
    results.select(F.col("query_id").alias("id"), *[c for c in named if c in results.columns], F.struct(*kept).alias("scores"), F.round("retrieval_seconds", 3).alias("retrieval_seconds"), F.round("total_seconds", 2).alias("total_seconds")).write.mode("overwrite").json(f"{path}/questions", ignoreNullFields=False)
