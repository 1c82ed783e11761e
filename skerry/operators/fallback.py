"""Questions that the index can't answer: detection, choice of a page to fetch, and its ingestion."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.operators.search import build_index, search
from skerry.session import cut


def needs_fallback(queries: DataFrame, hits: DataFrame, least: float) -> DataFrame:
    """query_id, best (0 without hits), needs_fallback of every query."""
    best = hits.groupBy("query_id").agg(F.max("score").alias("__best"))
    rows = queries.select("query_id").join(best, "query_id", "left")
    return rows.select("query_id", F.coalesce("__best", F.lit(0.0)).alias("best"), (F.col("__best").isNull() | (F.col("__best") < least)).alias("needs_fallback"))


def search_scores(results: DataFrame, limit: int) -> DataFrame:
    """``results`` (query_id, wiki, titles) as wiki, title, score rows: ``limit`` less the place, blank titles left out but counted."""
    rows = results.select("query_id", "wiki", F.posexplode("titles").alias("__i", "title"))
    return rows.select("query_id", "wiki", "title", (F.lit(limit) - F.col("__i")).cast("bigint").alias("score")).filter("title is not null and trim(title) <> ''")


def title_match(query: Column, title: Column) -> Column:
    """The share of the query's words of at least two characters that the title has, brackets read as spaces."""
    asked = F.filter(F.array_distinct(F.split(F.lower(query), r"\s+")), lambda w: F.length(w) > 1)
    named = F.split(F.translate(F.lower(title), "()", "  "), r"\s+")
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, named)) / F.size(asked)).otherwise(0.0)


def title_candidates(questions: DataFrame, pages: DataFrame, key: str, limit: int = 20) -> DataFrame:
    """query_id, query, wiki, title, score: pages whose titles fit the questions (query_id, query) best.

    Titles are searched lexically, by blocks of questions, so words that every title has join
    nothing; of the ``limit`` best, each wiki's first scores ``limit``, its next one less.
    """
    none = F.lit(None).cast("array<float>")
    asked = questions.select("query_id", F.col("query").alias("text"), none.alias("vector"))
    index = build_index(pages, key, "wiki", "title", None)
    hits = search(asked, replace(index, blocks=cut(index.blocks)), limit, per_doc=0, lexical_only=True)
    place = F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("rank"))
    rows = hits.select("query_id", F.col("chunk_ord").alias(key), (F.lit(limit + 1) - place).cast("bigint").alias("score"))
    return rows.join(pages.select(key, "wiki", "title"), key).join(questions, "query_id").select("query_id", "query", "wiki", "title", "score")


def best_candidates(candidates: DataFrame, order: str = "wiki") -> DataFrame:
    """query_id, wiki, title, score, match of each query's best candidate: by score, then title match, then the lower ``order`` and title.

    ``candidates`` has query_id, query, wiki, title, score.
    """
    rows = candidates.withColumn("match", title_match(F.col("query"), F.col("title")))
    top = rows.groupBy("query_id").agg(F.max(F.struct("score", "match")).alias("__top"))
    tied = rows.join(top, "query_id").filter(F.struct("score", "match") == F.col("__top"))
    least = tied.groupBy("query_id").agg(F.min(F.struct(F.col(order).alias("__o"), "title", "wiki", "score", "match")).alias("__b"))
    return least.select("query_id", F.col("__b.wiki").alias("wiki"), F.col("__b.title").alias("title"), F.col("__b.score").alias("score"), F.col("__b.match").alias("match"))


def not_indexed(new: DataFrame, index: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``new`` whose document the index lacks; the index side is one column, made distinct first."""
    return new.join(index.select(key).distinct(), key, "left_anti")
