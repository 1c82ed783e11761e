"""Prompts within a budget of characters, and the list of their sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def budgeted(hits: DataFrame, budget: int, text: str = "text") -> DataFrame:
    """``hits`` that still find room, in the order of their ranks, with passage; the last one is cut."""
    before = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    body = F.coalesce(F.col(text), F.lit(""))
    used = F.coalesce(F.sum(F.length(body)).over(before), F.lit(0))
    rows = hits.withColumn("__used", used).filter((F.col("__used") < budget) | (F.col("rank") == 1))
    return rows.withColumn("passage", F.left(body, (F.lit(budget) - F.col("__used")).cast("int"))).drop("__used")


def prompts(hits: DataFrame, queries: DataFrame, budget: int = 12_000, question: str = "question") -> DataFrame:
    """query_id, n_passages, context and prompt of every query; ``hits`` has rank, doc_id, title and text."""
    kept = budgeted(hits, budget)
    part = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] (from: "), F.coalesce("title", "doc_id", F.lit("")), F.lit(")\n"), F.col("passage"))
    listed = kept.select("query_id", F.struct("rank", part.alias("part")).alias("p")).groupBy("query_id").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    context = F.array_join(F.transform(F.coalesce("ps", F.expr("cast(array() as array<struct<rank:bigint,part:string>>)")), lambda p: p["part"]), "\n\n---\n\n")
    rows = queries.join(listed, "query_id", "left").select("query_id", F.col(question).alias("__q"), F.coalesce(F.size("ps"), F.lit(0)).cast("bigint").alias("__n"), context.alias("context"))
    prompt = F.concat(F.lit("Context passages:\n\n"), F.col("context"), F.lit("\n\nQuestion: "), F.coalesce("__q", F.lit("")))
    return rows.select("query_id", F.greatest("__n", F.lit(0)).alias("n_passages"), "context", prompt.alias("prompt"))


#: What the model is told to do with the passages.
SYSTEM = (
    "You answer questions about the characters and events of comic-book universes. Use the numbered passages below and nothing "
    "else that you may know. Keep it to a few sentences that answer the question, and put the number of each passage you rely on "
    'in square brackets after the statement, like [2]. If the passages don\'t hold the answer, don\'t guess: write only "I don\'t '
    'know: that information is not in my knowledge base."'
)


def whole_context(hits: DataFrame, text: str = "text") -> DataFrame:
    """query_id and context: the texts of all hits of a query in the order of their ranks, whatever their length."""
    listed = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.coalesce(F.col(text), F.lit("")).alias("t")))).alias("ts"))
    return listed.select("query_id", F.array_join(F.transform("ts", lambda x: x["t"]), "\n\n").alias("context"))


def sources(hits: DataFrame) -> DataFrame:
    """query_id, rank, doc, title, section, score (4 digits) and url of all hits, also of those cut from the prompt."""
    blank = F.lit("")
    return hits.select(
        "query_id", "rank", F.col("doc_id").alias("doc"), F.coalesce("title", blank).alias("title"), F.coalesce("section", blank).alias("section"),
        F.round("score", 4).alias("score"), F.coalesce("url", blank).alias("url"),
    )
