"""Inverted index as tables, and BM25 as a join of query terms with postings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.functions.text import search_tokens

K1, B = 1.5, 0.75


@dataclass(frozen=True)
class LexicalIndex:
    """postings(term, chunk, tf, dl), terms(term, df), stats(n_chunks, avgdl)."""

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame


def lengths(chunks: DataFrame, key: str = "chunk_ord", text: str = "text") -> DataFrame:
    """``key`` and dl: the number of terms of every chunk, 0 for a null or wordless one."""
    return chunks.select(key, F.size(search_tokens(F.coalesce(F.col(text), F.lit("")))).cast("bigint").alias("dl"))


def build(chunks: DataFrame, key: str = "chunk_ord", text: str = "text", only: DataFrame | None = None) -> LexicalIndex:
    """The index of a chunk table; ``only`` (term) keeps the postings of some terms, for one batch of queries."""
    tokens = chunks.select(F.col(key).alias("chunk"), search_tokens(F.coalesce(F.col(text), F.lit(""))).alias("tokens"))
    stats = tokens.agg(F.count("*").alias("n_chunks"), F.coalesce(F.avg(F.size("tokens")), F.lit(0.0)).alias("avgdl"))
    rows = tokens.select("chunk", F.size("tokens").cast("bigint").alias("dl"), F.explode("tokens").alias("term"))
    if only is not None:
        rows = rows.join(only.select("term").distinct(), "term", "left_semi")
    postings = rows.groupBy("term", "chunk", "dl").agg(F.count("*").alias("tf"))
    terms = postings.groupBy("term").agg(F.count("*").alias("df"))
    return LexicalIndex(postings, terms, stats)


def query_terms(queries: DataFrame, key: str = "query_id", text: str = "question") -> DataFrame:
    rows = queries.select(F.col(key).alias("query_id"), F.explode(search_tokens(F.col(text))).alias("term"))
    return rows.groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def bm25(index: LexicalIndex, queries: DataFrame, key: str = "query_id", text: str = "question") -> DataFrame:
    """query_id, chunk, score of every chunk that shares a term with the query; all others score 0."""
    wanted = query_terms(queries, key, text)
    weighted = wanted.join(index.terms, "term").crossJoin(F.broadcast(index.stats))  # stats is one row
    idf = F.log(1 + (F.col("n_chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = weighted.select("query_id", "term", (F.col("qtf") * idf * (K1 + 1)).alias("weight"), F.when(F.col("avgdl") > 0, F.col("avgdl")).otherwise(1.0).alias("avgdl"))
    part = F.col("weight") * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return index.postings.join(weighted, "term").groupBy("query_id", "chunk").agg(F.sum(part).alias("score"))
