"""Fetched pages to corpus documents and manifest rows; a page that fails is a row, not an error."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.functions.text import page_doc_id, slugify
from skerry.operators.html import html_to_markdown

UNIVERSES = {"marvel": "Marvel"}


def page_jobs(pages: DataFrame, only_wiki: str | None = None, extra: DataFrame | None = None) -> DataFrame:
    """wiki, title, slug of the pages to fetch: those of one wiki if it is named, and the extra ones; each once."""
    rows = pages.select("wiki", "title")
    rows = rows.filter(F.col("wiki") == only_wiki) if only_wiki else rows
    rows = rows.unionByName(extra.select("wiki", "title")) if extra is not None else rows
    return rows.filter("wiki is not null and trim(title) <> ''").distinct().withColumn("slug", slugify(F.col("title")))


def documents_of(pages: DataFrame, scraped: str, most: int = 60_000, least: int = 500) -> tuple[DataFrame, DataFrame]:
    """(documents, results) of fetched pages: wiki, title, url, html, ok, error.

    ``documents`` has doc_id, wiki, title, universe, source, scraped, body of pages with at
    least ``least`` characters; ``results`` has a manifest row for every page. A page that
    was fetched twice is one document.
    """
    named = pages.withColumn("doc_id", page_doc_id(F.col("wiki"), F.col("title"))).dropDuplicates(["doc_id"])
    text = html_to_markdown(named, "doc_id", most=most).select("doc_id", "markdown")
    rows = named.join(text, "doc_id").withColumn("__n", F.length("markdown"))
    good = F.coalesce("ok", F.lit(False)) & (F.col("__n") >= least)
    universe = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in UNIVERSES.items() for x in pair]), F.col("wiki")), F.lit("DC"))
    documents = rows.filter(good).select(
        "doc_id", "wiki", "title", universe.alias("universe"), F.coalesce("url", F.lit("")).alias("source"), F.lit(scraped).alias("scraped"), F.col("markdown").alias("body")
    )
    short = F.concat(F.lit("page too short ("), F.col("__n").cast("string"), F.lit(" characters)"))
    error = F.when(good, "").when(F.coalesce("ok", F.lit(False)), short).otherwise(F.coalesce("error", F.lit("not fetched")))
    results = rows.select(
        "wiki", "title", slugify(F.col("title")).alias("slug"), good.alias("ok"), F.when(good, F.concat(F.lit("pages/"), F.col("doc_id"))).otherwise("").alias("path"),
        F.coalesce("url", F.lit("")).alias("url"), F.when(good, F.col("__n")).otherwise(0).cast("bigint").alias("chars"), error.alias("error"),
    )
    return documents, results
