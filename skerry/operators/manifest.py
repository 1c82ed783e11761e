"""The manifest of scraped pages: keyed upsert, deterministic whatever order rows arrive in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ("title", "ok", "path", "url", "chars", "error", "scraped_at", "arrived_at")


def latest(pages: DataFrame, order: tuple[str, ...] = ("scraped_at", "arrived_at")) -> DataFrame:
    """One row per (wiki, slug): the last by ``order``; of rows alike in that, one that is ok, then the greater title, url and error.

    A grouped maximum of a struct, which is combined on the map side, so a key with many rows costs no window.
    """
    rest = [x for x in FIELDS if x not in order and x in pages.columns]
    first = ["ok", *(x for x in rest if x != "ok")]
    picked = F.max(F.struct(*order, *first)).alias("__p")
    rows = pages.filter("wiki is not null and slug is not null").groupBy("wiki", "slug").agg(picked)
    return rows.select("wiki", "slug", *[F.col(f"__p.{x}").alias(x) for x in FIELDS if x in pages.columns])


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same key, whatever their times."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return latest(both, ("__new", "scraped_at", "arrived_at"))


def summary(pages: DataFrame) -> DataFrame:
    """wiki, n_ok, n_failed, n_chars of each wiki."""
    return pages.groupBy("wiki").agg(F.count_if("ok").alias("n_ok"), F.count_if(~F.coalesce("ok", F.lit(False))).alias("n_failed"), F.coalesce(F.sum("chars"), F.lit(0)).alias("n_chars"))
