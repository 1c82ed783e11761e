"""One ranking from several differently scaled scores (problem 4).

Ideal-point ranking per query. Scores are winsorised per query and scorer, moved to start
at zero, divided by the length of the scorer's vector, and weighted; an item's relative
closeness is its distance to the anti-ideal point over the sum of its distances to the
anti-ideal and the ideal point. A row holds one item with all its scores; what a query's
scorers have in common (bounds, lengths, ends) are grouped aggregates, combined on the map side,
so a query that holds a third of all rows is no single task's work.

A rank is the number of items in higher bands of closeness plus the place within the band;
no task ever sorts a whole large query.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.session import cut

BANDS = 1024


def items_of(hits: DataFrame, query: str = "query_id", item: str = "chunk_id", scorer: str = "scorer", score: str = "score") -> DataFrame:
    """__query, __item, __by: one row for each item of a query, with its real scores as (scorer, score), by scorer.

    Repeated rows count once (the highest real score stands, should they differ); NaN is no
    real score. Rows with a null query or item belong to no ranking and are left out.
    """
    real = F.when(~F.isnan(score), F.col(score))
    rows = hits.select(F.col(query).alias("__query"), F.col(item).alias("__item"), F.col(scorer).alias("scorer"), real.alias("score"))
    rows = rows.filter("__query is not null and __item is not null").groupBy("__query", "__item", "scorer").agg(F.max("score").alias("score"))
    held = F.when(F.col("scorer").isNotNull() & F.col("score").isNotNull(), F.struct("scorer", "score"))
    return rows.groupBy("__query", "__item").agg(F.array_sort(F.collect_list(held)).alias("__by"))


def _by_scorer(rows: DataFrame, *aggregates: Column) -> DataFrame:
    """__query and __of, a map from scorer to a struct of the aggregates of its s.score."""
    told = rows.select("__query", F.explode("__by").alias("s")).groupBy("__query", F.col("s.scorer").alias("__scorer")).agg(*aggregates)
    names = [c for c in told.columns if not c.startswith("__")]
    return told.groupBy("__query").agg(F.map_from_entries(F.collect_list(F.struct("__scorer", F.struct(*names)))).alias("__of"))


def closeness_of(items: DataFrame, weights: Mapping[str, float] | None = None, winsor: float = 0.05) -> DataFrame:
    """``items`` with closeness and __k, the number of scorers of the query."""
    bounds = _by_scorer(items, F.percentile_approx("s.score", F.lit(winsor), F.lit(10_000)).alias("low"), F.percentile_approx("s.score", F.lit(1 - winsor), F.lit(10_000)).alias("high"), F.count("*").alias("n"))
    span = "case when __of[x.scorer].high > __of[x.scorer].low then __of[x.scorer].high - __of[x.scorer].low else 1.0D end"
    clipped = "greatest(__of[x.scorer].low, least(__of[x.scorer].high, x.score))"
    moved = f"transform(__by, x -> struct(x.scorer as scorer, {clipped} - __of[x.scorer].low + 0.1D * {span} as score))"
    rows = items.join(bounds, "__query", "left").withColumn("__n", F.expr("transform_values(__of, (k, v) -> v.n)")).withColumn("__x", F.expr(moved))
    rows = cut(rows.drop("__of"))
    sides = _by_scorer(
        rows.select("__query", F.col("__x").alias("__by")),
        F.sqrt(F.sum(F.col("s.score") * F.col("s.score"))).alias("length"), F.max("s.score").alias("top"), F.min("s.score").alias("least"),
    )
    total = rows.groupBy("__query").agg(F.count("*").alias("__items"))
    weight = "1.0D" if not weights else "case k " + " ".join(f"when '{name}' then {float(value)!r}D" for name, value in weights.items()) + " else 1.0D end"
    # the anti-ideal is 0 where some item lacks the score, else the lowest value
    points = f"""transform_values(__of, (k, v) -> struct({weight} / v.length as unit, {weight} * v.top / v.length as ideal,
                 case when __n[k] < __items then 0.0D else {weight} * v.least / v.length end as anti))"""
    rows = rows.join(sides.join(total, "__query"), "__query", "left").withColumn("__points", F.expr(points))
    values = F.expr("map_from_entries(transform(__x, x -> struct(x.scorer as scorer, x.score * __points[x.scorer].unit as value)))")
    rows = rows.withColumn("__values", values)
    far, near = (F.expr(f"sqrt(round(aggregate(array_sort(map_keys(__points)), 0.0D, (d, s) -> d + power(coalesce(__values[s], 0.0D) - __points[s].{end}, 2)), 12))") for end in ("ideal", "anti"))
    rows = rows.select("__query", "__item", "__by", F.coalesce(F.size("__points"), F.lit(0)).alias("__k"), near.alias("__a"), far.alias("__b"))
    both = F.col("__a") + F.col("__b")
    return rows.select("__query", "__item", "__by", "__k", F.when(both > 0, F.round(F.col("__a") / both, 9)).otherwise(F.lit(0.0)).alias("closeness"))


def ideal_point_ranking(
    hits: DataFrame, query: str = "query_id", item: str = "chunk_id", scorer: str = "scorer", score: str = "score",
    weights: Mapping[str, float] | None = None, winsor: float = 0.05,
) -> DataFrame:
    """query, item, closeness (0 to 1), rank (from 1) and by_scorer (scorer to score) of every item.

    * A null, NaN or absent score is worth less than the lowest real score of its scorer.
    * A scorer without any real score in a query takes no part there; a query without any
      real score gets closeness 0 for all its items.
    * Equal items of one query rank by the item's id. Weights default to 1 for each scorer.
    * The winsor bounds are scores whose relative rank is off by 1 in 10,000 at most; among
      fewer scores than that they are exact.
    * An empty table gives no rows; other columns are left out, so their names can't clash.
    """
    scored = cut(closeness_of(items_of(hits, query, item, scorer, score), weights, winsor))
    ranked = _ranked(scored).withColumn("by_scorer", F.when(F.size("__by") > 0, F.map_from_entries("__by")))
    return ranked.select(F.col("__query").alias(query), F.col("__item").alias(item), "closeness", "rank", "by_scorer")


def _ranked(scored: DataFrame) -> DataFrame:
    scored = scored.withColumn("__band", F.floor(F.col("closeness") * BANDS))
    sizes = scored.groupBy("__query", "__band").agg(F.count("*").alias("__n"))
    higher = F.expr("coalesce(sum(__n) over (partition by __query order by __band desc rows between unbounded preceding and 1 preceding), 0)")
    sizes = sizes.select("__query", "__band", higher.alias("__higher"))
    place = F.expr("row_number() over (partition by __query, __band order by closeness desc, __item)")
    return scored.withColumn("__place", place).join(sizes, ["__query", "__band"]).withColumn("rank", F.col("__higher") + F.col("__place"))


#: __b beats __a: it has the higher score in more than half of the query's scorers.
_BEATS = "size(filter({b}, x -> map_from_entries({a})[x.scorer] is null or x.score > map_from_entries({a})[x.scorer])) * 2 > __k"


def majority_winners(
    hits: DataFrame, query: str = "query_id", item: str = "chunk_id", scorer: str = "scorer", score: str = "score",
    weights: Mapping[str, float] | None = None, rounds: int = 1_000,
) -> DataFrame:
    """query, item of the item that beats every other item of its query in more than half of its scorers.

    The first of the ranking is the candidate. Only an item that beats it can still win, so
    all others leave the ranking; the first of those left is the next candidate, until no one
    is left above it. That one is then checked against every item of the query. The
    candidates are the ranking's first ones because those leave few: the better an item, the
    fewer beat it. For scores of which that isn't so, an item drawn by a hash must be beaten as
    well, which leaves half in the mean, so the rounds grow at most with the logarithm of the
    largest query. A query's only item wins; of several items of a query without a real score none does.
    """
    scored = cut(closeness_of(items_of(hits, query, item, scorer, score), weights))
    left, last = scored, None
    for turn in range(rounds):
        drawn = F.struct(F.xxhash64("__item", F.lit(turn)), "__item", "__by")
        first = left.groupBy("__query").agg(F.min(F.struct(-F.col("closeness"), "__item", "__by")).alias("__f"), F.min(drawn).alias("__d"))
        first = first.select("__query", F.col("__f.__item").alias("__best"), F.col("__f.__by").alias("__best_by"), F.col("__d.__item").alias("__drawn"), F.col("__d.__by").alias("__drawn_by"))
        beats = [F.expr(_BEATS.format(a=f"{x}_by", b="__by")) | (F.col("__item") == F.col(x)) for x in ("__best", "__drawn")]
        met = left.join(first, "__query").filter((F.col("__item") == F.col("__best")) | (beats[0] & beats[1]))
        met = cut(met.select(*left.columns, "__best", "__best_by"))
        above = met.filter("__item <> __best").select(*left.columns)
        done = met.filter("__item = __best").select("__query", "__best", "__best_by").join(above.select("__query").distinct(), "__query", "left_anti")
        last = done if last is None else last.unionByName(done)
        if above.isEmpty():
            break
        left = above
    else:
        raise RuntimeError("the rounds did not suffice")
    beaten = F.expr(_BEATS.format(a="__by", b="__best_by"))
    return (
        scored.join(last, "__query")
        .groupBy("__query", "__best")
        .agg(F.min((F.col("__item") == F.col("__best")) | beaten).alias("__all"))
        .filter("__all")
        .select(F.col("__query").alias(query), F.col("__best").alias(item))
    )
