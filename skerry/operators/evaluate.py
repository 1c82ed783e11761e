"""Measures of ranked retrieval and of answers, for all questions at once, overall and by category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.functions.text import answer_tokens
from skerry.session import cut

MEASURES = ("hit_rate", "precision", "recall", "mrr", "ndcg", "token_f1", "faithfulness", "relevance", "correctness", "abstention_correct")


def relevance_pairs(questions: DataFrame) -> DataFrame:
    """query_id, doc_id: each relevant document of each answerable question, once."""
    rows = questions.filter("answerable and relevant_docs is not null")
    return rows.select(F.col("id").alias("query_id"), F.explode("relevant_docs").alias("doc_id")).filter("doc_id is not null").distinct()


def retrieval_measures(hits: DataFrame, qrels: DataFrame) -> DataFrame:
    """query_id, hit_rate, precision, recall, mrr, ndcg of every query of ``qrels``, also of those without hits.

    Precision counts the chunks that were retrieved; the gain counts every relevant chunk but
    the ideal at most one per relevant document, so ndcg may exceed 1.
    """
    wanted = qrels.groupBy("query_id").agg(F.count("*").alias("__n"))
    rows = hits.select("query_id", "rank", "doc_id").join(qrels.withColumn("__rel", F.lit(1)), ["query_id", "doc_id"], "left").withColumn("__rel", F.coalesce("__rel", F.lit(0)))
    got = rows.groupBy("query_id").agg(
        F.max("__rel").alias("__hit"), F.avg("__rel").alias("__p"), F.countDistinct(F.when(F.col("__rel") == 1, F.col("doc_id"))).alias("__found"),
        F.min(F.when(F.col("__rel") == 1, F.col("rank"))).alias("__first"), F.sum(F.col("__rel") / F.log2(F.col("rank") + 1)).alias("__dcg"), F.count("*").alias("__k"),
    )
    both = wanted.join(got, "query_id", "left")
    size = F.least("__n", "__k").cast("int")
    ideal = F.aggregate(F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.expr("cast(array() as array<int>)")), F.lit(0.0), lambda total, i: total + 1 / F.log2(i + 1))
    zero = F.lit(0.0)
    return both.select(
        "query_id", F.coalesce(F.col("__hit").cast("double"), zero).alias("hit_rate"), F.coalesce("__p", zero).alias("precision"),
        F.coalesce(F.col("__found") / F.col("__n"), zero).alias("recall"), F.coalesce(1 / F.col("__first"), zero).alias("mrr"),
        F.coalesce(F.when(ideal > 0, F.col("__dcg") / ideal), zero).alias("ndcg"),
    )


def token_f1(pairs: DataFrame, key: str, answer: str, reference: str) -> DataFrame:
    """``key`` and token_f1: the harmonic mean of precision and recall of the two token multisets; 0 if either is empty."""
    rows = pairs.select(key, answer_tokens(F.coalesce(F.col(answer), F.lit(""))).alias("__a"), answer_tokens(F.coalesce(F.col(reference), F.lit(""))).alias("__r"))

    def times(words: Column, word: Column) -> Column:
        return F.size(F.filter(words, lambda w: w == word))

    overlap = F.aggregate(F.array_distinct("__a"), F.lit(0), lambda total, w: total + F.least(times(F.col("__a"), w), times(F.col("__r"), w)))
    rows = rows.withColumn("__o", overlap)
    f1 = 2.0 * F.col("__o") / (F.size("__a") + F.size("__r"))
    return rows.select(key, F.when(F.col("__o") > 0, f1).otherwise(0.0).alias("token_f1"))


def low_p95(rows: DataFrame, group: list[str], value: str, ranges: int = 256) -> DataFrame:
    """``group``, n, mean and p95 of the values that aren't null.

    p95 is the value at rank int(0.95 n), at least 1: lower than a usual percentile, never
    between two. Values are counted, the counts added up in ``ranges`` ranges of about equal
    weight, and only the range that holds the rank is put in order, so no task sorts a whole group.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    counts = cut(counts)
    ends = counts.agg(F.percentile_approx("__v", [i / ranges for i in range(1, ranges)], F.lit(10 * ranges))).first()[0] or []
    place = F.size(F.filter(F.array(*[F.lit(x) for x in sorted(set(ends))]) if ends else F.expr("cast(array() as array<double>)"), lambda x: x < F.col("__v")))
    placed = counts.withColumn("__r", place)
    parts = placed.groupBy(*group, "__r").agg(F.sum("__c").alias("__n"), F.sum(F.col("__v") * F.col("__c")).alias("__sum"))
    mine = Window.partitionBy(*group)
    upto = F.sum("__n").over(mine.orderBy("__r").rowsBetween(Window.unboundedPreceding, 0))
    parts = parts.withColumn("__upto", upto).withColumn("n", F.sum("__n").over(mine)).withColumn("mean", F.sum("__sum").over(mine) / F.col("n"))
    rank = F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(0.95)))
    there = parts.filter((F.col("__upto") >= rank) & (F.col("__upto") - F.col("__n") < rank)).select(*[F.col(g).alias(f"__{g}") for g in group], F.col("__r").alias("__there"), "n", "mean", (F.col("__upto") - F.col("__n")).alias("__before"))
    same = [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in group]
    near = placed.join(there, [*same, F.col("__r") == F.col("__there")])
    upto = F.col("__before") + F.sum("__c").over(mine.orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    near = near.withColumn("__upto", upto).filter(F.col("__upto") >= rank)
    return near.groupBy(*group).agg(F.first("n").alias("n"), F.first("mean").alias("mean"), F.min("__v").alias("p95"))


def report(results: DataFrame, measures: tuple[str, ...] = MEASURES, category: str = "category") -> DataFrame:
    """Means of the measures (4 digits; null where no question has a value), latencies and n: overall (category null, overall true) and by category."""
    results = results.withColumnRenamed(category, "category")
    kept = [m for m in measures if m in results.columns]
    aggs = [F.round(F.avg(m), 4).alias(m) for m in kept]
    if "retrieval_seconds" in results.columns:
        aggs.append(F.round(F.avg("retrieval_seconds"), 3).alias("retrieval_mean_s"))
    rows = results.rollup("category").agg(F.grouping("category").cast("boolean").alias("overall"), *aggs, F.count("*").alias("n"))
    if "total_seconds" not in results.columns:
        return rows.withColumnRenamed("category", category)
    told = latency_report(results, "category", "total_seconds")
    told = told.select(F.col("category").alias("__c"), F.col("overall").alias("__o"), F.round("mean", 2).alias("latency_mean_s"), F.round("p95", 2).alias("latency_p95_s"))
    rows = rows.join(told, F.col("category").eqNullSafe(F.col("__c")) & (F.col("overall") == F.col("__o")), "left").drop("__c", "__o")
    return rows.withColumnRenamed("category", category)


def latency_report(records: DataFrame, category: str, seconds: str) -> DataFrame:
    """category, overall, n, mean, p95: as ``report``."""
    both = records.select(F.explode(F.array(F.lit(False), F.lit(True))).alias("overall"), F.col(category).alias("__category"), F.col(seconds).alias("__s"))
    both = both.select("overall", F.when(~F.col("overall"), F.col("__category")).alias("category"), "__s")
    return low_p95(both, ["overall", "category"], "__s").select("category", "overall", "n", "mean", "p95")
