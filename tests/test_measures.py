import math

import pytest
from pyspark.sql import functions as F

from skerry.operators import context, evaluate, fallback, manifest


def test_retrieval_measures(spark):
    hits = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y"), ("b", 1, "z")], "query_id string, rank bigint, doc_id string")
    qrels = spark.createDataFrame([("a", "x"), ("b", "w"), ("c", "v")], "query_id string, doc_id string")
    got = {r["query_id"]: r for r in evaluate.retrieval_measures(hits, qrels).collect()}
    a = got["a"]
    assert (a["hit_rate"], a["recall"], a["mrr"]) == (1.0, 1.0, 1.0) and a["precision"] == pytest.approx(2 / 3)
    assert a["ndcg"] == pytest.approx(1 + 1 / math.log2(3))  # may exceed 1
    assert all(got["b"][m] == 0 for m in ("hit_rate", "precision", "recall", "mrr", "ndcg")) and got["c"]["ndcg"] == 0


def test_token_f1(spark):
    rows = spark.createDataFrame([(1, "blue blue red", "blue red red"), (2, "", "x"), (3, None, "x"), (4, "the", "the")], "k int, a string, r string")
    got = {r["k"]: r["token_f1"] for r in evaluate.token_f1(rows, "k", "a", "r").collect()}
    assert got[1] == pytest.approx(2 / 3) and got[2] == got[3] == got[4] == 0


def test_low_p95_and_report(spark):
    rows = spark.createDataFrame([("c", float(i), 0.5) for i in range(1, 61)] + [(None, 100.0, None)], "category string, total_seconds double, hit_rate double")
    got = {(r["category"], r["overall"]): r for r in evaluate.report(rows).collect()}
    assert got["c", False]["latency_p95_s"] == 57 and got["c", False]["n"] == 60
    assert got[None, False]["hit_rate"] is None and got[None, False]["latency_p95_s"] == 100
    assert got[None, True]["n"] == 61 and got[None, True]["hit_rate"] == 0.5
    other = {(r["category"], r["overall"]): r for r in evaluate.latency_report(rows, "category", "total_seconds").collect()}
    assert other["c", False]["p95"] == 57 and other[None, True]["n"] == 61


def test_context_budget(spark):
    hits = spark.createDataFrame([("q", i, f"d{i}", None, "x" * 40) for i in (1, 2, 3)], "query_id string, rank bigint, doc_id string, title string, text string")
    asked = spark.createDataFrame([("q", "why?"), ("r", None)], "query_id string, question string")
    got = {r["query_id"]: r for r in context.prompts(hits, asked, 60).collect()}
    assert got["q"]["n_passages"] == 2
    assert got["q"]["context"] == "[1] (from: d1)\n" + "x" * 40 + "\n\n---\n\n[2] (from: d2)\n" + "x" * 20
    assert got["r"]["n_passages"] == 0 and got["r"]["prompt"].endswith("Question: ")


def test_fallback_choice(spark):
    hits = spark.createDataFrame([("a", 0.44), ("b", 0.45)], "query_id string, score double")
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "query_id string")
    assert {r["query_id"]: r["needs_fallback"] for r in fallback.needs_fallback(asked, hits, 0.45).collect()} == {"a": True, "b": False, "c": True}
    found = spark.createDataFrame([("q", "w", ["A", " ", "B"])], "query_id string, wiki string, titles array<string>")
    assert [(r["title"], r["score"]) for r in fallback.search_scores(found, 3).orderBy("title").collect()] == [("A", 3), ("B", 1)]
    cand = spark.createDataFrame([("q", "Red (Earth) king", "m", "King", 3), ("q", "Red (Earth) king", "d", "Red King", 3), ("q", "Red (Earth) king", "d", "x", 1)], "query_id string, query string, wiki string, title string, score int")
    assert fallback.best_candidates(cand).first()["title"] == "Red King"


def test_manifest(spark):
    kind = "wiki string, title string, slug string, ok boolean, path string, url string, chars bigint, error string, scraped_at timestamp_ntz, arrived_at timestamp_ntz"
    import datetime as dt

    at = lambda d: dt.datetime(2025, 1, d)
    old = spark.createDataFrame([("w", "A", "a", True, "", "", 5, None, at(3), at(3)), ("w", "A", "a", True, "", "", 5, None, at(3), at(3)), ("w", "B", "b", False, "", "", None, "x", at(1), at(1))], kind)
    new = spark.createDataFrame([("w", "A", "a", False, "", "", None, "late", at(1), at(9)), ("w", "C", "c", None, "", "", 1, None, at(2), at(2)), (None, "N", "n", True, "", "", 1, None, at(2), at(2))], kind)
    assert {r["slug"]: r["ok"] for r in manifest.latest(old.union(new)).collect()} == {"a": True, "b": False, "c": None}
    merged = manifest.upsert(old, new)
    assert {r["slug"]: r["error"] for r in merged.collect()} == {"a": "late", "b": "x", "c": None}
    assert tuple(manifest.summary(merged).first()) == ("w", 0, 3, 1)
    assert manifest.latest(old.limit(0)).count() == 0 and F.col is not None
