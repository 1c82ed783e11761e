import random
from collections import defaultdict

from skerry.llm.ranking import ideal_point_ranking, majority_winners

KIND = "query_id string, chunk_id string, scorer string, score double, rank int"


def slow(rows):
    got = defaultdict(dict)
    items, scorers = defaultdict(set), defaultdict(set)
    for q, c, s, x, _ in rows:
        if q is None or c is None:
            continue
        items[q].add(c)
        if x is not None and x == x:
            got[q][c, s] = max(x, got[q].get((c, s), x))
            scorers[q].add(s)
    out = []
    for q, cs in items.items():
        for c in cs:
            wins = lambda d: sum(got[q].get((c, s)) is not None and (got[q].get((d, s)) is None or got[q][c, s] > got[q][d, s]) for s in scorers[q]) * 2 > len(scorers[q])  # noqa: B023, E731
            if all(wins(d) for d in cs if d != c):
                out.append((q, c))
    return sorted(out)


def test_winners_as_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for q in range(60):
        for c in range(rng.randint(1, 8)):
            for s in ("bm25", "dense", "rerank", "links")[: rng.randint(1, 4)]:
                rows.append((f"q{q}", f"c{c}", s, rng.choice([None, float("nan"), *(float(rng.randint(-3, 9)) * 10 ** rng.randint(0, 4) for _ in range(6))]), 0))
    rows += rows[:40] + [("lone", "c", "bm25", None, 0), ("none", "a", "bm25", None, 0), ("none", "b", "bm25", None, 0), (None, "c", "bm25", 1.0, 0), ("q1", None, "bm25", 99.0, 0)]
    df = spark.createDataFrame(rows, KIND)
    assert sorted(map(tuple, majority_winners(df).collect())) == slow(rows)


def test_a_large_query(spark):
    rows = [("hot", f"c{i}", s, float((i * 7919) % 1000 if s == "a" else i), 0) for i in range(1000) for s in ("a", "b", "c")]
    assert [r["chunk_id"] for r in majority_winners(spark.createDataFrame(rows, KIND)).collect()] == ["c999"]


def test_a_winner_whom_the_ranking_puts_last(spark):
    # c beats each other item narrowly in a and b, while those are far ahead in d
    rows = [("q", "c", "a", 100.0, 0), ("q", "c", "b", 100.0, 0), ("q", "c", "d", 0.0, 0)]
    rows += [("q", f"x{i}", s, v, 0) for i in range(60) for s, v in (("a", 99.0), ("b", 99.0), ("d", 900.0 + i))]
    df = spark.createDataFrame(rows, KIND)
    assert ideal_point_ranking(df).filter("chunk_id = 'c'").first()["rank"] > 1
    assert [r["chunk_id"] for r in majority_winners(df).collect()] == ["c"]


def test_rounds_stay_few_without_a_winner(spark):
    # three in a circle at the top of many: everyone is beaten by someone
    rows = [("q", f"i{i:03}", s, float((i + shift) % 300), 0) for i in range(300) for s, shift in (("a", 0), ("b", 100), ("d", 200))]
    df = spark.createDataFrame(rows, KIND)
    assert majority_winners(df, rounds=40).count() == 0


def test_scale_of_a_scorer_does_not_matter(spark):
    rng = random.Random(1)
    rows = [(f"q{q}", f"c{c}", s, rng.random(), 0) for q in range(5) for c in range(20) for s in ("a", "b", "c")]
    stretched = [(q, c, s, x * 1e5 - 3e4 if s == "b" else x, r) for q, c, s, x, r in rows]
    view = lambda data: sorted((r["query_id"], r["rank"], r["chunk_id"]) for r in ideal_point_ranking(spark.createDataFrame(data, KIND)).collect())
    assert view(rows) == view(stretched)


def test_ranks_ties_and_missing_scores(spark):
    rows = [("q", "best", "a", 9.0, 0), ("q", "best", "b", 1.0, 0), ("q", "t2", "a", 5.0, 0), ("q", "t1", "a", 5.0, 0), ("q", "gone", "a", None, 0), ("e", "x", "a", None, 0)]
    got = {(r["query_id"], r["chunk_id"]): r for r in ideal_point_ranking(spark.createDataFrame(rows, KIND)).collect()}
    assert [got["q", c]["rank"] for c in ("best", "t1", "t2", "gone")] == [1, 2, 3, 4]
    assert got["q", "gone"]["closeness"] == 0 and got["q", "best"]["closeness"] == 1 and got["e", "x"]["closeness"] == 0
    weighted = ideal_point_ranking(spark.createDataFrame([("q", "x", "a", 2.0, 0), ("q", "x", "b", 1.0, 0), ("q", "y", "a", 1.0, 0), ("q", "y", "b", 2.0, 0)], KIND), weights={"b": 5.0})
    assert weighted.filter("rank = 1").first()["chunk_id"] == "y"
    assert ideal_point_ranking(spark.createDataFrame([], KIND)).count() == 0 and majority_winners(spark.createDataFrame([], KIND)).count() == 0
