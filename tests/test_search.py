import math
import random

import pytest
from pyspark.sql import functions as F

from skerry.operators import lexical, search

CHUNKS = "chunk_ord bigint, doc_id string, text string, embedding array<float>"
QUERIES = "query_id string, text string, vector array<float>"


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(1)
    words = "red blue king queen tower sea ship night don't".split()
    rows = [(i, f"d{i % 7}", " ".join(rng.choices(words, k=rng.randint(0, 12))), [rng.uniform(-1, 1) for _ in range(4)]) for i in range(120)]
    rows[3] = (3, "d3", None, None)
    rows[4] = (4, "d4", "", [0.0] * 4)
    rows[5] = (5, "d5", "red king", [1.0, 2.0])
    asked = [(f"q{i}", " ".join(rng.choices(words, k=3)), [rng.uniform(-1, 1) for _ in range(4)]) for i in range(9)]
    asked += [("none", "zzz", None), ("null", None, [1.0, 0.0, 0.0, 0.0])]
    return spark.createDataFrame(rows, CHUNKS).repartition(3), spark.createDataFrame(asked, QUERIES), rows, asked


def cosine(a, b):
    if not a or not b or len(a) != len(b):
        return 0.0
    na, nb = math.sqrt(sum(x * x for x in a)) or 1, math.sqrt(sum(x * x for x in b)) or 1
    return sum(x * y for x, y in zip(a, b, strict=True)) / na / nb


def brute(rows, question, k, alpha, cap):
    import re

    toks = [re.findall(r"[a-z0-9]+(?:'[a-z0-9]+)?", (r[2] or "").lower()) for r in rows]
    n, avg = len(rows), sum(map(len, toks)) / len(rows)
    q = re.findall(r"[a-z0-9]+(?:'[a-z0-9]+)?", (question[1] or "").lower())

    def bm25(t):
        total = 0.0
        for w in q:
            df = sum(w in x for x in toks)
            if w in t:
                total += math.log(1 + (n - df + 0.5) / (df + 0.5)) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg))
        return total

    def scale(xs):
        return [0.0 if max(xs) - min(xs) < 1e-12 else (x - min(xs)) / (max(xs) - min(xs)) for x in xs]

    d, s = scale([cosine(r[3], question[2]) for r in rows]), scale([bm25(t) for t in toks])
    order = sorted((-round(alpha * x + (1 - alpha) * y, 5), r[0], r[1]) for x, y, r in zip(d, s, rows, strict=True))
    pool, out, seen = order[: search.pool_size(k, cap)], [], {}
    for score, chunk, doc in pool:
        seen[doc] = seen.get(doc, 0) + 1
        if not cap or seen[doc] <= cap:
            out.append((chunk, -score))
    return out[:k]


@pytest.mark.parametrize("cap", [0, 1, 2])
def test_hybrid_is_as_brute_force(spark, data, cap):
    chunks, queries, rows, asked = data
    got = {}
    for r in search.search(queries, search.build_index(chunks), per_doc=cap, block=4).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append((r["chunk_ord"], r["score"]))
    for q in asked:
        want = brute(rows, q, 5, 0.7, cap)
        assert [round(x[1], 4) for x in got[q[0]]] == pytest.approx([x[1] for x in want], abs=2e-4)


def test_alpha_at_either_end_is_dense_only(spark, data):
    chunks, queries, *_ = data
    dense = search.search(queries, search.build_index(chunks), hybrid=False).orderBy("query_id", "rank").collect()
    for alpha in (0, 1):
        assert search.search(queries, search.build_index(chunks), alpha=alpha).orderBy("query_id", "rank").collect() == dense


def test_lexical_blocks_are_as_the_join(spark, data):
    chunks, queries, *_ = data
    joined = lexical.bm25(lexical.build(chunks), queries, text="text").withColumn("score", F.round("score", 6)).withColumn("doc_id", F.lit(""))
    want = sorted(map(tuple, search.ranked(joined.select("query_id", F.col("chunk").alias("chunk_ord"), "doc_id", "score"), 5).select("query_id", "rank", "chunk_ord", "score").collect()))
    got = sorted(map(tuple, search.search(queries, search.build_index(chunks), per_doc=0, lexical_only=True).select("query_id", "rank", "chunk_ord", "score").collect()))
    assert got == want and "none" not in {g[0] for g in got}


def test_partitions_do_not_matter(spark, data):
    chunks, queries, *_ = data
    a, b = (search.search(queries, search.build_index(chunks.repartition(n))).orderBy("query_id", "rank").collect() for n in (1, 8))
    assert a == b


def test_empty_tables(spark, data):
    chunks, queries, *_ = data
    assert search.search(queries, search.build_index(chunks.limit(0))).count() == 0
    assert search.search(queries.limit(0), search.build_index(chunks)).count() == 0
