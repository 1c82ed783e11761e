import random
import re

import numpy as np
from pyspark.sql import functions as F

from skerry.llm import near_copies as N
from skerry.llm.near_copies import components, near_copies, near_copy_groups, row_pairs

KIND = "chunk_ord bigint, text string, class string"


def slow(rows, threshold=0.7):
    sets = {}
    for key, text, _ in rows:
        words = re.findall(r"[^\W_]+", (text or "").lower())
        if len(words) >= 3:
            sets[key] = {tuple(words[i : i + 3]) for i in range(len(words) - 2)}
    keys = sorted(sets)
    return sorted((a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]))


def corpus(rng, n=60):
    words = [f"w{i}" for i in range(3000)]
    rows, key = [], 0
    for _ in range(n):
        base = rng.choices(words, k=rng.randint(20, 150))
        for _ in range(rng.randint(1, 4)):
            text = list(base)
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(text))
                text[at : at + 1] = rng.choice([[], ["new"], [text[at].upper(), rng.choice(words)]])
            rows.append((key, rng.choice([" ", ", ", "\n"]).join(text), "x"))
            key += 1
    return rows


def test_as_brute_force(spark):
    rows = corpus(random.Random(1))
    rows += [(900, None, ""), (901, "", ""), (902, "two words", ""), (903, "one two three", ""), (904, "One -- TWO; three!", ""), (905, "日本 の 都市 です", ""), (906, "日本 の 都市 です 。", "")]
    df = spark.createDataFrame(rows, KIND).repartition(5)
    pairs, members = near_copies(df, by="overlap")
    got = sorted(map(tuple, row_pairs(pairs, members).collect()))
    want = slow(rows)
    assert got == want and len(want) > 50
    assert {r["chunk_ord"] for r in members.collect()} == {r[0] for r in rows} - {900, 901, 902}


def test_many_copies_of_one_text_are_one_class(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(i, text, "") for i in range(300)] + [(1000 + i, text + f" end{i}", "") for i in range(5)]
    groups = near_copy_groups(spark.createDataFrame(rows, KIND)).collect()
    assert len({r["group"] for r in groups}) == 1 and len(groups) == 305
    assert {r["n_copies"] for r in groups} == {1, 300} and all(r["n_links"] == 5 for r in groups)


def test_a_chain_is_one_group(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 300)] + [(1000, 1001)], "__a bigint, __b bigint")
    roots = {r["node"]: r["root"] for r in components(edges).collect()}
    assert all(roots[i] == 0 for i in range(1, 301)) and roots[1001] == 1000


def test_empty(spark):
    df = spark.createDataFrame([], KIND)
    pairs, members = near_copies(df)
    assert pairs.count() == 0 and members.count() == 0 and near_copy_groups(df).count() == 0


def test_edited_copies_of_a_third_of_the_rows_are_found(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(5000)]
    base = rng.choices(words, k=80)
    rows = [(1000 + i, " ".join(rng.choices(words, k=80)), "") for i in range(120)]
    for i in range(60):
        text = list(base)
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(80)] = f"edit{rng.random()}"
        rows.append((i, " ".join(text), ""))
    pairs, members = near_copies(spark.createDataFrame(rows, KIND), by="overlap")
    found, want = set(map(tuple, row_pairs(pairs, members).collect())), set(slow(rows))
    assert found <= want and len(found) >= 0.99 * len(want) > 1000


def test_weighted_similarity_as_brute_force(spark):
    rows = corpus(random.Random(8), 30)
    df = spark.createDataFrame(rows, KIND)
    first = N.cut(N.first_pass(df.select("chunk_ord", "text").toDF("__key", "__text"), 3, 1 << 17))
    weights = N.weights_of(first, 1 << 17)
    vectors = {}
    for key, text, _ in rows:
        _, value, times = N.shingles_of(*N.hashed_words([text]), 3)
        vectors[N.classes_of(*N.hashed_words([text]))[0]] = dict(zip(value.tolist(), weights.of(value, times).tolist(), strict=True))
    pairs = near_copies(df, by="similarity")[0].collect()
    assert len(pairs) > 10
    for r in pairs:
        a, b = vectors[r["class_a"]], vectors[r["class_b"]]
        least, most = sum(min(a[k], b[k]) for k in a.keys() & b.keys()), sum(max(a.get(k, 0), b.get(k, 0)) for k in a.keys() | b.keys())
        assert abs(least / most - r["similarity"]) < 1e-6 and r["similarity"] >= N.least_weighted(r["overlap"]) - 1e-6 and r["similarity"] >= 0.7


def test_document_frequencies_are_never_too_low(spark):
    rng = random.Random(2)
    rows = [(i, f"the same three words {rng.random()} " + " ".join(rng.choices("abcdefghij", k=20)), "") for i in range(300)]
    df = spark.createDataFrame(rows, KIND).repartition(7).select(F.col("chunk_ord").alias("__key"), F.col("text").alias("__text"))
    true, total = {}, 0
    for _, text, _ in rows:
        _, value, _ = N.shingles_of(*N.hashed_words([text]), 3)
        total += len(value)
        for v in value.tolist():
            true[v] = true.get(v, 0) + 1
    value = np.array(list(true), np.uint64)
    for counters in (1 << 17, 1 << 8):
        weights = N.weights_of(N.first_pass(df, 3, counters), counters)
        exact = N.Weights(np.zeros((2, counters)), 300)
        floor = total / counters
        best = 1 + np.clip(np.log(301 / (np.maximum(np.array(list(true.values())), floor) + 1)) / np.log(301 / (floor + 1)), 0, 1)
        got = weights.of(value, np.ones(len(value)))
        assert exact.idf.max() == 2 and (got <= best + 1e-5).all()
        if counters == 1 << 17:
            assert np.mean(np.abs(got - best) < 1e-5) > 0.99


def test_salted_classes_give_every_pair(spark):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(i, text, "") for i in range(50)] + [(100 + i, text + " end", "") for i in range(30)]
    got = row_pairs(*near_copies(spark.createDataFrame(rows, KIND), by="overlap"), block=7).collect()
    assert len(got) == len(set(map(tuple, got))) == 80 * 79 // 2
