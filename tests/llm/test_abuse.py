import random

import numpy as np

from skerry.llm import abuse as A
from skerry.llm.queries import QUERIES

KIND = "doc_id bigint, text string, source string, score double"
LABELS = "doc_id bigint, toxic int, reviewer string"


def said(text):
    """The words of each sentence as numbers."""
    words, ends = A.numbers_of([text])
    assert ends.tolist() == [0, len(words)]
    parts = np.split(words, np.flatnonzero(words == 0))
    return [tuple(x[x != 0].tolist()) for x in parts if (x != 0).any()]


def test_spellings():
    assert [A.plain_word(x) for x in "You B1TCH, a.s.s.h.o.l.e and i***t; cooool".split()] == "you bitch, asshole and i*t; col".split()
    assert [A.plain_word(x) for x in "3rd issue #67 of 1987, Earth-95".split()] == "3rd issue #67 of 1987, earth-95".split()
    assert [A.plain_word(x) for x in A.mended("i\u200bdiot ｉｄｉｏｔ crétin CÃ¡llate").split()] == "idiot idiot cretin callate".split()
    assert said("One two. Three!\nFour 5") == [*said("one two"), *said("three"), *said("four 7")]
    assert said("you i d i o t now") == said("you idiot now") and said("a b c") != said("abc") and said("stop. i d i o t") == [*said("stop"), *said("idiot")]
    assert said("") == said(" \n ") == []


def test_one_rule_for_sentences_of_all_lengths():
    words, _ = A.numbers_of(["ww " + "xx " * 99 + ". yy zz"])
    begin, end = A.runs(words, 1)
    sizes = (end - begin).tolist()
    assert sizes == [24] * 77 + [2] and A.runs(words, 12)[0].tolist() == [0, 12, 24, 36, 48, 60, 72, 84, 101]
    model = A.Model.load()
    weights = model.dense()
    for n in (14, 16, 20, 26, 40):  # the words in front are harmless, so their number makes no difference
        scores = A.score_many(weights, model.bias, ["the old harbour stood by the north wall and " + "so " * (n - 14) + "you are a worthless idiot"])
        assert scores[0] > 0.5


def test_runs_as_brute_force():
    rng = np.random.default_rng(4)
    model = A.Model(np.arange(1 << 20), rng.normal(size=1 << 20), 0.3)
    texts = [" ".join(rng.choice(["aa", "bb", "cc.", "dd", "e", "f***k"], rng.integers(0, 70))) for _ in range(40)] + [None, ""]
    got = A.score_many(model.dense(), model.bias, texts)
    for text, score in zip(texts, got, strict=True):
        words, _ = A.numbers_of([text])
        where, what = A.features(words)
        best, inside = -np.inf, words != 0
        for i in np.flatnonzero(inside):
            j = i
            while j < len(words) and inside[j] and j - i < A.RUN:
                j += 1
            best = max(best, model.weight[what[(where >= i) & (where < j)]].sum() + 0.3) if j - i == A.RUN or i == 0 or not inside[i - 1] else best
        assert abs(score - (1 / (1 + np.exp(-np.clip(best, -700, 30))))) < 1e-5


def made(rng, n):
    benign = ["the council voted to exile the raven", "my copy has a misprint on page", "we will see him lose his powers", "who found the silver ring first"]
    bad = ["you are a filthy lying rat", "go and rot in your hole", "all of them are vermin to be wiped out"]
    rows, truth = [], []
    for i in range(n):
        text = [rng.choice(benign) + f" {rng.choice(['north', 'south', 'harbor'])}" for _ in range(rng.randint(2, 9))]
        toxic = rng.random() < 0.25
        if toxic:
            text.insert(rng.randrange(len(text)), rng.choice(bad))
        rows.append((i, ". ".join(text) + ".", f"s{i % 3}", 0.0))
        truth.append(toxic)
    return rows, truth


def test_held_out_accuracy_with_noisy_labels(spark):
    rng = random.Random(8)
    rows, truth = made(rng, 600)
    labels = [(i, int(truth[i] != (rng.random() < 0.03)), "r1") for i in range(300)]
    labels += labels[:30] + [(1, 1, "r2"), (1, 0, "r3"), (2, None, "r4"), (9999, 1, "r1")]
    df = spark.createDataFrame(rows, KIND)
    model = A.fit_documents(df, spark.createDataFrame(labels, LABELS))
    scores = {r["doc_id"]: r["score"] for r in A.score_documents(df, model).collect()}
    right = sum((scores[i] >= 0.5) == truth[i] for i in range(300, 600))
    assert right >= 295
    rates = {r["source"]: r for r in A.source_rates(df, spark.createDataFrame(list(scores.items()), "doc_id bigint, score double")).collect()}
    assert sum(r["n_docs"] for r in rates.values()) == 600 and all(0 < r["rate"] < 0.5 for r in rates.values())


def test_weights_are_sparse(tmp_path):
    rows, truth = made(random.Random(3), 200)
    model = A.fit([(r[1], int(t)) for r, t in zip(rows, truth, strict=True)])
    assert 0 < len(model.at) < 0.01 * (1 << model.bits)
    model.save(tmp_path / "m.npz")
    assert np.allclose(A.Model.load(str(tmp_path / "m.npz")).dense(), model.dense(), atol=1e-6)


def test_null_empty_long_and_no_labels(spark):
    df = spark.createDataFrame([(1, None, None, 0.0), (2, "", "s", 0.0), (3, "harmless words here. " * 20_000, "s", 0.0), (4, "you stupid piece of trash, go to hell you bastard", None, 0.0), (4, "you stupid piece of trash, go to hell you bastard", None, 0.0)], KIND)
    for model in (None, A.fit_documents(df, spark.createDataFrame([], LABELS))):
        rows = A.score_documents(df, model).collect()
        got = {r["doc_id"]: r["score"] for r in rows}
        assert got[1] == got[2] == 0 and got[4] > got[3] and len(rows) == 5
    assert A.score_documents(df.limit(0)).count() == 0


def test_every_query_has_its_columns(spark, small):
    want = {
        "p1_found": ["chunk_ord"], "p2_found": ["chunk_ord", "boundary"], "p3_found": ["chunk_ord_a", "chunk_ord_b"], "p4_found": ["query_id", "chunk_id"],
        "p5_found": ["chunk_ord", "line_no"], "p6_ids": ["doc_id", "ids"], "p8_found": ["doc_id"],
    }
    for name, columns in want.items():
        assert QUERIES[name](spark, small).columns == columns
