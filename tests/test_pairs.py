import random

import duckdb
import pytest

from skerry.operators import lexical, pairs
from skerry.plans import catalogue

CHUNKS = "chunk_ord bigint, text string"
QUESTIONS = "id string, question string"


def tables(spark, folder, chunks, questions):
    spark.createDataFrame(chunks, CHUNKS).repartition(3).write.parquet(f"{folder}/chunks.parquet")
    spark.createDataFrame(questions, QUESTIONS).write.parquet(f"{folder}/eval_questions.parquet")


def by_sql(folder):
    with duckdb.connect() as con:
        for name in ("chunks", "eval_questions"):
            con.execute(f"create view {name} as from '{folder}/{name}.parquet/*.parquet'")
        return con.execute(catalogue.ORACLES["bm25_scores"]).fetchall()


def in_order(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = "red blue king queen tower sea ship night don't 1984".split()
    chunks = [(i, " ".join(rng.choices(words, k=rng.randint(0, 12)))) for i in range(90)]
    chunks += [(90, None), (91, ""), (92, "!?"), (93, "Red RED red"), (94, "unasked words alone")]
    questions = [(f"q{i}", " ".join(rng.choices(words, k=rng.randint(1, 4)))) for i in range(11)]
    return chunks, [*questions, ("none", "zzz"), ("null", None), ("empty", ""), ("often", "red red Red king")]


def test_bm25_scores_shuffle_no_pairs(spark, tmp_path, rows):
    tables(spark, tmp_path, *rows)
    scores = catalogue.bm25_scores(spark, str(tmp_path))
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan and "Sort" not in plan
    assert in_order(scores.collect()) == in_order(by_sql(tmp_path))


def test_repeated_and_null_keys_are_as_in_sql(spark, tmp_path, rows):
    chunks, questions = rows
    chunks = [*chunks, (5, "red king of the sea"), (5, "blue king of the sea"), (5, "red"), (93, "Red RED red"), (None, "red tower"), (None, "night"), (7, None)]
    tables(spark, tmp_path, chunks, [*questions, ("q1", "red night"), (None, "king"), (None, "queen king")])
    assert in_order(catalogue.bm25_scores(spark, str(tmp_path)).collect()) == in_order(by_sql(tmp_path))


def test_one_null_key_is_a_key(spark, tmp_path, rows):
    tables(spark, tmp_path, [*rows[0], (None, "red tower")], rows[1])
    got = in_order(catalogue.bm25_scores(spark, str(tmp_path)).collect())
    assert got == in_order(by_sql(tmp_path)) and None in {g[1] for g in got}


def test_blocks_of_queries_and_packed_rows_do_not_matter(spark, rows, monkeypatch):
    chunks, questions = spark.createDataFrame(rows[0], CHUNKS), spark.createDataFrame(rows[1], QUESTIONS)
    want = {(r["query_id"], r["chunk"]): r["score"] for r in lexical.bm25(lexical.build(chunks), questions, "id").collect()}
    monkeypatch.setattr(pairs, "ROWS", 7)
    monkeypatch.setattr(pairs, "STEP", 3)
    got = pairs.bm25_pairs(chunks, questions, query_key="id", block=4).collect()
    assert len(got) == len(want) and {(r["query_id"], r["chunk"]): r["score"] for r in got} == pytest.approx(want, abs=1e-6)


def test_empty_tables(spark, tmp_path, rows):
    for i, (chunks, questions) in enumerate((([], rows[1]), (rows[0], []), ([], []), (rows[0], [("null", None)]), ([(1, None), (1, "")], rows[1]))):
        tables(spark, tmp_path / str(i), chunks, questions)
        assert catalogue.bm25_scores(spark, str(tmp_path / str(i))).collect() == []
