import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skerry.llm.split import boundary_of, split_oversized


def pieces(spark, texts, limit=40, overlap=10):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "k int, text string, piece string")
    out = {}
    for r in split_oversized(df, ["k"], limit=limit, overlap=overlap).orderBy("k", "piece_no").collect():
        out.setdefault(r["k"], []).append(r)
    return out


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(st.sampled_from("ab. \n\t\r😀漢!?"), max_size=400), min_size=1, max_size=30))
def test_pieces_fit_repeat_and_give_the_text_again(spark, texts):
    for k, rows in pieces(spark, texts).items():
        assert all(len(r["piece"]) <= 40 for r in rows)
        assert "".join(r["piece"][len(r["piece"]) - r["n_new"] :] for r in rows) == texts[k]
        before = ""
        for r in rows:
            assert r["piece"][: len(r["piece"]) - r["n_new"]] == before[-10:] or r["piece_no"] == 0
            before += r["piece"][len(r["piece"]) - r["n_new"] :]
        assert [r["piece_no"] for r in rows] == list(range(rows[0]["n_pieces"]))


def test_stronger_boundaries_are_preferred(spark):
    text = "a" * 20 + ". bb\ncc dd\n\n" + "e" * 20
    assert pieces(spark, [text])[0][0]["piece"] == "a" * 20 + ". bb\ncc dd\n\n"
    assert pieces(spark, ["a" * 25 + ". b c " + "d" * 30])[0][0]["piece"] == "a" * 25 + ". "
    assert pieces(spark, ["ab " + "c" * 60])[0][0]["piece"] == "ab "
    assert len(pieces(spark, ["c" * 100])[0][0]["piece"]) == 40


def test_null_empty_short_and_repeated(spark):
    got = pieces(spark, [None, "", "short", "short"])
    assert got[0][0]["piece"] is None and got[1][0]["piece"] == "" and got[2][0]["n_pieces"] == 1 and got[2][0]["boundary"] is None
    df = spark.createDataFrame([], "k int, text string")
    assert split_oversized(df, ["k"]).count() == 0
    with pytest.raises(ValueError):
        split_oversized(df, ["k"], limit=5, overlap=5)


def test_very_long_text(spark):
    text = ("word " * 30 + "\n") * 3000
    rows = pieces(spark, [text], 1800, 250)[0]
    assert max(len(r["piece"]) for r in rows) <= 1800 and sum(r["n_new"] for r in rows) == len(text)


@pytest.mark.parametrize(
    ("text", "level"),
    [("aaaa\n \t\nbbbb", "paragraph"), ("aaaa\nbbbb\n\n" + "c" * 5, "line"), ("aaa. bbb\nc", "sentence"), ("aaaaa bb c", "word"), ("aaaaaaa", "none"), ("  aaaaa  \n", "paragraph"), ("aa.bbb cc", "none"), ("aaaa \t \n bb", "line"), ("aaaa bb. cc", "word"), ("aaaa? \n\n bbbb! cc", "sentence"), ("   \n   \n", "paragraph"), ("aaaaa\n\n\n\n\nbbbbb", "paragraph"), ("漢😀漢😀漢", "paragraph"), ("漢😀漢😀漢漢", "none")],
)
def test_boundary(spark, text, level):
    assert spark.createDataFrame([(text,)], "t string").select(boundary_of(F.col("t"), 5).alias("b")).first()["b"] == level


def plain_boundary(text, limit):
    import re

    def fits(parts):
        return all(len(p.strip(" \t\r\n")) <= limit for p in parts)

    lines = text.split("\n")
    levels = {"paragraph": re.split(r"\n[ \t\r\n]*\n", text), "line": lines, "sentence": [p for x in lines for p in re.split(r"(?<=[.!?])[ \t\r\n]+", x)], "word": re.split(r"[ \t\r\n]+", text)}
    return next((name for name, parts in levels.items() if fits(parts)), "none")


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(st.sampled_from("abc.. \n\t\r😀漢!?"), max_size=60), min_size=1, max_size=60))
def test_boundary_against_splitting(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, t string")
    for limit in (3, 7):
        got = {r["k"]: r["b"] for r in df.select("k", boundary_of(F.col("t"), limit).alias("b")).collect()}
        assert got == {i: plain_boundary(t, limit) for i, t in enumerate(texts)}


def test_a_blank_line_of_any_length_is_a_boundary(spark):
    text = "a" * 600 + "\n" + " " * 500 + "\n" + "b c\n" * 400
    assert pieces(spark, [text], 1800, 250)[0][0]["piece"] == "a" * 600 + "\n" + " " * 500 + "\n"
    df = spark.createDataFrame([("x" * 3 + "\n" + " " * 100_000 + "\n" + "y" * 5,)], "t string")
    assert df.select(boundary_of(F.col("t"), 5).alias("b")).first()["b"] == "paragraph"


def test_overlap_over_short_cuts(spark):
    rows = pieces(spark, ["a " + "b" * 1799 + " c " + "d" * 3000 + " e"], 1800, 1500)[0]
    before = ""
    for r in rows:
        assert len(r["piece"]) <= 1800 and r["piece"][: len(r["piece"]) - r["n_new"]] == before[-1500:]
        before += r["piece"][len(r["piece"]) - r["n_new"] :]
