from pyspark.sql import functions as F

from skerry.functions import text as X


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("r")).first()["r"]


def test_search_tokens_are_ascii_with_one_apostrophe_group(spark):
    assert one(spark, X.search_tokens, "Rock'n'roll café DON'T 42") == ["rock'n", "roll", "caf", "don't", "42"]


def test_answer_tokens_keep_repeats_and_drop_stop_words(spark):
    assert one(spark, X.answer_tokens, "The cat and the cat it was") == ["cat", "cat"]


def test_slugify(spark):
    assert one(spark, X.slugify, "Spider-Man: Vol. 1 (Earth-616)") == "spider_man_vol_1_earth_616"


def test_strip_takes_unicode_space(spark):
    assert one(spark, X.strip, "   a b　\n") == "a b"


def test_abstention(spark):
    for said, is_one in [("I don't know.", True), ("I dont know", True), ("It is NOT MENTIONED", True), ("unable to find it", True), ("Yes", False), (None, False)]:
        assert one(spark, X.is_abstention, said) is is_one


def test_judged_takes_the_first_digit_from_one_to_five(spark):
    assert [one(spark, X.judged, x) for x in ("10", "4/5", "none", "9 then 2", "")] == [1.0, 4.0, None, 2.0, None]


def front(spark, value):
    meta, body = X.front_matter(F.col("t"))
    row = spark.createDataFrame([(value,)], "t string").select(meta.alias("m"), body.alias("b")).first()
    return row["m"], row["b"]


def test_front_matter(spark):
    assert front(spark, "---\ntitle: A: B\nsource: http://x\ntitle: C\nplain\n---\n\n  body\n") == ({"source": "http://x", "title": "C"}, "body\n")
    assert front(spark, "---\ntitle: A\nno end") == ({}, "---\ntitle: A\nno end")
    assert front(spark, "---\n---\nb")[0] == {}
    assert front(spark, "---\r\ntitle: A\r\n---\r\nb") == ({"title": "A"}, "b")


def test_resolved_title(spark):
    rows = [({"title": "T"}, "# H\nx", "f.md", "T"), ({}, "# H 1\nx", "f.md", "H 1"), ({}, "text\n# H", "f.x.md", "f.x"), ({"title": ""}, "## H", "f", "f")]
    df = spark.createDataFrame([r[:3] for r in rows], "m map<string,string>, b string, n string")
    got = [r[0] for r in df.select(X.resolved_title(F.col("m"), F.col("b"), F.col("n"))).collect()]
    assert got == [r[3] for r in rows]
