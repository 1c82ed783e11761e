import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skerry.operators import chunk


def sections(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(chunk.sections(F.col("t")).alias("s")).first()
    return None if row["s"] is None else [tuple(x) for x in row["s"]]


def test_sections(spark):
    text = "intro\n# One\n\n## Two\nbody two\n#tag is text\n####### seven\n# \nlast"
    assert sections(spark, text) == [("", "intro"), ("Two", "body two\n#tag is text\n####### seven"), ("", "last")]
    assert sections(spark, "") == []
    assert sections(spark, None) is None
    assert sections(spark, "a\r\n# B c") == [("", "a"), ("B", "c")]


def packed(spark, texts, most, overlap):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", chunk.pack(F.col("t"), most, overlap).alias("p")).collect()
    return [r["p"] for r in sorted(rows)]


def slow(text, most, overlap):
    """Packing said step by step, with strings and a queue."""
    out, held = [], ""
    for para in (p.strip() for p in re.split(r"\n\s*\n", text)):
        while len(para) > most:
            at = para[:most].rfind(". ")
            n = at + 1 if at > most // 2 else most
            out += [held] * bool(held) + [para[:n].strip()]
            held, para = "", para[n:].strip()
        if not para:
            continue
        if held and len(held) + 2 + len(para) > most:
            out.append(held)
            held = (f"...{held[-overlap:]}\n\n" if overlap else "") + para
        else:
            held = f"{held}\n\n{para}" if held else para
    return out + [held] * bool(held)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(st.sampled_from("ab. \n😀"), max_size=160), min_size=1, max_size=20), st.sampled_from([(20, 5), (30, 0), (12, 4)]))
def test_packing_is_as_slow_packing(spark, texts, sizes):
    assert packed(spark, texts, *sizes) == [slow(t, *sizes) for t in texts]


def test_overlap_may_exceed_the_limit(spark):
    got = packed(spark, ["a" * 280 + "\n\n" + "b" * 300], 300, 50)[0]
    assert [len(x) for x in got] == [280, 355]


def test_chunk_ids_count_over_sections(spark):
    docs = spark.createDataFrame([("d", "T", "x\n\n# S\ny"), ("e", None, ""), ("f", "N", None)], "doc_id string, title string, text string")
    rows = [tuple(r) for r in chunk.chunk_documents(docs).orderBy("chunk_id").collect()]
    assert rows == [("d", "d#0", "", "[T]\nx"), ("d", "d#1", "S", "[T] — S\ny")]
