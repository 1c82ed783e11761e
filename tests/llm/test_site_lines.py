import random
import re
from collections import defaultdict

from skerry.llm.site_lines import bitmaps_of, found_lines, repeated_lines, without_repeated_lines

KIND = "chunk_ord bigint, doc_id string, text string, line_no int"


def slow(rows):
    docs, holders, at = defaultdict(set), defaultdict(set), []
    for key, doc, text, _ in rows:
        if doc is None:
            continue
        wiki = doc.split("__")[0]
        docs[wiki].add(doc)
        for i, line in enumerate((text if text is not None else "").split("\n"), 1):
            norm = re.sub(r"[\W_]+", " ", re.sub(r"\d+", "0", line.lower())).strip()
            if norm and text is not None:
                holders[wiki, norm].add(doc)
                at.append((key, i, wiki, norm))
    return sorted((k, i) for k, i, w, n in at if len(holders[w, n]) >= 5 and len(holders[w, n]) * 10 >= len(docs[w]))


def test_as_brute_force(spark):
    rng = random.Random(2)
    site = ["Share this page!", "SHARE  this page", "revision 12 of the terms", "Revision 7, of the terms.", "---", "", "日本語 のページ"]
    rows = [(i, f"w{i % 3}__d{rng.randrange(40)}.md", "\n".join(rng.choices([*site, f"own line {'x' * rng.randrange(99)}"], k=rng.randrange(6))), 1) for i in range(400)]
    rows += [(900, "w0__d1.md", None, 1), (901, None, "Share this page", 1), (902, "w9__a.md", "alone\nalone\nalone\nalone\nalone\nalone", None)]
    df = spark.createDataFrame(rows, KIND)
    want = slow(rows)
    assert sorted(map(tuple, found_lines(df).collect())) == want and len(want) > 100
    gone = defaultdict(set)
    for key, line in want:
        gone[key].add(line)
    for r in without_repeated_lines(df).collect():
        text = next(x[2] for x in rows if x[0] == r["chunk_ord"])
        if text is None:
            assert r["clean_text"] is None
        else:
            assert r["clean_text"] == "\n".join(x for i, x in enumerate(text.split("\n"), 1) if i not in gone[r["chunk_ord"]])
            assert r["n_removed"] == len(gone[r["chunk_ord"]])


def test_one_document_of_many_rows_counts_once(spark):
    rows = [(i, "w__hot.md", "site line", 0) for i in range(50)] + [(100 + i, f"w__d{i}.md", "other", 0) for i in range(4)]
    assert found_lines(spark.createDataFrame(rows, KIND)).count() == 0
    rows += [(200 + i, f"w__e{i}.md", "Site LINE", 0) for i in range(4)]
    assert found_lines(spark.createDataFrame(rows, KIND)).count() == 54


def test_more_documents_than_one_container(spark):
    df = spark.range(40_000).selectExpr("id as chunk_ord", "concat('w__', id, '.md') as doc_id", "case when id % 9 = 0 then 'common' else concat('l', repeat('x', cast(id as int) % 97)) end as text", "1 as line_no")
    assert found_lines(df).count() == 4445


def test_containers_are_short_or_dense(spark):
    lines, bitmaps = repeated_lines(spark.range(40_000).selectExpr("id as chunk_ord", "concat('w__', id, '.md') as doc_id", "case when id % 5 = 0 then 'common ' || (id % 3) when id < 6000 then 'early' else 'x' || uuid() end as text", "1 as line_no"))
    got = {r["__norm"]: r for r in bitmaps.collect()}
    assert got["common 0"]["__bits"] is not None and got["common 0"]["__numbers"] is None and got["common 0"]["n_docs"] == 8000
    few = bitmaps_of(spark.createDataFrame([("w", "a", True, v, n) for v, n in ((1, 5), (2, 5), (2, 70_000), (1, 9))], "__wiki string, __norm string, __few boolean, __variant bigint, __no bigint"))
    assert sorted((r["__bucket"], list(r["__numbers"]), r["__size"]) for r in few.collect()) == [(0, [5, 9], 2), (2, [70_000 - 65_536], 1)]


def test_many_sources(spark):
    df = spark.range(600_000).selectExpr("id as chunk_ord", "concat('w', id div 6, '__', id, '.md') as doc_id", "case when id % 6 = 5 and id div 6 % 2 = 0 then 'own' else 'line of ' || (id div 6) end as text", "1 as line_no")
    assert found_lines(df).count() == 50_000 * 5 + 50_000 * 6


def test_empty(spark):
    df = spark.createDataFrame([], KIND)
    assert found_lines(df).count() == 0 and without_repeated_lines(df).count() == 0
