import random
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

import numpy as np

from skerry.llm.pack import _Sums, fill_containers, fill_report, pack_items, plan


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 200), max_size=30))
def test_plan_places_every_item_once(histogram):
    placed = Counter()
    for what, m in plan(histogram, 60):
        assert m > 0 and sum(s * k for s, k in what) <= 60
        for s, k in what:
            placed[s] += k * m
    assert placed == Counter(histogram)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=31, max_size=31), st.lists(st.tuples(st.integers(1, 30), st.integers(1, 30)), max_size=12))
def test_sums_are_found_while_sizes_run_out(counts, steps):
    avail = np.array(counts, np.int64)
    avail[0] = 0
    sums = _Sums(avail)
    for total, gone in steps:
        got = sums.complement(total)
        sets = [c for n in (1, 2, 3) for c in _multisets(total, n) if all(avail[x] >= k for x, k in Counter(c).items())]
        assert (got is None) == (not sets)
        if got is not None:
            assert sum(got) == total and len(got) == min(map(len, sets)) and all(avail[x] >= k for x, k in Counter(got).items())
        avail[gone] = max(0, avail[gone] - 1)


def _multisets(total, n, most=30):
    if n == 1:
        return [(total,)] if 1 <= total <= most else []
    return [(x, *rest) for x in range(1, min(most, total - n + 1) + 1) for rest in _multisets(total - x, n - 1, x)]


def test_plan_is_near_the_bound():
    rng = random.Random(3)
    sizes = Counter(min(2048, int(rng.lognormvariate(5, 1)) + 1) for _ in range(20_000))
    n = sum(m for _, m in plan(sizes, 2048))
    assert n <= -(-sum(s * c for s, c in sizes.items()) // 2048) + 1
    assert sum(m for _, m in plan({1025: 10}, 2048)) == 10 and sum(m for _, m in plan({700: 4, 600: 2, 748: 4}, 2048)) == 4


def test_items_and_containers(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, 0, 3, 50, 50, 70, 100, 230, 1]), "x") for i in range(700)] + [(5, 50, "again")]
    placed = pack_items(spark.createDataFrame(rows, "doc_id bigint, n int, container string"), "doc_id", "n", 100).collect()
    total = Counter()
    for r in placed:
        total[r["doc_id"]] += r["n_tokens"]
    assert sum(total.values()) == sum(n or 0 for _, n, _ in rows) and set(total) == set(range(700))
    spans = defaultdict(list)
    for r in placed:
        assert r["n_tokens"] <= 100 and r["token_start"] == 100 * r["piece_no"]
        if r["n_tokens"]:
            spans[r["container"]].append((r["container_offset"], r["container_offset"] + r["n_tokens"]))
    for items in spans.values():
        items.sort()
        assert items[0][0] == 0 and all(a[1] == b[0] for a, b in zip(items, items[1:], strict=False)) and items[-1][1] <= 100
    assert sorted(spans) == list(range(len(spans)))
    assert sum(1 for r in placed if r["doc_id"] not in (5,) and r["piece_no"] > 0) == 2 * sum(n == 230 for _, n, _ in rows)


def test_documents(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, None), (3, ""), (4, "word " * 9000)], "doc_id bigint, text string")
    placed = fill_containers(df)
    assert placed.count() == 3 + -(-9001 // 2048)
    report = fill_report(placed, 2048).first()
    assert report["n_containers"] == report["least_containers"] == 5 and report["n_unused"] == 5 * 2048 - report["n_tokens"]
    assert fill_containers(df.limit(0)).count() == 0 and fill_report(fill_containers(df.limit(0)), 2048).first()["n_containers"] == 0
