"""Filling of fixed-capacity containers (problem 7).

Items differ for packing only by their size, an integer from 1 to the capacity, so the plan
is made on the histogram of sizes, which has at most ``capacity`` numbers however large the
corpus. Exact-complement hashing: for each size, largest first, the gap that it leaves is
looked up among single sizes and in the hashed sums of pairs and of triples that are still available;
a combination that fills the gap exactly is consumed as often as the counts allow. What
finds no exact complement goes by best fit, largest first, again many at a time.

A plan's line says that ``k`` items of a size go into each of ``m`` containers. Items are
numbered within their size by counts per size and salt, without a sort of a whole size in
one task, and each looks up its container by its number.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.tokens import encode_texts
from skerry.session import cut


class _Sums:
    """Sums of pairs and triples of available sizes, hashed by the sum; what has run out leaves its lists for good.

    A sum's list is made when it is first asked for. Availability only falls, so a list only shrinks.
    """

    def __init__(self, avail: np.ndarray):
        self.avail = avail
        self.pairs: dict[int, list[int]] = {}
        self.triples: dict[int, list[int]] = {}

    def pair(self, total: int, also: int = 0) -> tuple[int, int] | None:
        """Two sizes that make ``total``, the larger as large as can be, while one of size ``also`` is in use."""
        lows = self.pairs.get(total)
        if lows is None:
            low = np.arange(1, total // 2 + 1)
            lows = self.pairs[total] = low[(self.avail[low] > 0) & (self.avail[total - low] > 0)][::-1].tolist()
        for i in range(len(lows) - 1, -1, -1):
            low, high = lows[i], total - lows[i]
            same = low == high
            if self.avail[low] < 1 + same or self.avail[high] < 1:
                del lows[i]
            elif self.avail[low] >= 1 + same + (low == also) and self.avail[high] >= 1 + same + (high == also):
                return high, low
        return None

    def triple(self, total: int) -> tuple[int, int, int] | None:
        """Three sizes that make ``total``, the largest as large as can be."""
        tops = self.triples.get(total)
        if tops is None:
            top = np.arange(-(-total // 3), max(total - 1, 0))
            tops = self.triples[total] = top[self.avail[top] > 0].tolist()
        for i in range(len(tops) - 1, -1, -1):
            top = tops[i]
            if self.avail[top] > 0 and (found := self.pair(total - top, top)) is not None:
                return (top, *found)
            if self.avail[top] < 1 or not self.pairs[total - top]:
                del tops[i]
        return None

    def complement(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three available sizes whose sum is ``gap``, larger ones first."""
        return (gap,) if self.avail[gap] > 0 else self.pair(gap) or self.triple(gap)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """[(((size, k), ...), m), ...]: m containers that each hold k items of every size named."""
    avail = np.zeros(capacity + 1, np.int64)
    for size, n in histogram.items():
        if not 1 <= size <= capacity:
            raise ValueError("sizes must be between 1 and the capacity")
        avail[size] += n
    done: list[tuple[tuple[tuple[int, int], ...], int]] = []
    left: dict[int, int] = {}
    sums = _Sums(avail)
    if avail[capacity]:
        done.append((((capacity, 1),), int(avail[capacity])))
        avail[capacity] = 0
    for size in range(capacity - 1, 0, -1):
        while avail[size] > 0:
            avail[size] -= 1
            others = sums.complement(capacity - size)
            avail[size] += 1
            if others is None:
                left[size], avail[size] = int(avail[size]), 0
                break
            need = Counter((size, *others))
            m = min(int(avail[x]) // k for x, k in need.items())
            done.append((tuple(sorted(need.items(), reverse=True)), m))
            for x, k in need.items():
                avail[x] -= k * m
    return done + _best_fit(left, capacity)


def _best_fit(left: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    rooms: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}
    free = np.zeros(capacity + 1, bool)

    def put(gap: int, what: tuple[tuple[int, int], ...], m: int) -> None:
        if m:
            rooms.setdefault(gap, []).append((what, m))
            free[gap] = True

    for size in sorted(left, reverse=True):
        n = left[size]
        while n:
            at = np.flatnonzero(free[size:])
            if not len(at):
                k = capacity // size
                put(capacity - k * size, ((size, k),), n // k)
                put(capacity - n % k * size, ((size, n % k),), int(n % k > 0))
                break
            gap = size + int(at[0])
            what, m = rooms[gap].pop()
            free[gap] = bool(rooms[gap])
            k = min(gap // size, n)  # as many as fit into each
            used = min(m, n // k)
            put(gap, what, m - used)
            put(gap - k * size, (*what, (size, k)), used)
            n -= k * used
    return [x for kinds in rooms.values() for x in kinds]


def _lookup(lines: list[tuple[tuple[tuple[int, int], ...], int]], capacity: int) -> dict[str, np.ndarray]:
    """By size and first number: first container, k, offset within the container."""
    base, taken, out = 0, np.zeros(capacity + 1, np.int64), []
    for what, m in lines:
        offset = 0
        for size, k in what:
            out.append((size, int(taken[size]), base, k, offset))
            taken[size] += k * m
            offset += size * k
        base += m
    names = ("size", "first", "base", "k", "offset")
    columns = np.array(sorted(out), np.int64).reshape(-1, 5).T
    return dict(zip(names, columns, strict=True))


def fill_containers(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 2048, path: str | None = None, salts: int = 64) -> DataFrame:
    """``key``, piece_no, token_start, n_tokens, container, container_offset of every item.

    An item longer than ``capacity`` is cut into full pieces and a rest; no other is cut. A
    null or empty text has no tokens, takes no room and is assigned to container 0. Repeated
    rows are items of their own; rows with equal keys are interchangeable. An empty table gives no rows.
    """
    lengths = encode_texts(df, key, text, path, counts_only=True)
    return pack_items(lengths, key, "n_tokens", capacity, salts)


def pack_items(df: DataFrame, key: str, size: str, capacity: int, salts: int = 64) -> DataFrame:
    """As ``fill_containers``, for items whose integer size is in a column (null counts as 0)."""
    items = df.select(F.col(key).alias("__key"), F.greatest(F.lit(0), F.coalesce(F.col(size), F.lit(0))).cast("bigint").alias("__n"))
    last = F.greatest(F.lit(0), F.ceil(F.col("__n") / capacity) - 1).cast("bigint")
    pieces = cut(
        items.select("__key", "__n", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("__piece"))
        .select("__key", "__piece", F.least(F.lit(capacity).cast("bigint"), F.col("__n") - F.col("__piece") * capacity).alias("__size"))
        .withColumn("__salt", F.pmod(F.xxhash64("__key", "__piece"), F.lit(salts)))
    )
    counts = pieces.groupBy("__size", "__salt").agg(F.count("*").alias("__m"))  # at most capacity times salts rows
    histogram = {r["__size"]: r["__m"] for r in counts.groupBy("__size").agg(F.sum("__m").alias("__m")).collect() if r["__size"] > 0}
    lookup = _lookup(plan(histogram, capacity), capacity)
    before = F.expr("coalesce(sum(__m) over (partition by __size order by __salt rows between unbounded preceding and 1 preceding), 0)")
    offsets = counts.select("__size", "__salt", before.alias("__before"))
    place = F.expr("row_number() over (partition by __size, __salt order by __key, __piece)")
    numbered = pieces.withColumn("__place", place).join(F.broadcast(offsets), ["__size", "__salt"])
    numbered = numbered.select("__key", "__piece", "__size", (F.col("__before") + F.col("__place") - 1).alias("__number"))
    shared = df.sparkSession.sparkContext.broadcast(lookup)  # bounded by the capacity, not by the items
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        stride = np.int64(1) << 48
        order = table["size"] * stride + table["first"]
        for batch in batches:
            sizes, number = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            container, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            some = np.flatnonzero(sizes > 0)
            at = np.searchsorted(order, sizes[some] * stride + number[some], "right") - 1
            inner = number[some] - table["first"][at]
            container[some] = table["base"][at] + inner // table["k"][at]
            offset[some] = table["offset"][at] + inner % table["k"][at] * sizes[some]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(batch.column(1).to_numpy() * capacity), batch.column(2), pa.array(container), pa.array(offset)],
                names=["key", "piece_no", "token_start", "n_tokens", "container", "container_offset"],
            )

    placed = numbered.mapInArrow(run, f"key {kind}, piece_no bigint, token_start bigint, n_tokens bigint, container bigint, container_offset bigint")
    return placed.withColumnRenamed("key", key)


def fill_report(placed: DataFrame, capacity: int) -> DataFrame:
    """One row: n_items, n_tokens, n_containers, least_containers (no packing needs fewer), n_unused."""
    filled = placed.filter("n_tokens > 0")
    one = filled.agg(
        F.count("*").alias("n_items"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"),
        F.coalesce(F.max("container") + 1, F.lit(0).cast("bigint")).alias("n_containers"),
    )
    least = F.ceil(F.col("n_tokens") / capacity).cast("bigint")
    return one.select("n_items", "n_tokens", "n_containers", least.alias("least_containers"), (F.col("n_containers") * capacity - F.col("n_tokens")).alias("n_unused"))
