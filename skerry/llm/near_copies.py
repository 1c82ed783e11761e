"""Near-duplicate records with small edits (problem 3).

Improved consistent weighted sampling over TF-IDF weighted shingles of three words, banded;
candidates are verified by their weighted Jaccard similarity. Steps, all distributed:

1. Copies. Texts with equal words form a class, named by a hash of their words; everything
   below works on classes, so a text copied over a third of the rows is one class.
2. Document frequencies of all rows, as a count-min sketch of two rows of ``width`` counters
   each. An estimate is never too low, and too high by more than k times the mean load of a
   counter with a probability of at most 1 / k ** 2. Tasks' counters are added up by
   a grouped sum; only the sum, whose size is fixed, is collected and broadcast.
   The same pass gives each row's class.
3. Sketch: ``bands * rows`` consistent weighted samples per class in numpy, whole batches at
   a time; a band's ``rows`` samples are mixed to one number. Classes that several tasks
   met are made one before their bands become rows.
4. Equal band numbers are joined. Nothing stands between the shuffle and the join, so Spark's
   adaptive skew join splits a hot number over tasks; there is no cap on a bucket and no pair is left out.
5. Each candidate pair of classes is verified on its whole texts.

Weights. A shingle weighs its saturated count, 1.2 tf / (tf + 0.2), times 1 plus its share of
the highest inverse document frequency: between 1 and 2.4. The bound matters: plain TF-IDF lets the
shingles of a text that fills a third of the table weigh next to nothing against a small
edit, so that its edited copies would be unlike by weight. With it, sets that overlap by t
have a weighted similarity of at least 1 / (1.2 + 2.4 (1 - t) / t), which ``least_weighted`` gives.

The samples draw their three random variates per shingle and sample from a pool of 16,384
seeded rows, picked by the shingle's hash; a sample's identity stays the full hash and its
step, so two shingles that share a row are never taken for one another.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.session import cut, slices

POOL = 1 << 14
BLOCK = 1024
BATCH = 2048
SATURATION, SPREAD = 0.2, 2.4
LANES, SIEVE = 64, 1 << 25
_U = np.uint64
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(r"[^\W_]+")


class _Hashes(dict):
    """Hashes of words, computed once per worker while they fit."""

    def __missing__(self, word: str) -> int:
        if len(self) > 2_000_000:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return got


_hashes = _Hashes()


def hashed_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, where each text's begin and end): the lower-cased texts' longest runs of letters and digits."""
    flat: list[int] = []
    offsets = [0]
    get = _hashes.__getitem__
    for text in texts:
        if text:
            flat.extend(map(get, _WORD.findall(text.lower())))
        offsets.append(len(flat))
    return np.array(flat, np.uint64), np.array(offsets, np.int64)


def classes_of(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A number for each text, the same for texts with the same words in the same order."""
    n = np.diff(offsets)
    place = np.arange(len(flat)) - np.repeat(offsets[:-1], n)
    total = np.append(_U(0), np.cumsum(_mix(flat + (place.astype(_U) + _U(1)) * _GOLDEN)))
    return _mix(total[offsets[1:]] - total[offsets[:-1]] + n.astype(_U)).view(np.int64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles_of(flat: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle hash, times) of each different shingle, by text."""
    n = np.maximum(np.diff(offsets) - width + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    first = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(offsets[:-1], n)
    value = np.zeros(len(row), np.uint64)
    for i in range(width):
        value = _mix(value * _GOLDEN + flat[first + i])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return row[at], value[at], np.diff(np.append(at, len(row)))


def _pool(samples: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    r = rng.gamma(2.0, 1.0, (POOL, samples)).astype(np.float32)
    c = np.log(rng.gamma(2.0, 1.0, (POOL, samples))).astype(np.float32)
    return r, c, rng.random((POOL, samples)).astype(np.float32)


def sketch(row: np.ndarray, value: np.ndarray, weight: np.ndarray, pool, bands: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have shingles, their band numbers): consistent weighted samples, mixed by band."""
    r, c, beta = pool
    samples = r.shape[1]
    starts = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(row))
    picked = np.empty((len(starts), samples), np.uint64)
    log_w = np.log(weight).astype(np.float32)[:, None]
    place = (value >> _U(40)).astype(np.int64) & (POOL - 1)
    spare = np.empty((4, max(BLOCK, int((ends - starts).max(initial=0))), samples), np.float32)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, "right")))
        a, b = starts[i], ends[j - 1]
        rr, step, shift, key = spare[:, : b - a]
        for table, out in ((r, rr), (beta, shift), (c, key)):
            np.take(table, place[a:b], axis=0, out=out, mode="clip")
        np.divide(log_w[a:b], rr, out=step)
        step += shift
        np.floor(step, out=step)
        np.subtract(step, shift, out=shift)
        shift += 1
        shift *= rr
        key -= shift
        inside = starts[i:j] - a
        least = np.minimum.reduceat(key, inside, axis=0)
        np.take(least, np.repeat(np.arange(j - i), ends[i:j] - starts[i:j]), axis=0, out=rr, mode="clip")
        hit, k = np.nonzero(key == rr)
        owner = np.searchsorted(inside, hit, "right") - 1
        picked[owner + i, k] = _mix(value[a:b][hit] + step[hit, k].astype(np.int64).view(_U) * _GOLDEN)
        i = j
    rows = samples // bands
    numbers = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(starts), 1))
    for k in range(rows):
        numbers = _mix(numbers * _GOLDEN + picked[:, k::rows])
    return row[starts], numbers


def first_pass(rows: DataFrame, width: int, counters: int) -> DataFrame:
    """__key and __class of every row with ``width`` words, and each task's counters, packed."""
    names = ["__key", "__class", "__rows", "__counts"]
    kind = rows.schema[0].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros((2, counters), np.int64), 0
        key_type = None
        for batch in batches:
            for part in slices(batch, 1, BATCH):
                flat, offsets = hashed_words(part.column(1).to_pylist())
                key_type = part.column(0).type
                long = np.flatnonzero(np.diff(offsets) >= width)
                n += len(long)
                _, value, _ = shingles_of(flat, offsets, width)
                for i, slot in enumerate(slots(value, counters)):
                    counts[i] += np.bincount(slot, minlength=counters)
                keys = part.column(0).take(pa.array(long))
                yield pa.RecordBatch.from_arrays([keys, pa.array(classes_of(flat, offsets)[long]), pa.nulls(len(long), pa.int64()), pa.nulls(len(long), pa.binary())], names=names)
        if key_type is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, key_type), pa.nulls(1, pa.int64()), pa.array([n]), pa.array([zlib.compress(counts.tobytes(), 1)], pa.binary())], names=names)

    return rows.mapInArrow(run, f"__key {kind.simpleString()}, __class bigint, __rows bigint, __counts binary")


def slots(value: np.ndarray, counters: int) -> tuple[np.ndarray, np.ndarray]:
    """The counter of each shingle in either row of the sketch."""
    other = _mix(value + _GOLDEN)
    return (value & _U(counters - 1)).astype(np.int64), (other & _U(counters - 1)).astype(np.int64)


class Weights:
    """Weights of shingles by their estimated document frequencies."""

    def __init__(self, counts: np.ndarray, n: int):
        self.counters = counts.shape[1]
        floor = counts[0].sum() / self.counters  # frequencies below a counter's mean load can't be told apart
        most = max(np.log((n + 1) / (floor + 1)), 1e-9)
        share = np.log((n + 1) / (np.maximum(counts, floor) + 1)) / most
        self.idf = (1 + np.clip(share, 0, 1)).astype(np.float32)

    def of(self, value: np.ndarray, times: np.ndarray) -> np.ndarray:
        one, two = slots(value, self.counters)
        # the lower count has the higher weight
        return np.maximum(self.idf[0, one], self.idf[1, two]) * ((1 + SATURATION) * times / (times + SATURATION)).astype(np.float32)


def least_weighted(overlap: float) -> float:
    """The least weighted similarity that sets of that overlap can have."""
    return 1 / (1 + SATURATION + SPREAD * (1 - overlap) / overlap)


def weights_of(first: DataFrame, counters: int) -> Weights:
    """The tasks' counters, added up by a grouped sum with map-side combining; 2 * ``counters`` numbers are collected."""

    names = [f"c{i}" for i in range(LANES)]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                counts = np.frombuffer(zlib.decompress(packed), np.int64).reshape(-1, LANES)
                at = np.flatnonzero(counts.any(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(x) for x in counts[at].T)], names=["__block", *names])

    packed = first.filter("__counts is not null")
    n = packed.agg(F.sum("__rows")).first()[0] or 0
    rows = packed.select("__counts").mapInArrow(unpack, "__block int, " + ", ".join(f"{c} bigint" for c in names))
    got = rows.groupBy("__block").agg(*(F.sum(c).alias(c) for c in names)).toArrow()
    counts = np.zeros((2 * counters // LANES, LANES), np.int64)
    counts[got.column(0).to_numpy()] = np.stack([got.column(1 + i).to_numpy() for i in range(LANES)], axis=1)
    return Weights(counts.reshape(2, counters), n)


def sketches(rows: DataFrame, shared, width: int, bands: int, per_band: int, seed: int) -> DataFrame:
    """__class, __n (different shingles) and __bands of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool, known, weights = _pool(bands * per_band, seed), set(), shared.value
        for batch in batches:
            for part in slices(batch, 1, BATCH):
                flat, offsets = hashed_words(part.column(1).to_pylist())
                classes = classes_of(flat, offsets)
                new = []
                for i in np.flatnonzero(np.diff(offsets) >= width).tolist():
                    if classes[i] not in known:
                        known.add(classes[i])
                        new.append(i)
                if len(known) > 1_000_000:  # a class that is sketched again falls away in the next step
                    known.clear()
                if not new:
                    continue
                owner, value, times = shingles_of(flat, offsets, width)
                wanted = np.zeros(len(classes), bool)
                wanted[new] = True
                owner, value, times = (x[wanted[owner]] for x in (owner, value, times))
                at, numbers = sketch(owner, value, weights.of(value, times), pool, bands)
                sizes = np.bincount(owner, minlength=len(classes)).astype(np.int32)
                packed = pa.ListArray.from_arrays(pa.array(np.arange(0, numbers.size + 1, bands, dtype=np.int32)), pa.array(numbers.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(classes[at]), pa.array(sizes[at]), packed], names=["__class", "__n", "__bands"])

    return rows.mapInArrow(run, "__class bigint, __n int, __bands array<bigint>").dropDuplicates(["__class"])


def sieved(rows: DataFrame, wanted: DataFrame, key: str, bits: int = SIEVE) -> DataFrame:
    """``rows`` without most of those whose ``key`` isn't in ``wanted``: a bitmap of ``bits`` hashes, a fixed size, is broadcast.

    It only spares a shuffle of rows that a join drops anyway. When it is full, it spares nothing.
    """
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    words = wanted.select(place.alias("__p")).groupBy(F.floor(F.col("__p") / 32).cast("int").alias("__w")).agg(F.expr("bit_or(shiftleft(1L, cast(__p % 32 as int)))").alias("__b")).toArrow()
    bitmap = np.zeros(bits // 32, np.uint32)
    bitmap[words.column(0).to_numpy()] = words.column(1).to_numpy().astype(np.uint32)
    shared = rows.sparkSession.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def kept(p: pd.Series) -> pd.Series:
        at = p.to_numpy()
        return pd.Series((shared.value[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1)

    return rows.filter(kept(place))


def candidate_pairs(sketched: DataFrame, alike: float, bands: int, parts: int = 2) -> DataFrame:
    """__a, __b: different classes that share a band number, each pair once.

    Sets of which the smaller has less than ``alike`` of the greater are no pair. Bands are joined in ``parts``
    joins, for a number is equal to one of its own band only: a task then has that part of what it would have in one join.
    """
    near = F.least("__n_a", "__n_b") >= F.greatest("__n_a", "__n_b") * alike - 1e-6
    each, found = -(-bands // parts), []
    for begin in range(0, bands, each):
        numbers = sketched.select(F.explode(F.slice("__bands", begin + 1, each)).alias("__band"), "__class", "__n")
        left = numbers.select("__band", F.col("__class").alias("__a"), F.col("__n").alias("__n_a"))
        right = numbers.select("__band", F.col("__class").alias("__b"), F.col("__n").alias("__n_b"))
        found.append(left.join(right, "__band").filter((F.col("__a") < F.col("__b")) & near).select("__a", "__b"))
    return reduce(DataFrame.unionByName, found).distinct()


def similarities(pairs: DataFrame, shared, width: int) -> DataFrame:
    """Of __a, __b, __text_a, __text_b: __a, __b, __similarity (weighted Jaccard) and __overlap (of the sets of shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, BATCH):
                sides = [shingles_of(*hashed_words(part.column(i).to_pylist()), width) for i in (2, 3)]
                row, value, times = (np.concatenate(x) for x in zip(*sides, strict=True))
                weight = shared.value.of(value, times).astype(np.float64)
                order = np.lexsort((value, row))
                row, value, weight = row[order], value[order], weight[order]
                same = (row[1:] == row[:-1]) & (value[1:] == value[:-1])
                n = part.num_rows
                common = np.bincount(row[1:][same], minlength=n)
                total = np.bincount(row, minlength=n) - common
                least = np.bincount(row[1:][same], np.minimum(weight[1:], weight[:-1])[same], n)
                most = np.bincount(row, weight, n) - least
                columns = [part.column(0), part.column(1), pa.array(least / np.maximum(most, 1e-300)), pa.array(common / np.maximum(total, 1))]
                yield pa.RecordBatch.from_arrays(columns, names=["__a", "__b", "__similarity", "__overlap"])

    return pairs.select("__a", "__b", "__text_a", "__text_b").mapInArrow(run, "__a bigint, __b bigint, __similarity double, __overlap double")


def near_copies(
    df: DataFrame, key: str = "chunk_ord", text: str = "text", threshold: float = 0.7, width: int = 3,
    bands: int = 24, per_band: int = 4, counters: int = 1 << 17, seed: int = 7, by: str = "similarity",
) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): verified pairs of classes and every row's class.

    ``pairs`` has class_a, class_b (a < b), similarity (weighted Jaccard) and overlap (of the
    sets of shingles); the one that ``by`` names is at least ``threshold``. ``members``
    has ``key`` and class of every row with at least ``width`` words. Rows of one class have
    equal words and so similarity 1. Null, empty and shorter texts and rows without a key are
    in no class; an empty table gives two empty tables; other columns of ``df`` are left out.
    """
    if by not in ("similarity", "overlap"):
        raise ValueError("by is similarity or overlap")
    rows = df.select(F.col(key).alias("__key"), F.col(text).alias("__text")).filter("__key is not null and __text is not null")
    first = cut(first_pass(rows, width, counters))
    members = first.filter("__class is not null").select("__key", "__class")
    shared = df.sparkSession.sparkContext.broadcast(weights_of(first, counters))
    sketched = sketches(rows, shared, width, bands, per_band, seed)
    pairs = cut(candidate_pairs(sketched, threshold if by == "overlap" else threshold / SPREAD, bands))
    involved = pairs.select(F.explode(F.array("__a", "__b")).alias("__class")).distinct()
    speaker = cut(members.groupBy("__class").agg(F.min("__key").alias("__key")).join(involved, "__class", "left_semi"))
    texts = cut(sieved(rows, speaker, "__key").join(speaker, "__key").select("__class", "__text").dropDuplicates(["__class"]))
    both = pairs.join(texts.select(F.col("__class").alias("__a"), F.col("__text").alias("__text_a")), "__a")
    both = both.join(texts.select(F.col("__class").alias("__b"), F.col("__text").alias("__text_b")), "__b")
    found = similarities(both, shared, width)
    if by == "overlap":  # by the bound on the weights, the first condition drops no such pair
        found = found.filter((F.col("__similarity") >= least_weighted(threshold) - 1e-9) & (F.col("__overlap") >= threshold))
    else:
        found = found.filter(F.col("__similarity") >= threshold)
    found = cut(found.select(F.col("__a").alias("class_a"), F.col("__b").alias("class_b"), F.col("__similarity").alias("similarity"), F.col("__overlap").alias("overlap")))
    return (
        found,
        members.select(F.col("__key").alias(key), F.col("__class").alias("class")),
    )


def row_pairs(pairs: DataFrame, members: DataFrame, key: str = "chunk_ord", block: int = 4096) -> DataFrame:
    """key_a, key_b (a < b) of every pair of rows: of verified pairs of classes, and within a class.

    The rows of a class of more than ``block`` rows are spread over salts, and a pair of
    classes over the pairs of their salts, so that a class of a third of all rows is many
    small joins.
    """
    linked = pairs.select(F.explode(F.array("class_a", "class_b")).alias("class")).distinct().withColumn("__linked", F.lit(True))
    sizes = members.groupBy("class").agg(F.count("*").alias("__n")).join(linked, "class", "left").filter("__n > 1 or __linked")
    sizes = cut(sizes.select("class", F.ceil(F.col("__n") / block).cast("int").alias("__salts"), "__n"))
    salted = members.join(sizes, "class").select("class", F.col(key).alias("__key"), F.expr("pmod(xxhash64(__key), __salts)").cast("int").alias("__salt"))
    one, two = (sizes.select(F.col("class").alias(f"class_{x}"), F.col("__salts").alias(f"__salts_{x}")) for x in "ab")
    within = sizes.filter("__n > 1").select(F.col("class").alias("class_a"), F.col("class").alias("class_b"))
    units = pairs.select("class_a", "class_b").unionByName(within).join(one, "class_a").join(two, "class_b")
    cells = units.withColumn("__salt_a", F.explode(F.sequence(F.lit(0), F.col("__salts_a") - 1)))
    cells = cells.withColumn("__salt_b", F.explode(F.sequence(F.lit(0), F.col("__salts_b") - 1))).select("class_a", "__salt_a", "class_b", "__salt_b")
    left, right = (salted.select(F.col("class").alias(f"class_{x}"), F.col("__salt").alias(f"__salt_{x}"), F.col("__key").alias(f"__{x}")) for x in "ab")
    met = cells.join(left, ["class_a", "__salt_a"]).join(right, ["class_b", "__salt_b"])
    met = met.filter("class_a <> class_b or __a < __b")
    return met.select(F.least("__a", "__b").alias(f"{key}_a"), F.greatest("__a", "__b").alias(f"{key}_b"))


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """node, root (the least node it is connected with) of an edge table __a, __b.

    Large-star and small-star steps by turns, each a grouped minimum and a join, until
    nothing changes; every round's edges go to the shared checkpoint folder. The number of
    rounds grows as the logarithm of the longest chain; ``rounds`` only guards the loop.
    """
    edges = cut(edges.select("__a", "__b").filter("__a <> __b").distinct())
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("__b").alias("__a"), F.col("__a").alias("__b")))
        least = both.groupBy("__a").agg(F.least(F.min("__b"), F.col("__a")).alias("__m"))
        large = both.join(least, "__a").filter("__b > __a").select(F.col("__b").alias("__a"), F.col("__m").alias("__b"))
        large = large.filter("__a <> __b").distinct()
        down = large.select(F.greatest("__a", "__b").alias("__a"), F.least("__a", "__b").alias("__b"))
        least = down.groupBy("__a").agg(F.min("__b").alias("__m"))
        small = down.join(least, "__a").select(F.col("__b").alias("__x"), F.col("__m").alias("__b"))
        small = small.select(F.col("__x").alias("__a"), "__b").unionByName(least.select("__a", F.col("__m").alias("__b")))
        edges = cut(small.filter("__a <> __b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("__a", "__b") % 1_000_003)).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    return edges.groupBy("__a").agg(F.min("__b").alias("root")).withColumnRenamed("__a", "node")


def near_copy_groups(df: DataFrame, key: str = "chunk_ord", text: str = "text", **options) -> DataFrame:
    """``key``, group (the least class of its group), n_links (other classes it is linked with) and n_copies
    (rows with equal words) of every row of a class; alone in their group are rows without a link.
    """
    pairs, members = near_copies(df, key, text, **options)
    roots = components(pairs.select(F.col("class_a").alias("__a"), F.col("class_b").alias("__b")))
    links = pairs.select(F.explode(F.array("class_a", "class_b")).alias("class")).groupBy("class").agg(F.count("*").alias("n_links"))
    copies = members.groupBy("class").agg(F.count("*").alias("n_copies"))
    classes = copies.join(links, "class", "left").join(roots.withColumnRenamed("node", "class"), "class", "left")
    classes = classes.select("class", F.coalesce("root", "class").alias("group"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    return members.join(classes, "class").select(key, "group", "n_links", "n_copies")
