"""Search of many queries at once over all chunks: dense, lexical and fused scores, top k, cap per document.

Texts are read once, when the index is made: a row of the index packs up to 1,024 chunks with
their vectors and postings (term, chunk, count) as arrays, so a search never sees a text. A
search needs the scores of all pairs for the fusion's minima and maxima, but they never become
rows: each task multiplies its blocks with a block of queries as matrices and gives each query's
extremes, then in a second pass its own best ``pool`` chunks. Terms that many queries and
chunks share are columns of those matrices, rare ones are added up pair by pair. What is shuffled is bounded
by tasks times queries times pool. Queries are taken in blocks of ``block`` rows, which
bounds what is broadcast; chunks are never collected.
"""

from __future__ import annotations

import copy
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from skerry.operators.lexical import K1, B
from skerry.session import cut

BLOCK = 2048
ROWS = 1024
#: From so many pairs of query and chunk on, a term is a column of a matrix.
COMMON = 20_000
_TERM = re.compile(r"[a-z0-9]+(?:'[a-z0-9]+)?")


def pool_size(k: int, per_doc: int) -> int:
    return max(4 * k, k + 10) if per_doc > 0 else k


class _Terms(dict):
    """Hashes of terms, computed once per worker while they fit."""

    def __missing__(self, term: str) -> int:
        if len(self) > 2_000_000:
            self.clear()
        got = self[term] = xxhash.xxh3_64_intdigest(term.encode()) - (1 << 63)
        return got


_terms = _Terms()


def term_counts(text: str | None) -> tuple[int, Counter]:
    """(number of terms, times of each term's hash) of a text; a null text has none."""
    found = _TERM.findall(text.lower()) if text else []
    return len(found), Counter(map(_terms.__getitem__, found))


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; those of zeros stay zeros."""
    out = vectors.astype(np.float64)
    length = np.sqrt((out * out).sum(axis=1))
    return out / np.where(length == 0, 1.0, length)[:, None]


@dataclass(frozen=True)
class SearchIndex:
    """``blocks`` of chunks: keys, docs, dims and vectors (end to end), and for lexical search dl, terms, starts, at and tf."""

    blocks: DataFrame
    with_words: bool = True

    def statistics(self, terms: np.ndarray) -> tuple[np.ndarray, int, float]:
        """(document frequency of each of some sorted terms, number of chunks, mean length), in one pass."""
        shared = self.blocks.sparkSession.sparkContext.broadcast(terms)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wanted = shared.value
            out = np.zeros(len(wanted) + 2, np.int64)  # the last two are chunks and their lengths
            for batch in batches:
                for i in range(batch.num_rows):
                    there, starts, dl = (batch.column(j)[i].values.to_numpy(zero_copy_only=False) for j in range(3))
                    at, mine = _found(wanted, there)
                    out[at] += np.diff(starts)[mine]
                    out[-2:] += len(dl), dl.sum(dtype=np.int64)
            some = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(out[some])], names=["i", "n"])

        got = self.blocks.select("terms", "starts", "dl").mapInArrow(count, "i bigint, n bigint").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
        out = np.zeros(len(terms) + 2, np.int64)
        out[got.column(0).to_numpy()] = got.column(1).to_numpy()
        return out[:-2], int(out[-2]), float(out[-1] / out[-2]) if out[-2] else 0.0


def _found(wanted: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``wanted``, place in ``terms``) of the terms in both; both are sorted."""
    if not len(wanted):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(wanted, terms), len(wanted) - 1)
    there = np.flatnonzero(wanted[at] == terms)
    return at[there], there


def build_index(chunks: DataFrame, key: str = "chunk_ord", doc: str = "doc_id", text: str | None = "text", vector: str | None = "embedding") -> SearchIndex:
    """The index of a chunk table in one pass, without a shuffle; without ``text`` only for dense, without ``vector`` only for lexical search."""
    columns = [F.col(key).cast("bigint").alias("keys"), F.col(doc).alias("docs"), (F.col(vector) if vector else F.lit(None)).cast("array<float>").alias("v"), (F.col(text) if text else F.lit(None)).cast("string").alias("t")]
    rows = chunks.select(*columns)
    kind = rows.schema["docs"].dataType

    def pack(keys: list, docs: list, vectors: list, texts: list) -> list:
        dims = np.fromiter((0 if v is None else len(v) for v in vectors), np.int32, len(keys))
        flat = np.array([0.0 if x is None else x for v in vectors if v is not None for x in v], np.float32)
        dl, term, at, tf = [], [], [], []
        for i, value in enumerate(texts):
            n, counts = term_counts(value)
            dl.append(n)
            term.extend(counts)
            at.extend([i] * len(counts))
            tf.extend(counts.values())
        term, at, tf = np.array(term, np.int64), np.array(at, np.int16), np.array(tf, np.int32)
        order = np.argsort(term, kind="stable")
        unique, starts = np.unique(term[order], return_index=True)
        return [keys, docs, dims, flat, np.array(dl, np.int32), unique, np.append(starts, len(term)).astype(np.int32), at[order], tf[order]]

    doc_type = to_arrow_type(kind)
    types = [pa.int64(), doc_type, pa.int32(), pa.float32(), pa.int32(), pa.int64(), pa.int32(), pa.int16(), pa.int32()]
    names = ["keys", "docs", "dims", "vectors", "dl", "terms", "starts", "at", "tf"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], []]

        def out(n: int) -> pa.RecordBatch:
            block = pack(*(x[:n] for x in held))
            for x in held:
                del x[:n]
            return pa.RecordBatch.from_arrays([pa.array([v], pa.list_(t)) for v, t in zip(block, types, strict=True)], names=names)

        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                for x, column in zip(held, batch.slice(begin, ROWS).columns, strict=True):
                    x.extend(column.to_pylist())
                while len(held[0]) >= ROWS:
                    yield out(ROWS)
        if held[0]:
            yield out(ROWS)

    schema = f"keys array<bigint>, docs array<{kind.simpleString()}>, dims array<int>, vectors array<float>, dl array<int>, terms array<bigint>, starts array<int>, at array<smallint>, tf array<int>"
    return SearchIndex(rows.mapInArrow(run, schema), text is not None)


class _Queries:
    """A block of queries: unit vectors by dimension and weighted terms."""

    def __init__(self, ids: list, vectors: list, texts: list[str | None]):
        self.ids, n = ids, len(ids)
        sizes = np.fromiter((0 if v is None else len(v) for v in vectors), np.int64, n)
        self.by_dim = {int(d): (at := np.flatnonzero(sizes == d), unit_rows(np.array([[x or 0.0 for x in vectors[i]] for i in at]))) for d in np.unique(sizes[sizes > 0])}
        who, what, times = [], [], []
        for i, text in enumerate(texts):
            for term, m in term_counts(text)[1].items():
                who.append(i)
                what.append(term)
                times.append(m)
        self._ask(who, what, times)

    @classmethod
    def of_terms(cls, ids: list, who: np.ndarray, what: np.ndarray, times: list[int]) -> _Queries:
        """Queries without vectors, whose terms are given: query ``who`` has term ``what`` so many times."""
        out = cls(ids, [None] * len(ids), [None] * len(ids))
        out._ask(who, what, times)
        return out

    def _ask(self, who: list | np.ndarray, what: list | np.ndarray, times: list[int]) -> None:
        self.terms, what = np.unique(np.array(what, np.int64), return_inverse=True)
        order = np.argsort(what, kind="stable")
        self.who, self.times = np.array(who, np.int64)[order], np.array(times, float)[order]
        self.starts = np.searchsorted(what[order], np.arange(len(self.terms) + 1))

    def weigh(self, df: np.ndarray, n: int, avgdl: float) -> None:
        self.avgdl = avgdl or 1.0
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5)) * (K1 + 1) * (df > 0)
        self.weight = self.times * np.repeat(idf, np.diff(self.starts))

    def fused(self, limits: np.ndarray, alpha: float) -> tuple[_Queries, np.ndarray]:
        """Queries whose dense and lexical scores add up, with the number given for each query, to the fused ones."""
        shares = []
        for share, low, high in ((alpha, limits[0], limits[2]), (1 - alpha, limits[1], limits[3])):
            flat = high - low < 1e-12
            shares.append(np.where(flat, 0.0, share / np.where(flat, 1.0, high - low)))
        out = copy.copy(self)
        out.by_dim = {dim: (mine, matrix * shares[0][mine, None]) for dim, (mine, matrix) in self.by_dim.items()}
        out.weight = self.weight * shares[1][self.who]
        return out, -(shares[0] * limits[0] + shares[1] * limits[1])

    def dense(self, dims: np.ndarray, flat: np.ndarray) -> np.ndarray:
        """Cosines; 0 where a vector is missing or of another dimension than the query's."""
        out = np.zeros((len(self.ids), len(dims)))
        ends = np.cumsum(dims)
        for dim, (mine, matrix) in self.by_dim.items():
            at = np.flatnonzero(dims == dim)
            if len(at):
                scores = matrix @ unit_rows(flat[(ends[at] - dim)[:, None] + np.arange(dim)]).T
                if len(mine) == len(self.ids) and len(at) == len(dims):
                    return scores
                out[np.ix_(mine, at)] = scores
        return out

    def lexical(self, dl: np.ndarray, terms: np.ndarray, starts: np.ndarray, at: np.ndarray, tf: np.ndarray) -> np.ndarray:
        q, c = len(self.ids), len(dl)
        mine, there = _found(self.terms, terms)
        chunks, asked = (starts[there + 1] - starts[there]).astype(np.int64), self.starts[mine + 1] - self.starts[mine]

        def postings(some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """(place in ``some``, chunk, saturated count) of the postings of some terms."""
            n = chunks[some]
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[there[some]].astype(np.int64), n)
            chunk, times = at[place].astype(np.int64), tf[place].astype(float)
            return np.repeat(np.arange(len(some)), n), chunk, times / (times + K1 * (1 - B + B * dl[chunk] / self.avgdl))

        often = chunks * asked >= COMMON
        common, rare = np.flatnonzero(often), np.flatnonzero(~often)
        term, chunk, part = postings(rare)
        n = asked[rare][term]
        query = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.starts[mine[rare]][term], n)
        cell = self.who[query] * c + np.repeat(chunk, n)
        out = np.bincount(cell, np.repeat(part, n) * self.weight[query], q * c).reshape(q, c)
        if len(common):
            term, chunk, part = postings(common)
            right = np.zeros((len(common), c))
            right[term, chunk] = part
            left = np.zeros((q, len(common)))
            for i, t in enumerate(mine[common]):
                span = slice(self.starts[t], self.starts[t + 1])
                left[self.who[span], i] = self.weight[span]
            out += left @ right
        return out


def _scaled(x: np.ndarray) -> np.ndarray:
    span = x.max() - x.min()
    return (x - x.min()) / span if span >= 1e-12 else np.zeros_like(x)


class _Best:
    """Each query's best ``pool`` chunks so far; ties go to the lower key."""

    def __init__(self, n: int, pool: int):
        self.pool = pool
        self.score, self.key, self.doc = np.full((n, pool), -np.inf), np.zeros((n, pool), np.int64), np.zeros((n, pool), object)

    def add(self, score: np.ndarray, keys: np.ndarray, docs: list) -> None:
        """Take the scores of some chunks in; only those that can stay are rounded, to six digits, and put in order."""
        bar = self.score[:, -1]
        if score.shape[1] > self.pool and not np.isfinite(bar).all():
            bar = np.maximum(bar, np.partition(score, -self.pool, axis=1)[:, -self.pool])
        cell = np.flatnonzero(score >= np.maximum(bar - 1e-6, -1e300)[:, None])
        if not len(cell):
            return
        row, at = np.divmod(cell, score.shape[1])
        score = np.round(score.ravel()[cell], 6)
        touched = np.unique(row)
        old, place = np.nonzero(np.isfinite(self.score[touched]))
        old = touched[old]
        row_all = np.concatenate([old, row])
        s = np.concatenate([self.score[old, place], score])
        k = np.concatenate([self.key[old, place], keys[at]])
        d = np.concatenate([self.doc[old, place], np.array(docs, object)[at]])
        order = np.lexsort((k, -s, row_all))
        row_all, s, k, d = row_all[order], s[order], k[order], d[order]
        place = np.arange(len(row_all)) - np.searchsorted(row_all, row_all)
        stay = place < self.pool
        self.score[row_all[stay], place[stay]], self.key[row_all[stay], place[stay]], self.doc[row_all[stay], place[stay]] = s[stay], k[stay], d[stay]


def search(queries: DataFrame, index: SearchIndex, k: int = 5, alpha: float = 0.7, per_doc: int = 2, hybrid: bool = True, lexical_only: bool = False, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), chunk_ord, doc_id, score (6 digits) of each query's best chunks.

    ``queries`` has query_id, text and vector. Fused scores are ``alpha`` times the dense and
    the rest times the lexical score, both scaled by the query's minimum and maximum over all
    chunks; with ``alpha`` 0 or 1 or without ``hybrid`` they are the dense scores alone. Ties
    go to the lower key. With ``lexical_only`` the score is the lexical one, and chunks that
    share no term with the query are no hits. Null vectors and those of another dimension score 0, null texts are empty.
    """
    mode = "lexical" if lexical_only else "fused" if hybrid and 0 < alpha < 1 else "dense"
    rows = queries.select("query_id", "text", "vector").orderBy("query_id")
    listed = rows.limit(block + 1).collect()
    got = []
    if len(listed) > block:  # more than one block: the rows are kept, so that each block's are the same
        rows = cut(rows).orderBy("query_id")
        for begin in range(0, rows.count(), block):
            got.append(_search_block(rows.offset(begin).limit(block).collect(), rows.schema, index, pool_size(k, per_doc), alpha, mode))
    else:
        got.append(_search_block(listed, rows.schema, index, pool_size(k, per_doc), alpha, mode))
    return diverse(reduce(DataFrame.unionByName, got), k, per_doc)


def _search_block(listed: list[Row], schema: T.StructType, index: SearchIndex, pool: int, alpha: float, mode: str) -> DataFrame:
    session = index.blocks.sparkSession
    words, vectors = mode != "dense", mode != "lexical"
    queries = _Queries([r["query_id"] for r in listed], [r["vector"] if vectors else None for r in listed], [r["text"] if words else None for r in listed])
    if words:
        if not index.with_words:
            raise ValueError("the index has no words")
        queries.weigh(*index.statistics(queries.terms))
    shared = session.sparkContext.broadcast(queries)  # at most ``block`` queries
    columns = ["keys", "docs", *(["dims", "vectors"] if vectors else []), *(["dl", "terms", "starts", "at", "tf"] if words else [])]
    source = index.blocks.select(*columns)

    def scored(batches: Iterator[pa.RecordBatch], q: _Queries) -> Iterator[tuple]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = {c: batch.column(j)[i].values for j, c in enumerate(columns)}
                arrays = {c: v.to_numpy(zero_copy_only=False) for c, v in block.items() if c != "docs"}
                dense = q.dense(arrays["dims"], arrays["vectors"]) if vectors else None
                lexical = q.lexical(*(arrays[c] for c in ("dl", "terms", "starts", "at", "tf"))) if words else None
                yield arrays["keys"], block["docs"], dense, lexical

    def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = np.full((2, len(shared.value.ids)), np.inf)
        high = -low
        for _, _, *both in scored(batches, shared.value):
            for i, x in enumerate(both):
                low[i], high[i] = np.minimum(low[i], x.min(axis=1)), np.maximum(high[i], x.max(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(range(low.shape[1]), pa.int32()), *(pa.array(x) for x in (*low, *high))], names=["q", "l0", "l1", "h0", "h1"])

    limits = None
    if mode == "fused":
        found = source.mapInArrow(extremes, "q int, l0 double, l1 double, h0 double, h1 double")
        found = found.groupBy("q").agg(F.min("l0"), F.min("l1"), F.max("h0"), F.max("h1")).orderBy("q").collect()
        limits = np.array([list(r)[1:] for r in found]).reshape(-1, 4).T

    id_kind, doc_kind = schema["query_id"].dataType, index.blocks.schema["docs"].dataType.elementType
    id_type, doc_type = to_arrow_type(id_kind), to_arrow_type(doc_kind)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        ids = q.ids
        top = _Best(len(ids), pool)
        if mode == "fused":
            q, rest = q.fused(limits, alpha)
        for keys, docs, dense, lexical in scored(batches, q):
            if mode == "lexical":
                score = np.where(lexical > 0, lexical, -np.inf)
            elif mode == "fused":
                score = dense
                score += lexical
                score += rest[:, None]
            else:
                score = dense
            top.add(score, keys, docs.to_pylist())
        who, at = np.nonzero(np.isfinite(top.score))
        if len(who):
            columns = [pa.array([ids[i] for i in who], id_type), pa.array(top.key[who, at]), pa.array(top.doc[who, at].tolist(), doc_type), pa.array(top.score[who, at])]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "chunk_ord", "doc_id", "score"])

    local = source.mapInArrow(best, f"query_id {id_kind.simpleString()}, chunk_ord bigint, doc_id {doc_kind.simpleString()}, score double")
    return ranked(local, pool)


def ranked(scores: DataFrame, most: int) -> DataFrame:
    """query_id, chunk_ord, doc_id, score, rank of the first ``most`` by score, then chunk_ord."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_ord")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def diverse(hits: DataFrame, k: int, per_doc: int) -> DataFrame:
    """The first ``k`` of ranked hits, with at most ``per_doc`` of a document (0: any number), ranked anew."""
    if per_doc > 0:
        own = Window.partitionBy("query_id", "doc_id").orderBy("rank")
        hits = hits.withColumn("__own", F.row_number().over(own)).filter(F.col("__own") <= per_doc).drop("__own")
    order = Window.partitionBy("query_id").orderBy("rank")
    hits = hits.withColumn("__new", F.row_number().over(order)).filter(F.col("__new") <= k)
    return hits.select("query_id", F.col("__new").cast("bigint").alias("rank"), "chunk_ord", "doc_id", "score")


def minmax(scores: DataFrame, group: list[str], score: str) -> DataFrame:
    """``scores`` with scaled: 0 to 1 within the group, 0 where the group's scores are all alike."""
    ends = scores.groupBy(*group).agg(F.min(score).alias("__low"), F.max(score).alias("__high"))
    span = F.col("__high") - F.col("__low")
    scaled = F.when(span < 1e-12, F.lit(0.0)).otherwise((F.col(score) - F.col("__low")) / F.when(span < 1e-12, F.lit(1.0)).otherwise(span))
    return scores.join(ends, group).withColumn("scaled", scaled).drop("__low", "__high")


def rerank(candidates: DataFrame, queries: DataFrame, k: int = 5, alpha: float = 0.7, per_doc: int = 2) -> DataFrame:
    """As ``search``, of candidates alone (query_id, chunk_ord, doc_id, text, score, as an index or a vector server gives them):
    the lexical score is computed among each query's candidates, and both scores are scaled within them.

    A query's candidates, a bounded number, are one row and are scored together.
    """
    packed = candidates.groupBy("query_id").agg(F.collect_list(F.struct("chunk_ord", "doc_id", "text", "score")).alias("__c"))
    rows = packed.join(queries.select("query_id", F.col("text").alias("__q")), "query_id")
    id_kind, doc_kind = (candidates.schema[c].dataType.simpleString() for c in ("query_id", "doc_id"))
    doc_type = to_arrow_type(candidates.schema["doc_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = batch.column(1)[i].as_py()
                terms = [term_counts(c["text"]) for c in found]
                dl = np.array([n for n, _ in terms], float)
                avgdl = dl.mean() or 1.0
                lexical = np.zeros(len(found))
                for term, times in term_counts(batch.column(2)[i].as_py())[1].items():
                    tf = np.array([c.get(term, 0) for _, c in terms], float)
                    df = (tf > 0).sum()
                    lexical += times * np.log(1 + (len(found) - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))
                both = [np.array([c["score"] for c in found]), lexical]
                dense, lexical = (_scaled(x) for x in both)
                score = np.round(alpha * dense + (1 - alpha) * lexical, 6)
                ids = batch.column(0).take(pa.array([i] * len(found)))
                yield pa.RecordBatch.from_arrays([ids, pa.array([c["chunk_ord"] for c in found]), pa.array([c["doc_id"] for c in found], doc_type), pa.array(score)], names=["query_id", "chunk_ord", "doc_id", "score"])

    final = rows.select("query_id", "__c", "__q").mapInArrow(run, f"query_id {id_kind}, chunk_ord bigint, doc_id {doc_kind}, score double")
    return diverse(ranked(final, pool_size(k, max(per_doc, 1))), k, per_doc)


def rerank_candidates(queries: DataFrame, index: SearchIndex, chunks: DataFrame, k: int = 5, alpha: float = 0.7, per_doc: int = 2, key: str = "chunk_ord", text: str = "text") -> DataFrame:
    """``rerank`` of the dense candidates that an index finds; ``chunks`` has their texts."""
    dense = cut(search(queries, index, pool_size(k, max(per_doc, 1)), alpha, 0, hybrid=False))
    texts = chunks.select(F.col(key).alias("chunk_ord"), F.col(text).alias("text"))
    return rerank(dense.join(texts, "chunk_ord").select("query_id", "chunk_ord", "doc_id", "text", "score"), queries, k, alpha, per_doc)
