"""Markup residue in text (problem 1).

A recurrent block labeller. A text is a sequence of leaves (its lines that aren't blank). What
a bidirectional LSTM in numpy reads of a leaf:

* the path of constructs open where it starts (tags, fences, templates, environments), as
  vectors of the whole path and of its innermost construct;
* hashed-word vectors: the mean vector of its words, and, for the signs between the words,
  the greatest value, component by component, of the vectors of the signs' surroundings. Such
  a vector is the sum of learned vectors of hashed n-grams of the tokens around a sign,
  each token as its shape (a word, a capitalised word, a number, a space, the sign itself) and
  the neighbouring words also as they are;
* its place in the text, length, number of words, and depth of the path.

From the whole sequence it labels every leaf: its role (text, heading, list, code, formula,
table, rest) and the probability that it carries markup. A text has markup if some leaf
reaches ``least``; no list of patterns has a say in that. ``clean_markup`` rewrites the
marked leaves by role with the scanner of ``rewrite``.

The weights beside this module are made by ``markup_train``; the work is one batched
projection without a shuffle, and the broadcast weights have a fixed size.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from skerry.llm.rewrite import ROLES, clean, joined
from skerry.session import slices

WORDS, PATHS, GRAMS, DIM, SIGN_DIM, FIGURES = 4096, 256, 1 << 15, 8, 16, 5
WIDTH = FIGURES + 3 * DIM + SIGN_DIM
CELLS = 1 << 18
_U = np.uint64
_NEWLINE = re.compile(r"\r\n?|\n")

# ---------------------------------------------------------------- leaves and paths

_OPENING = re.compile(r"[<{}\\$`~|]")
_CONSTRUCT = re.compile(
    r"<(?P<shut>/?)(?P<tag>[A-Za-z][A-Za-z0-9]*)(?:[\s/][^<>]*)?>|^\s*(?P<fence>```|~~~)|(?P<open>\{\{|^\{\|)|(?P<close>\}\}|^\|\})|\\(?P<env>begin|end)\s*\{|(?P<math>\$\$|\\[\[\]])"
)
_VOID = frozenset(("br", "hr", "img", "meta", "link", "input", "wbr"))
_NESTS = ("```", "pre", "math", "env")


class _Path:
    """The constructs that are open, each with the hash of the path down to it."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.hashes: list[int] = [0]
        self.open: dict[str, int] = {}

    def push(self, name: str) -> None:
        self.names.append(name)
        self.hashes.append(zlib.crc32(name.encode(), self.hashes[-1]))
        self.open[name] = self.open.get(name, 0) + 1

    def pop(self, name: str) -> None:
        """Shut the innermost construct of that name and all within it; without one, nothing happens."""
        while self.open.get(name):
            last = self.names.pop()
            self.hashes.pop()
            self.open[last] -= 1
            if last == name:
                return

    def turn(self, name: str) -> None:
        self.pop(name) if self.open.get(name) else self.push(name)

    def walk(self, line: str) -> None:
        for found in _CONSTRUCT.finditer(line):
            kind, sign = found.lastgroup, found[0]
            if kind == "tag":
                name = found["tag"].lower()
                if found["shut"]:
                    self.pop(name)
                elif name not in _VOID and not sign.endswith("/>"):
                    self.push(name)
            elif kind == "fence":
                self.turn("```")
            elif kind == "open":
                self.push(sign)
            elif kind == "close":
                self.pop("{{" if sign == "}}" else "{|")
            elif kind == "env":
                self.push("env") if found["env"] == "begin" else self.pop("env")
            elif sign == "\\]":
                self.pop("math")
            else:
                self.turn("math")


class Leaf:
    """A line that isn't blank, and what is open where it starts."""

    __slots__ = ("depth", "inner", "inside", "line", "number", "path")

    def __init__(self, number: int, line: str, path: _Path):
        self.number, self.line = number, line
        self.path, self.depth = path.hashes[-1], len(path.names)
        self.inner = path.names[-1] if path.names else ""
        self.inside = tuple(x for x in _NESTS if path.open.get(x)) if path.names else ()


def leaves(text: str) -> list[Leaf]:
    out, path = [], _Path()
    for number, line in enumerate(_NEWLINE.split(text) if "\r" in text else text.split("\n")):
        if line and not line.isspace():
            out.append(Leaf(number, line, path))
            if _OPENING.search(line):
                path.walk(line)
    return out


# ---------------------------------------------------------------- what the network reads

_word_ids: dict[str, int] = {}


def _word_id(word: str) -> int:
    if len(_word_ids) > 1_000_000:
        _word_ids.clear()
    got = _word_ids[word] = zlib.crc32(word.strip(".,;:!?\"'()").lower().encode("utf-8", "surrogatepass")) % WORDS
    return got


LETTER, CAPITAL, DIGIT, SPACE, OTHER, EDGE, SIGN = 1, 2, 3, 4, 5, 6, 16


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """The kind of each code point of the first plane."""
    out = np.full(1 << 16, OTHER, np.uint16)
    for c in range(1 << 16):
        s = chr(c)
        if s.isalpha():
            out[c] = CAPITAL if s.isupper() else LETTER
        elif s.isdecimal():
            out[c] = DIGIT
        elif s.isspace():
            out[c] = SPACE
        elif c < 128:
            out[c] = SIGN + c
    out[10] = EDGE
    return out


#: Signs whose surroundings are read wherever they stand, doubled, and at the start of a line.
_ANYWHERE, _DOUBLED, _FIRST = "<>&$\\`[]{}|=*_~^#", "'-", ":;!-"
#: Tokens before and after the sign that an n-gram takes in.
_WINDOWS = ((0, 0), (1, 0), (0, 1), (1, 1), (2, 0), (0, 2), (2, 1), (1, 2), (2, 2), (3, 0), (0, 3), (4, 0), (0, 4), (3, 3))
N_GRAMS = len(_WINDOWS) + 4
_HAS_SIGN = re.compile(r"[<>&$\\`\[\]{}|=*_~^#]|''|--|^\s*[:;!-]")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(31))


def _flag(signs: str) -> np.ndarray:
    out = np.zeros(SIGN + 128, bool)
    out[[SIGN + ord(c) for c in signs]] = True
    return out


def sign_grams(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(line of each sign, its hashed n-grams) of the signs of lines, by line."""
    code = np.frombuffer(("\n" + "\n".join(lines) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = np.where(code < 1 << 16, _kinds()[np.minimum(code, (1 << 16) - 1)], OTHER)
    run = np.where(kind == CAPITAL, LETTER, kind)
    new = np.ones(len(run), bool)
    new[1:] = (run[1:] != run[:-1]) | (run[1:] == EDGE)
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(run)))
    kind, run = kind[start].astype(np.int64), run[start]
    line = np.cumsum(run == EDGE) - 1
    low = np.where((code >= 65) & (code <= 90), code + 32, code).astype(np.uint64)
    place = (np.arange(len(code)) - np.repeat(start, size)).astype(np.uint64)
    word = np.add.reduceat(_mix(low + place * _U(0x9E3779B97F4A7C15)), start)
    shape = _mix((kind + np.where(kind >= SIGN, 256 * np.minimum(size, 4), 0)).astype(np.uint64) + _U(7))
    edge, is_edge = shape[0], run == EDGE
    first = np.zeros(len(run), bool)
    first[1:] = is_edge[:-1]
    first[2:] |= is_edge[:-2] & (run[1:-1] == SPACE)
    sign = np.minimum(kind, SIGN + 127)
    wanted = _flag(_ANYWHERE)[sign] | _flag(_DOUBLED)[sign] & (size > 1) | _flag(_FIRST)[sign] & first
    at = np.flatnonzero(wanted)
    mine = line[at]

    def near(step: int, of: np.ndarray) -> np.ndarray:
        there = np.clip(at + step, 0, len(run) - 1)
        return np.where((line[there] == mine) & ~is_edge[there], of[there], edge)

    around = {step: near(step, shape) for step in range(-4, 5)}
    grams = np.empty((len(at), N_GRAMS), np.int64)
    for i, (back, ahead) in enumerate(_WINDOWS):
        value = np.full(len(at), i + 1, np.uint64)
        for step in range(-back, ahead + 1):
            value = _mix(value * _U(0x9E3779B97F4A7C15) + around[step])
        grams[:, i] = (value & _U(GRAMS - 1)).astype(np.int64)
    after, before, sharp = near(1, word), near(-1, word), near(2, shape)
    pairs = ((101, around[0], after), (102, before, around[0]), (103, around[0] + after, sharp), (104, around[0] * _U(3) + around[-1], after))
    for i, (salt, a, b) in enumerate(pairs, len(_WINDOWS)):
        grams[:, i] = (_mix(_mix(a + _U(salt)) * _U(0x9E3779B97F4A7C15) + b) & _U(GRAMS - 1)).astype(np.int64)
    return mine, grams


class Described:
    """What the network reads of leaves, before its vectors are looked up."""

    def __init__(self, found: list[Leaf]):
        known, ids, n = _word_ids.get, [], len(found)
        count = np.empty(n, np.int64)
        for i, leaf in enumerate(found):
            words = leaf.line.split()
            count[i] = len(words)
            for word in words:
                got = known(word)
                ids.append(_word_id(word) if got is None else got)
        self.words, self.count = np.array(ids, np.int64), count
        self.path = np.fromiter((x.path % PATHS for x in found), np.int64, n)
        self.inner = np.fromiter((zlib.crc32(x.inner.encode()) % PATHS if x.inner else 0 for x in found), np.int64, n)
        signed = [i for i, x in enumerate(found) if _HAS_SIGN.search(x.line)]
        owner, self.grams = sign_grams([found[i].line for i in signed]) if signed else (np.zeros(0, np.int64), np.zeros((0, N_GRAMS), np.int64))
        self.owner = np.array(signed, np.int64)[owner] if signed else owner
        size = np.fromiter((len(x.line) for x in found), np.float32, n)
        number = np.fromiter((x.number == 0 for x in found), np.float32, n)
        depth = np.fromiter((x.depth for x in found), np.float32, n)
        ends = np.fromiter((x.line[-1] in ".!?" for x in found), np.float32, n)
        self.figures = np.stack([np.log1p(size) / 6, number, ends, np.log1p(depth), np.log1p(count.astype(np.float32)) / 4], axis=1)


def sign_vectors(weights: dict[str, np.ndarray], grams: np.ndarray) -> np.ndarray:
    out = np.zeros((len(grams), SIGN_DIM), np.float32)
    for i in range(grams.shape[1]):
        out += weights["grams"][grams[:, i]]
    return np.tanh(out)


def pooled(owner: np.ndarray, vectors: np.ndarray, n: int) -> np.ndarray:
    """The greatest components of each leaf's sign vectors; -1 without a sign."""
    out = np.full((n, SIGN_DIM), -1, np.float32)
    if len(owner):
        starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        out[owner[starts]] = np.maximum.reduceat(vectors, starts, axis=0)
    return out


def embed(weights: dict[str, np.ndarray], read: Described) -> np.ndarray:
    n = len(read.count)
    words = np.zeros((n, DIM), np.float32)
    if len(read.words):
        some = np.flatnonzero(read.count)
        starts = (np.cumsum(read.count) - read.count)[some]
        words[some] = np.add.reduceat(weights["words"][read.words], starts, axis=0) / read.count[some, None].astype(np.float32)
    signs = pooled(read.owner, sign_vectors(weights, read.grams), n)
    return np.concatenate([read.figures, weights["paths"][read.path], weights["inner"][read.inner], words, signs], axis=1)


# ---------------------------------------------------------------- the network


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def lstm(w: np.ndarray, u: np.ndarray, b: np.ndarray, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hidden states (steps, sequences, size) of sequences sorted by falling length."""
    steps, n, _ = x.shape
    size = u.shape[0]
    h, c = np.zeros((n, size), np.float32), np.zeros((n, size), np.float32)
    out = np.zeros((steps, n, size), np.float32)
    z_all = x @ w + b
    for t in range(steps):
        m = int(np.searchsorted(-lengths, -t, "left"))
        z = z_all[t, :m] + h[:m] @ u
        gates = sigmoid(z[:, : 3 * size])
        c[:m] = gates[:, size : 2 * size] * c[:m] + gates[:, :size] * np.tanh(z[:, 3 * size :])
        h[:m] = gates[:, 2 * size :] * np.tanh(c[:m])
        out[t, :m] = h[:m]
    return out


def padded(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(step of each leaf, sequence of each leaf, step read backwards, order of sequences), by falling length."""
    order = np.argsort(-lengths, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    step = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return step, np.repeat(place, lengths), np.repeat(lengths, lengths) - 1 - step, order


def label(weights: dict[str, np.ndarray], x: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(role, probability of markup) of each leaf; ``lengths`` are the sequences' numbers of leaves.

    Sequences of like length are padded together, so one of very many leaves doesn't stretch all others.
    """
    roles, doubts = np.empty(len(x), np.int64), np.empty(len(x), np.float32)
    starts, order, done = np.cumsum(lengths) - lengths, np.argsort(-lengths, kind="stable"), 0
    while done < len(order):
        some = np.sort(order[done : done + max(1, CELLS // int(lengths[order[done]]))])
        n = lengths[some]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[some], n)
        roles[at], doubts[at] = _label(weights, x[at], n)
        done += len(some)
    return roles, doubts


def _label(weights: dict[str, np.ndarray], x: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step, seq, back, order = padded(lengths)
    shape = (int(lengths.max()), len(lengths), x.shape[1])
    hidden = []
    for way, at in (("f", step), ("b", back)):
        grid = np.zeros(shape, np.float32)
        grid[at, seq] = x
        hidden.append(lstm(weights[f"w{way}"], weights[f"u{way}"], weights[f"v{way}"], grid, lengths[order])[at, seq])
    out = np.concatenate(hidden, axis=1) @ weights["out"] + weights["bias"]
    return np.argmax(out[:, : len(ROLES)], axis=1), sigmoid(out[:, -1])


@lru_cache(maxsize=2)
def load(path: str | None = None) -> dict[str, np.ndarray]:
    with np.load(path or Path(__file__).with_name("markup_weights.npz")) as data:
        return {k: v.astype(np.float32) for k, v in data.items()}


# ---------------------------------------------------------------- the operator

OUT = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))


def clean_markup(df: DataFrame, key: str = "chunk_ord", text: str = "text", least: float = 0.5, with_text: bool = True, weights: str | None = None) -> DataFrame:
    """``key``, has_markup, n_marked and, with ``with_text``, clean_text and blocks of every row.

    ``n_marked`` counts the leaves whose probability of markup is at least ``least``.
    ``blocks`` lists the leaves in order with their roles; ``clean_text`` joins them by
    newlines and blank lines where the text has markup and is the text itself where it has none. Null texts
    give null and no blocks; repeated rows come out as often; other columns are left out.
    """
    fields = [T.StructField(key, df.schema[key].dataType), T.StructField("has_markup", T.BooleanType()), T.StructField("n_marked", T.LongType())]
    if with_text:
        fields += [T.StructField("clean_text", T.StringType()), T.StructField("blocks", OUT)]
    schema = T.StructType(fields)
    shared = df.sparkSession.sparkContext.broadcast(load(weights))

    def part(keys: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
        model = shared.value
        found = [leaves(x) if x else [] for x in texts]
        lengths = np.array([len(x) for x in found], np.int64)
        flat = [leaf for x in found for leaf in x]
        marked, roles = np.zeros(len(flat), bool), np.zeros(len(flat), np.int64)
        if flat:
            roles, doubt = label(model, embed(model, Described(flat)), lengths[lengths > 0])
            marked = doubt >= least
        ends = np.cumsum(lengths)
        n = [int(marked[e - k : e].sum()) for e, k in zip(ends, lengths, strict=True)]
        columns = [keys, pa.array([x > 0 for x in n]), pa.array(n, pa.int64())]
        if with_text:
            blocks = [None if t is None else clean(f, roles[e - k : e], marked[e - k : e]) for t, f, e, k in zip(texts, found, ends, lengths, strict=True)]
            columns.append(pa.array([t if t is None or not m else joined(b) for t, m, b in zip(texts, n, blocks, strict=True)], pa.string()))
            columns.append(pa.array([None if b is None else [{"role": r, "text": x} for r, x, _ in b] for b in blocks], pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))))
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 1, 512):
                yield part(piece.column(0), piece.column(1).to_pylist())

    return df.select(key, text).mapInArrow(run, schema)
