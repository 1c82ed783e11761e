"""Encoding of texts with a public byte-level BPE vocabulary (problem 6).

Monoid tree reduction: a text is halved until the parts are short, the parts are encoded
each for itself, and neighbours are joined up the tree. ``join`` is associative, with the
empty text as its unit, so any split of a text gives the same ids.

Why a join is exact. The vocabulary's pre-tokenizer is a pattern matched from left to
right that never looks behind, so where a match starts decides all that follows, and a
match looks at most ``LOOKAHEAD`` characters beyond its end. Hence, of the left part, the
pre-tokens that end further from its edge than that are final. From the first one that
isn't, the window is matched again over both parts, growing to the right until a match
starts where one of the right part's own matches starts; all to the right of it is then
final too. Merges never cross pre-tokens, so only the window's tokens are replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

LOOKAHEAD = 3
LEAF_CHARS = 4096
BATCH_ROWS = 512

#: Pre-tokenizer pattern of the byte_bpe vocabularies (a fixed value of their format).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the installed package of public tokenizers has a file; any other path may be given instead."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


@lru_cache(maxsize=4)
def encoder(path: str):
    """The encoder of a vocabulary of ranks, once per Python worker."""
    import tiktoken

    lines = Path(path).read_bytes().split(b"\n")
    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding(Path(path).stem, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _matcher():
    import regex

    return regex.compile(PATTERN)


def _first_open(text: str) -> int:
    """Start of the first pre-token that what follows ``text`` could change."""
    # the last match before the edge's neighbourhood starts at a place that any scan reaches:
    # look back over growing stretches for a start that the scan of a longer stretch confirms
    edge = len(text) - LOOKAHEAD
    span = 64
    while True:
        begin = max(0, len(text) - span)
        starts = [m.start() for m in _matcher().finditer(text, _anchor(text, begin))]
        ends = [*starts[1:], len(text)]
        final = [end for end in ends if end <= edge]
        if final:
            return final[-1]
        if begin == 0:
            return 0
        span *= 4


def _anchor(text: str, begin: int) -> int:
    """A place at or before ``begin`` where some pre-token of the whole text starts.

    A space or newline after a letter or digit always starts one: no match of letters or
    digits reaches over it, and no match that begins earlier can hold it behind them.
    """
    for at in range(begin, 0, -1):
        if text[at] in " \n" and text[at - 1].isalnum():
            return at
    return 0


class Encoded:
    """A text and its ids; ``join`` is the monoid's operation."""

    __slots__ = ("ids", "text")

    def __init__(self, text: str, ids: list[int]):
        self.text, self.ids = text, ids


def join(left: Encoded, right: Encoded, encode) -> Encoded:
    if not left.text or not right.text:
        return left if left.text else right
    both, border = left.text + right.text, len(left.text)
    start = _first_open(left.text)
    own = _matcher().finditer(right.text)
    passed: list[str] = []  # the right part's own pre-tokens that the window replaces
    window: list[str] = []
    current = next(own, None)
    for match in _matcher().finditer(both, start):
        at = match.start() - border
        while current is not None and current.start() < at:
            passed.append(current.group())
            current = next(own, None)
        if current is not None and current.start() == at:
            break
        window.append(match.group())
    else:
        passed.extend(match.group() for match in ([current] if current else []))
        passed.extend(match.group() for match in own)
    # a pre-token is encoded by itself: at the cut end of a window, spaces would match otherwise
    keep = len(left.ids) - len(encode(left.text[start:]))
    skip = sum(len(encode(x)) for x in passed)
    return Encoded(both, left.ids[:keep] + [i for x in window for i in encode(x)] + right.ids[skip:])


def encode_tree(text: str, encode, leaf: int = LEAF_CHARS) -> Encoded:
    """Encode halves recursively, and join them."""
    if len(text) <= leaf:
        return Encoded(text, encode(text) if text else [])
    middle = len(text) // 2
    return join(encode_tree(text[:middle], encode, leaf), encode_tree(text[middle:], encode, leaf), encode)


def decode_tree(ids: list[int], path: str, leaf: int = LEAF_CHARS) -> bytes:
    """Bytes of a list of ids, put together up the same tree."""
    if len(ids) <= leaf:
        return encoder(path).decode_bytes(ids)
    middle = len(ids) // 2
    return decode_tree(ids[:middle], path, leaf) + decode_tree(ids[middle:], path, leaf)


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, leaf: int = LEAF_CHARS, counts_only: bool = False) -> DataFrame:
    """``key`` and ids (or n_tokens) of every row; strings that look like special tokens are plain text.

    Null and empty texts have an empty list (n_tokens 0). Repeated rows come out as often as
    they go in; other columns are left out. No shuffle: each batch is encoded where it is read.
    """
    path = path or vocabulary_path()
    kind = df.schema[key].dataType
    out = T.StructType([T.StructField(key, kind), T.StructField("n_tokens", T.LongType()) if counts_only else T.StructField("ids", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_ordinary
        for batch in batches:
            for begin in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(begin, BATCH_ROWS)
                ids = [encode_tree(value, encode, leaf).ids if value else [] for value in part.column(1).to_pylist()]
                column = pa.array([len(x) for x in ids], pa.int64()) if counts_only else pa.array(ids, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), column], names=out.names)

    return df.select(key, text).mapInArrow(run, out)


def decode_ids(df: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """``key`` and text of every row of ids; a null list gives null, bytes that aren't UTF-8 the replacement sign."""
    path = path or vocabulary_path()
    out = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else decode_tree(x, path).decode("utf-8", errors="replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=out.names)

    return df.select(key, ids).mapInArrow(run, out)
