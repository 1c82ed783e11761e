"""Abusive, hateful or sexual content (problem 8).

FTRL-proximal logistic regression over hashed word n-grams (one to three words) and
skip-grams, with per-coordinate rates and L1, so that few weights differ from zero. A
document's score is that of its worst run: every run of at most ``RUN`` words of a sentence,
from whatever word, is scored by the features that begin in it. A sentence shorter than that is
one run, so sentences of all lengths go by the same rule. Reviewers judge documents, so
training looks for the run that a positive verdict is about: all runs of rejected documents
are negatives, and in turns the best-scoring runs of an accepted document are its positives.

The model is fitted once, by ``abuse_train`` on at most ``MOST_LABELLED`` reviewed documents
plus the seed sentences below, and lies beside this module: the features with a weight
other than zero, some kilobytes, which is what is broadcast. ``fit_documents`` fits one on
the verdicts of other tables. Scoring covers every document and whole texts in one batched
projection. Words are normalised once per worker and looked up afterwards.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skerry.session import slices

BITS = 20
RUN = 24
MOST_LABELLED = 20_000

#: Letters of other scripts and signs that stand in for Latin letters.
_LOOKALIKE = str.maketrans("аеорсухіјѕԁһ", "aeopcyxijsdh")
_LEET = str.maketrans("013457@$!|", "oieastasii")
_UNSEEN = re.compile(r"[\u0000-\u0008\u000b\u000c\u000e-\u001f\u007f-\u009f­​-‏‪-‮⁠-⁤﻿]")
_SPELT = re.compile(r"(?<![^\W_])[^\W\d_](?:([.\-_*·+])[\w@$])(?:\1[\w@$])+(?![^\W_])|(?<![^\W_])[^\W\d_](?: [^\W\d_]){3,}(?![^\W_])")
_MASKED = re.compile(r"(?<=[^\W\d_])[*#%]+")
_LEETY = re.compile(r"(?<=[^\W\d_])[\d@$!|]+(?=[^\W\d_])|(?<!\S)[@$](?=[^\W\d_])|(?<=[^\W\d_])\$")
_NUMBERED = re.compile(r"\d+[a-z]{1,2}|[a-z]\d+\w?")
_EDGES = ".,;:?\"'()[]<>"
_REPEAT = re.compile(r"([^\W\d_])\1{2,}")
#: Words and ends of sentences within a piece of text without spaces.
_TOKEN = re.compile(r"[^\W_]+(?:\*[^\W_]*)?|[.!?…。！？]+(?=$|[\"'»”)])|[。！？]+")
_BREAK = "\ue000"

#: Short sentences that the model knows before it has seen a verdict, and harmless neighbours.
SEED_POSITIVE = (
    "you are a worthless idiot", "you stupid piece of trash", "shut up you moron", "what a pathetic loser you are", "you disgusting pig",
    "go to hell you bastard", "you are an asshole", "fuck you", "kill yourself", "nobody would miss you if you died", "everybody hates you",
    "i will find you and hurt you", "we will burn your house down", "i am going to break your legs", "you deserve to be beaten", "watch your back or you will bleed",
    "those people are vermin", "they are parasites and should be exterminated", "that race is filth", "drive them all out of the country", "they are animals not humans",
    "they all should be hanged", "wipe them off the earth", "he fucked her on the table", "she begged him to fuck her", "he licked her naked breasts", "they moaned as she came",
    "he pushed his cock inside her", "she sucked him until he came", "du bist ein dummes arschloch", "halt die fresse du idiot", "wir bringen dich um", "diese leute sind ungeziefer",
    "die gehören alle vergast", "du hure", "tu es un gros connard", "ferme ta gueule imbécile", "on va te tuer", "ces gens sont de la vermine", "il faut tous les exterminer", "sale pute",
    "eres un idiota de mierda", "cállate hijo de puta", "te vamos a matar", "son una plaga y hay que exterminarlos", "vete al infierno cabrón", "nadie te quiere imbécil",
)
SEED_NEGATIVE = (
    "the villain killed the guard and burned the house", "the hero was beaten and left to die", "he threatened the mayor in issue 12", "the plot deals with racial hatred and exile",
    "sex education is taught in schools", "the film has a love scene", "breast cancer is treated here", "the naked mole rat is a rodent", "he kicked ass in the final battle",
    "the ass carried the load to the mill", "the bitch had six puppies", "this move is sick", "i hate mondays", "the killer app of the decade", "the sentence hate speech is discussed",
    "der schurke tötete den wächter", "il a tué le gardien dans le numéro 4", "el villano mató al guardia", "die stadt wurde zerstört", "la ville fut détruite", "la ciudad fue destruida",
)


def _unleet(text: str) -> str:
    """Words with digits and signs inside, which are few, are read as letters."""
    out, done = [], 0
    for match in _LEETY.finditer(text):
        if match.start() < done:
            continue
        start, end = match.start(), match.end()
        while start > done and not text[start - 1].isspace() and text[start - 1] not in _EDGES:
            start -= 1
        while end < len(text) and not text[end].isspace() and text[end] not in _EDGES:
            end += 1
        word = text[start:end]
        out.append(text[done:start])
        out.append(word if _NUMBERED.fullmatch(word) else word.translate(_LEET))
        done = end
    return "".join([*out, text[done:]]) if out else text


def mended(text: str) -> str:
    """A text without invisible signs and, where it was decoded wrongly, decoded rightly."""
    if "Ã" in text or "â€" in text:
        try:
            text = text.encode("cp1252").decode("utf-8")
        except UnicodeError:
            text = re.sub(r"Ã[\u0080-¿¡-¿]", lambda m: m[0].encode("latin-1").decode("utf-8", "ignore") or m[0], text)
    return _UNSEEN.sub("", text)


def plain_word(word: str) -> str:
    """A piece of text without spaces in lower case, without accents, spelt-out and leet spellings."""
    if not word.isascii():
        word = unicodedata.normalize("NFKC", word)
        word = "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))
    word = word.lower()
    if not word.isascii():
        word = word.translate(_LOOKALIKE)
    word = _SPELT.sub(lambda m: re.sub(r"[^\w@$]|_", "", m[0]), word)
    word = _unleet(word)
    word = _MASKED.sub("*", word)
    return _REPEAT.sub(r"\1", word)


def _hash(word: str) -> int:
    """A number for a word: 48 bits of its hash, whether it is masked, 0 (for single letters, see below)."""
    data = ("0" if word.isdigit() else word).encode("utf-8", "surrogatepass")
    return (zlib.crc32(data) | (zlib.adler32(data) & 0xFFFF) << 32) << 2 | ("*" in word) << 1


class _Numbers(dict):
    """The numbers of the words in a piece of text without spaces; 0 is an end of a sentence, an odd one a letter by itself."""

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) > 1_000_000:
            self.clear()
        if piece == _BREAK:
            got = (0,)
        else:
            got = tuple(_hash(x) if x[0].isalnum() else 0 for x in _TOKEN.findall(plain_word(piece)))
            if len(piece) == 1 and piece.isalpha() and len(got) == 1:
                got = (got[0] | 1,)
                _letters[got[0]] = plain_word(piece)
        self[piece] = got
        return got


_letters: dict[int, str] = {}
_numbers = _Numbers()


def numbers_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(words of all texts as numbers, 0 after each sentence; where each text's begin and end).

    Four or more letters that stand by themselves are read as one word.
    """
    flat: list[int] = []
    ends = [0]
    get = _numbers.__getitem__
    for text in texts:
        if text:
            flat.extend(chain.from_iterable(map(get, mended(text).replace("\n", f" {_BREAK} ").split())))
        flat.append(0)
        ends.append(len(flat))
    words, ends = np.array(flat, np.int64), np.array(ends, np.int64)
    single = np.concatenate([[0], words & 1, [0]])
    begin, end = np.flatnonzero(np.diff(single) == 1), np.flatnonzero(np.diff(single) == -1)
    keep = np.ones(len(words), bool)
    for i, j in zip(begin.tolist(), end.tolist(), strict=True):
        if j - i >= 4:
            words[i] = _hash("".join(_letters[x] for x in words[i:j].tolist()))
            keep[i + 1 : j] = False
    before = np.append(0, np.cumsum(keep))
    return words[keep] & ~np.int64(1), before[ends]


def features(words: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first word, feature) of all n-grams and skip-grams within sentences."""
    hashed = words.view(np.uint64)
    inside = words != 0
    sentence = np.cumsum(~inside)
    at = np.flatnonzero(inside)
    where, what = [at], [_fold(hashed[at] >> np.uint64(2), 1)]
    masked = at[words[at] & 2 > 0]
    where.append(masked)
    what.append(np.full(len(masked), 7, np.uint64))
    for kind, steps in ((2, (0, 1)), (3, (0, 1, 2)), (4, (0, 2)), (5, (0, 3))):
        last = steps[-1]
        some = at[at < len(words) - last]
        some = some[(sentence[some + last] == sentence[some]) & inside[some + last]]
        value = np.full(len(some), kind, np.uint64)
        for step in steps:
            value = _fold((hashed[some + step] >> np.uint64(2)) + value * np.uint64(0x9E3779B97F4A7C15), kind)
        where.append(some)
        what.append(value)
    return np.concatenate(where), (np.concatenate(what) & np.uint64((1 << bits) - 1)).astype(np.int64)


def _fold(x: np.ndarray, kind: int) -> np.ndarray:
    x = (x + np.uint64(kind)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def runs(words: np.ndarray, step: int, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """(first place, place after the last) of the runs of each sentence that begin at every ``step``-th of its words.

    The last run is the first one that reaches the sentence's end.
    """
    inside = words != 0
    ends = np.flatnonzero(~inside)
    at = np.flatnonzero(inside)
    end = ends[np.searchsorted(ends, at)] if len(at) else at
    begin = np.maximum.accumulate(np.where(inside, -1, np.arange(len(words))))[at] + 1
    # a run that begins after one that reaches the end lies within it
    first = ((at - begin) % step == 0) & ((at == begin) | (at - step + run < end))
    return at[first], np.minimum(at[first] + run, end[first])


class Ftrl:
    """FTRL-proximal logistic regression; ``weights`` has the sparse solution."""

    def __init__(self, bits: int = BITS, alpha: float = 0.15, beta: float = 1.0, l1: float = 0.8, l2: float = 0.5):
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z0 = self.n0 = 0.0

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def bias(self) -> float:
        return -self.z0 / ((self.beta + self.n0**0.5) / self.alpha)

    def learn(self, at: np.ndarray, times: np.ndarray, label: int, weight: float = 1.0) -> None:
        w, b = self.weights(at), self.bias()
        p = 1 / (1 + np.exp(-max(-30.0, min(30.0, w @ times + b))))
        g = (p - label) * weight
        if abs(g) < 1e-4:
            return
        each = g * times
        sigma = (np.sqrt(self.n[at] + each * each) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += each - sigma * w
        self.n[at] += each * each
        s0 = ((self.n0 + g * g) ** 0.5 - self.n0**0.5) / self.alpha
        self.z0 += g - s0 * b
        self.n0 += g * g


class Model:
    """The weights other than zero, by feature, and the bias."""

    def __init__(self, at: np.ndarray, weight: np.ndarray, bias: float, bits: int = BITS):
        self.at, self.weight, self.bias, self.bits = at, weight, bias, bits

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits)
        out[self.at] = self.weight
        return out

    def save(self, path: str) -> None:
        np.savez_compressed(path, at=self.at.astype(np.int32), weight=self.weight.astype(np.float32), bias=np.float32(self.bias), bits=np.int32(self.bits))

    @staticmethod
    @lru_cache(maxsize=2)
    def load(path: str | None = None) -> Model:
        with np.load(path or Path(__file__).with_name("abuse_weights.npz")) as data:
            return Model(data["at"].astype(np.int64), data["weight"].astype(np.float64), float(data["bias"]), int(data["bits"]))


def fit(documents: list[tuple[str, int]], bits: int = BITS, rounds: int = 4, seed: int = 11, seeds: bool = True, **rates: float) -> Model:
    """The model of (text, verdict) of documents; a verdict of 1 is about some run of its words."""
    texts = [text for text, _ in documents]
    labels = [label for _, label in documents]
    known = [(x, 1) for x in SEED_POSITIVE] + [(x, 0) for x in SEED_NEGATIVE] if seeds else []
    words, ends = numbers_of([*texts, *(x for x, _ in known)])
    begin, end = runs(words, RUN // 2)
    doc = np.searchsorted(ends, begin, "right") - 1
    where, what = features(words, bits)
    order = np.argsort(where, kind="stable")
    where, what = where[order], what[order]
    low, high = np.searchsorted(where, begin), np.searchsorted(where, end)
    each = [np.unique(what[i:j], return_counts=True) for i, j in zip(low, high, strict=True)]
    each = [(at, times.astype(np.float64)) for at, times in each]
    verdict = np.array([*labels, *(y for _, y in known), 0])[doc]
    seeded = doc >= len(texts)
    rng = np.random.default_rng(seed)
    negative, positive = np.flatnonzero((verdict == 0) & ~seeded), np.flatnonzero((verdict == 1) & ~seeded)
    # at first every run of an accepted document counts a little
    target = {int(i): 0.3 for i in positive}
    model = Ftrl(bits, **rates)
    for turn in range(rounds):
        model = Ftrl(bits, **rates)
        plan = [(int(i), 0, 1.0) for i in negative] + [(i, 1, w) for i, w in target.items()] + [(int(i), int(verdict[i]), 1.0) for i in np.flatnonzero(seeded)]
        for _ in range(2):
            for k in rng.permutation(len(plan)):
                i, y, w = plan[k]
                model.learn(*each[i], y, w)
        if turn + 1 < rounds:
            weights, bias = model.weights(), model.bias()
            score = np.array([weights[each[i][0]] @ each[i][1] + bias for i in positive])
            target = {}
            for d in np.unique(doc[positive]):
                mine = np.flatnonzero(doc[positive] == d)
                best = mine[np.argmax(score[mine])]
                for k in mine:
                    if k == best and (score[k] > -1.5 or turn == 0) or score[k] > 0.5:
                        target[int(positive[k])] = 1.0
    weights = model.weights()
    at = np.flatnonzero(weights)
    return Model(at, weights[at], float(model.bias()), bits)


def verdicts(documents: DataFrame, labels: DataFrame, max_labelled: int) -> list[tuple[str, int]]:
    """(text, verdict) of at most ``max_labelled`` documents, those with the least hashes of their ids.

    The verdict is the majority of the reviewers' distinct verdicts; ties and nulls are left out.
    """
    votes = labels.filter("toxic is not null and doc_id is not null").select("doc_id", "toxic", "reviewer").distinct()
    votes = votes.groupBy("doc_id").agg(F.avg(F.col("toxic").cast("double")).alias("__share")).filter("__share <> 0.5")
    chosen = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = documents.select("doc_id", "text").filter("text is not null").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    return [(r["text"], int(r["__share"] > 0.5)) for r in sorted(rows.collect(), key=lambda r: r["doc_id"])]


def fit_documents(documents: DataFrame, labels: DataFrame, max_labelled: int = MOST_LABELLED, **options) -> Model:
    """A model of the verdicts of ``labels``; without any, the seed sentences alone are learnt from."""
    return fit(verdicts(documents, labels, max_labelled), **options)


def score_many(weights: np.ndarray, bias: float, texts: list[str | None], bits: int = BITS) -> np.ndarray:
    """The score (0 to 1) of each text: its worst run's. Without words it is 0."""
    words, ends = numbers_of(texts)
    where, what = features(words, bits)
    sums = np.append(0, np.cumsum(np.bincount(where, weights[what], len(words))))
    begin, end = runs(words, 1)
    score = np.full(len(texts), -np.inf)
    np.maximum.at(score, np.searchsorted(ends, begin, "right") - 1, sums[end] - sums[begin] + bias)
    return np.round(1 / (1 + np.exp(-np.clip(score, -700, 30))), 6)


def score_documents(documents: DataFrame, model: Model | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and score (0 to 1) of every row, by ``model`` or the stored one.

    Null and wordless texts score 0; repeated rows score alike; an empty table gives no rows;
    other columns are left out.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model or Model.load())
    out = T.StructType([T.StructField(key, documents.schema[key].dataType), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learnt = shared.value
        weights = learnt.dense()
        for batch in batches:
            for part in slices(batch, 1, 512):
                scores = score_many(weights, learnt.bias, part.column(1).to_pylist(), learnt.bits)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores)], names=out.names)

    return documents.select(key, text).mapInArrow(run, out)


def source_rates(documents: DataFrame, scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """source, n_docs, n_flagged, rate and mean_score of every source; a null source is a group of its own."""
    rows = documents.select("doc_id", "source").join(scores, "doc_id", "left")
    flagged = F.sum(F.when(F.col("score") >= threshold, 1).otherwise(0))
    return rows.groupBy("source").agg(F.count("*").alias("n_docs"), flagged.alias("n_flagged"), F.round(flagged / F.count("*"), 6).alias("rate"), F.round(F.avg("score"), 6).alias("mean_score"))
