"""Embedding and generation by exchangeable providers, called in batches inside the executors.

``HashProvider`` works offline and is deterministic; ``HttpProvider`` speaks the two common
JSON shapes of model servers. A provider is a small picklable record that is used where the
data is; retries are bounded and a failure is a null answer where one question fails.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.config import Settings
from skerry.functions.text import judged, normal_query


class ProviderError(RuntimeError):
    """A model server can't be reached or gives no usable reply."""


class Provider(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...

    def generate(self, prompt: str, system: str = "") -> str: ...

    def available_models(self) -> list[str]: ...

    def describe(self) -> str: ...


@lru_cache(maxsize=1 << 18)
def _word_hash(word: str) -> int:
    """28 bits of the word's MD5, as SQL can compute them too."""
    return int(hashlib.md5(word.encode(), usedforsecurity=False).hexdigest()[:7], 16)


@dataclass(frozen=True)
class HashProvider:
    """Vectors of signed hashed words, and answers that quote the first passage."""

    dim: int = 64

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dim))
        for i, text in enumerate(texts):
            for word in re.findall(r"[a-z0-9]+", text.lower()):
                h = _word_hash(word)
                out[i, h % self.dim] += 1.0 if h >> 27 else -1.0
        return out.tolist()

    def generate(self, prompt: str, system: str = "") -> str:
        if "Rating (1-5):" in prompt:
            return "3"
        found = re.search(r"\[1\] \(from: [^\n]*\)\n(.*?)(?:\n\n|\Z)", prompt, re.S)
        return found[1].strip() if found else "I don't know."

    def available_models(self) -> list[str]:
        return [f"hash-{self.dim}", "extract"]

    def describe(self) -> str:
        return f"hash ({self.dim} dimensions, offline)"


@dataclass(frozen=True)
class HttpProvider:
    """A model server with ``/api`` routes (style ``local``) or ``/v1`` routes (style ``v1``)."""

    base_url: str
    embed_model: str
    chat_model: str
    api_key: str = ""
    style: str = "v1"
    temperature: float = 0.0
    batch: int = 16
    timeout_s: int = 120
    attempts: int = 3

    def __post_init__(self) -> None:
        local = re.match(r"https?://(localhost|127\.|0\.0\.0\.0|host\.docker\.internal|\[::1\])", self.base_url)
        if self.style == "v1" and not local and not self.api_key:
            raise ProviderError("a server that isn't local needs an API key")

    def _call(self, path: str, body: dict | None, timeout_s: int | None = None, attempts: int | None = None) -> dict:
        data = None if body is None else json.dumps(body).encode()
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {})
        error: Exception | None = None
        n = attempts or self.attempts
        for i in range(n):
            try:
                with urllib.request.urlopen(urllib.request.Request(self.base_url.rstrip("/") + path, data, headers), timeout=timeout_s or self.timeout_s) as reply:
                    return json.load(reply)
            except (urllib.error.URLError, TimeoutError, ValueError) as e:
                error = e
                if i + 1 < n:
                    time.sleep(2**i)
        raise ProviderError(f"{path}: {error}")

    def embed(self, texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for i in range(0, len(texts), self.batch):
            part = texts[i : i + self.batch]
            if self.style == "v1":
                items = self._call("/v1/embeddings", {"model": self.embed_model, "input": part}).get("data", [])
                got = [x["embedding"] for x in sorted(items, key=lambda x: x["index"])]
            else:
                got = self._call("/api/embed", {"model": self.embed_model, "input": part}).get("embeddings", [])
            if len(got) != len(part):
                raise ProviderError(f"{len(got)} vectors for {len(part)} texts")
            out += got
        return out

    def generate(self, prompt: str, system: str = "") -> str:
        messages = ([{"role": "system", "content": system}] if system else []) + [{"role": "user", "content": prompt}]
        try:
            if self.style == "v1":
                reply = self._call("/v1/chat/completions", {"model": self.chat_model, "messages": messages, "temperature": self.temperature})
                return reply["choices"][0]["message"]["content"].strip()
            reply = self._call("/api/chat", {"model": self.chat_model, "messages": messages, "stream": False, "options": {"temperature": self.temperature}})
            return reply["message"]["content"].strip()
        except (KeyError, IndexError, AttributeError) as e:
            raise ProviderError(f"unexpected reply: {e}") from e

    def available_models(self) -> list[str]:
        if self.style == "v1":
            return [x["id"] for x in self._call("/v1/models", None, 10, 1).get("data", [])]
        return [x["name"] for x in self._call("/api/tags", None, 10, 1).get("models", [])]

    def describe(self) -> str:
        return f"{self.style} server at {self.base_url}"


def create(settings: Settings) -> Provider:
    if settings.provider == "hash":
        return HashProvider(int(settings.embed_model.rpartition("-")[2] or 64))
    if settings.provider in ("local", "v1"):
        return HttpProvider(settings.base_url, settings.embed_model, settings.chat_model, settings.api_key, settings.provider, settings.temperature, settings.embed_batch, settings.timeout_s)
    raise ProviderError(f"no provider is called {settings.provider!r}")


def judge_of(provider: Provider, settings: Settings) -> Provider:
    """The provider that grades: the same server with the judge's model, where one is set."""
    return replace(provider, chat_model=settings.effective_judge) if isinstance(provider, HttpProvider) else provider


def check_ready(provider: Provider, wanted: list[str]) -> list[str]:
    """Models that are missing; an error for a server on one's own machine, which then has to get them, else only told."""
    lacking = missing_models(provider, wanted)
    if lacking and not (isinstance(provider, HttpProvider) and provider.style == "v1"):
        raise ProviderError(f"the model server lacks {', '.join(lacking)}")
    return lacking


def missing_models(provider: Provider, wanted: list[str]) -> list[str]:
    """Models that the server lacks; ``m`` is there if ``m:latest`` is."""
    there = set(provider.available_models())
    return sorted({m for m in wanted if m not in there and f"{m}:latest" not in there})


def with_embedding(df: DataFrame, provider: Provider, text: str = "text", out: str = "embedding") -> DataFrame:
    """``df`` with a vector of each text; null texts have null. Batches go to the provider where they lie."""
    names = [c for c in df.columns if c != out]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(names.index(text)).to_pylist()
            vectors = iter(provider.embed([t for t in texts if t is not None]))
            column = pa.array([None if t is None else next(vectors) for t in texts], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*names, out])

    return df.select(*names).mapInArrow(run, f"{schema}, `{out}` array<float>")


@dataclass(frozen=True)
class _Remembered:
    """A provider that keeps the vectors of the last ``size`` texts in each worker, which lives on from query to query."""

    provider: Provider
    size: int = 10_000

    def embed(self, texts: list[str]) -> list[list[float]]:
        known = _vectors.setdefault(repr(self.provider), {})
        new = list(dict.fromkeys(t for t in texts if t not in known))
        fresh = dict(zip(new, self.provider.embed(new), strict=True)) if new else {}
        out = [known.pop(t) if t in known else fresh[t] for t in dict.fromkeys(texts)]
        found = dict(zip(dict.fromkeys(texts), out, strict=True))
        known.update(found)  # what was used last is last
        while len(known) > self.size:
            del known[next(iter(known))]
        return [found[t] for t in texts]


_vectors: dict[str, dict[str, list[float]]] = {}


def with_query_vectors(queries: DataFrame, provider: Provider, text: str = "text", remember: int = 10_000) -> DataFrame:
    """``queries`` with vector; each different normalised text is embedded once, and remembered by the worker for later queries."""
    rows = queries.withColumn("__norm", normal_query(F.col(text)))
    kept = _Remembered(provider, remember) if remember > 0 else provider
    vectors = with_embedding(rows.select("__norm").filter("__norm is not null").distinct(), kept, "__norm", "vector")
    return rows.join(vectors, "__norm", "left").drop("__norm")


def with_answer(prompts: DataFrame, provider: Provider, prompt: str = "prompt", out: str = "answer", system: str = "", seconds: str | None = None) -> DataFrame:
    """``prompts`` with the provider's reply, and the seconds it took if ``seconds`` names a column; null where it fails or there is no prompt."""
    names = [c for c in prompts.columns if c not in (out, seconds)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.select(*names).schema)
    more = [out, *([seconds] if seconds else [])]

    def ask(text: str | None) -> tuple[str | None, float | None]:
        began = time.perf_counter()
        try:
            return (None, None) if text is None else (provider.generate(text, system), time.perf_counter() - began)
        except ProviderError:
            return None, time.perf_counter() - began

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            replies = [ask(t) for t in batch.column(names.index(prompt)).to_pylist()]
            columns = [pa.array([x for x, _ in replies], pa.string()), pa.array([x for _, x in replies], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns[: len(more)]], names=[*names, *more])

    kinds = f", `{out}` string" + (f", `{seconds}` double" if seconds else "")
    return prompts.select(*names).mapInArrow(run, schema + kinds)


JUDGE_SYSTEM = "You grade answers. Reply with one whole number from 1 to 5 and nothing else."
#: What each judge is asked; the fields in braces are columns.
JUDGES = {
    "faithfulness": ("Is every claim of the answer supported by the context? 1 = hardly any, 5 = all.", ("context", "answer")),
    "relevance": ("Does the answer address the question, right or wrong? 1 = not at all, 5 = fully.", ("question", "answer")),
    "correctness": ("Does the answer agree with the reference answer? 1 = contradicts it, 5 = fully.", ("question", "reference_answer", "answer")),
}


def with_judgements(rows: DataFrame, provider: Provider) -> DataFrame:
    """``rows`` (question, context, answer, reference_answer) with a grade from 1 to 5 by each judge; null if its reply has none."""
    for name, (task, fields) in JUDGES.items():
        parts = [F.concat(F.lit(f"\n\n{f.replace('_', ' ').capitalize()}:\n"), F.left(F.coalesce(f, F.lit("")), F.lit(8000)) if f == "context" else F.coalesce(f, F.lit(""))) for f in fields]
        asked = rows.withColumn("__prompt", F.concat(F.lit(task), *parts, F.lit("\n\nRating (1-5):")))
        rows = with_answer(asked, provider, "__prompt", "__reply", JUDGE_SYSTEM).withColumn(name, judged(F.col("__reply"))).drop("__prompt", "__reply")
    return rows
