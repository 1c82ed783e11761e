"""Where chunks are kept and searched: tables (``local``) or a vector server (``server``), as the settings say."""

from __future__ import annotations

from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.config import Settings
from skerry.operators.search import diverse, pool_size, ranked, rerank
from skerry.session import cut
from skerry.sources.index import ChunkIndex, IndexError_, with_ordinals
from skerry.sources.remote import VectorServer


class ServerStore:
    """A vector server with the same face as ``ChunkIndex``. A replayed append adds nothing."""

    def __init__(self, spark: SparkSession, server: VectorServer):
        self.spark, self.server = spark, server

    def create(self, chunks: DataFrame) -> ServerStore:
        first = chunks.filter("embedding is not null").select(F.size("embedding")).first()
        if first is None:
            raise IndexError_("an index needs at least one chunk")
        self.server.create(first[0])
        self.server.upsert(chunks)
        return self

    def ready(self) -> bool:
        return self.server.exists()

    def _opened(self) -> VectorServer:
        if not self.ready():
            raise IndexError_(f"there is no collection {self.server.collection} at {self.server.url}; build one first")
        return self.server

    def contains(self, docs: DataFrame) -> DataFrame:
        """The rows of ``docs`` whose document has a point; each different document is asked for once, where it lies."""
        server = self._opened()

        def ask(frames):
            for frame in frames:
                yield pd.DataFrame({"doc_id": [d for d in frame["doc_id"] if server.contains(d)]}, dtype=object)

        there = docs.select("doc_id").distinct().mapInPandas(ask, "doc_id string")
        return docs.join(cut(there), "doc_id", "left_semi")

    def append(self, chunks: DataFrame) -> int:
        known = self.contains(chunks.select("doc_id").distinct())
        new = chunks.drop("chunk_ord").join(known, "doc_id", "left_anti")
        rows = cut(with_ordinals(new, self.server.count()))
        self.server.upsert(rows)
        return rows.count()

    def search(self, queries: DataFrame, k: int, alpha: float, per_doc: int, hybrid: bool) -> DataFrame:
        """As ``ChunkIndex.search``; with ``hybrid`` the server's candidates are reranked by their words."""
        found = cut(self._opened().candidates(self.spark, queries, pool_size(k, max(per_doc, 1))))
        names = found.select("query_id", "chunk_ord", "text", "section", "title", "url")
        if hybrid and 0 < alpha < 1:
            hits = rerank(found, queries, k, alpha, per_doc)
        else:
            hits = diverse(ranked(found.select("query_id", "chunk_ord", "doc_id", F.round("score", 6).alias("score")), pool_size(k, per_doc)), k, per_doc)
        return hits.join(names, ["query_id", "chunk_ord"])

    def count(self) -> int:
        return self._opened().count()


def store_of(spark: SparkSession, settings: Settings) -> ChunkIndex | ServerStore:
    if settings.store == "local":
        return ChunkIndex(spark, settings.index_dir)
    if settings.store == "server":
        return ServerStore(spark, replace(VectorServer(settings.server_url), collection=settings.collection, batch=settings.server_batch))
    raise IndexError_(f"no store is called {settings.store!r}; there are local and server")
