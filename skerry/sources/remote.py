"""A vector server as a sink and a place to search: collections of points with a payload, over HTTP.

Rows go out in batches from where they lie; ids are ``chunk_ord``, so a task that runs twice
writes the same points. Candidates come back with their dense scores and are reranked by
``operators.search`` like any others.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.sources.wiki import with_retries

FIELDS = ("doc_id", "chunk_id", "text", "section", "title", "url")


@dataclass(frozen=True)
class VectorServer:
    url: str
    collection: str = "chunks"
    batch: int = 256
    timeout_s: int = 60

    def call(self, method: str, path: str, body: dict | None = None) -> dict:
        data = None if body is None else json.dumps(body).encode()
        ask = urllib.request.Request(f"{self.url.rstrip('/')}/collections/{self.collection}{path}", data, {"Content-Type": "application/json"}, method=method)

        def send() -> dict:
            with urllib.request.urlopen(ask, timeout=self.timeout_s) as reply:
                return json.load(reply)

        return with_retries(send, 3, 0.2)

    def create(self, dim: int) -> None:
        """An empty collection in place of any of that name."""
        try:
            self.call("DELETE", "")
        except urllib.error.HTTPError as e:
            if e.code != 404:
                raise
        self.call("PUT", "", {"vectors": {"size": dim, "distance": "Cosine"}})

    def upsert(self, chunks: DataFrame) -> None:
        server = self

        def write(rows: Iterator) -> None:
            points: list[dict] = []
            for r in rows:
                points.append({"id": r["chunk_ord"], "vector": list(r["embedding"]), "payload": {f: r[f] for f in FIELDS}})
                if len(points) == server.batch:
                    server.call("PUT", "/points?wait=true", {"points": points})
                    points = []
            if points:
                server.call("PUT", "/points?wait=true", {"points": points})

        named = {"title": F.col("metadata.title"), "url": F.col("metadata.source")} if "metadata" in chunks.columns else {"title": F.lit(""), "url": F.lit("")}
        rows = chunks.withColumns({k: F.coalesce(v, F.lit("")) for k, v in named.items()})
        rows.filter("embedding is not null").select("chunk_ord", "embedding", *FIELDS).foreachPartition(write)

    def count(self) -> int:
        return self.call("POST", "/points/count", {"exact": True})["result"]["count"]

    def exists(self) -> bool:
        try:
            self.call("GET", "")
            return True
        except OSError:
            return False

    def documents(self, page: int = 10_000) -> Iterator[str]:
        """The ids of the documents of all points, page by page; a document comes once for each of its points."""
        offset = None
        while True:
            ask = {"limit": page, "with_payload": ["doc_id"], "with_vector": False} | ({} if offset is None else {"offset": offset})
            found = self.call("POST", "/points/scroll", ask)["result"]
            for p in found["points"]:
                yield p["payload"]["doc_id"]
            offset = found.get("next_page_offset")
            if offset is None:
                return

    def contains(self, doc_id: str) -> bool:
        """Whether a document has a point; False if the server can't say."""
        try:
            ask = {"filter": {"must": [{"key": "doc_id", "match": {"value": doc_id}}]}, "limit": 1}
            return bool(self.call("POST", "/points/scroll", ask)["result"]["points"])
        except OSError:
            return False

    def candidates(self, spark: SparkSession, queries: DataFrame, pool: int) -> DataFrame:
        """query_id, chunk_ord, doc_id, text, section, title, url, score of each query's nearest points, asked for where the queries lie."""
        server = self
        kind = queries.schema["query_id"].dataType.simpleString()

        def ask(frames):
            import pandas as pd

            for frame in frames:
                out = []
                for q, vector in zip(frame["query_id"], frame["vector"], strict=True):
                    if vector is None:
                        continue
                    found = server.call("POST", "/points/search", {"vector": [float(x) for x in vector], "limit": pool, "with_payload": True})
                    for p in found["result"]:
                        said = p["payload"]
                        out.append((q, p["id"], said["doc_id"], said["text"], said.get("section") or "", said.get("title") or "", said.get("url") or "", float(p["score"])))
                yield pd.DataFrame(out, columns=["query_id", "chunk_ord", "doc_id", "text", "section", "title", "url", "score"])

        rows = queries.select("query_id", "vector").filter(F.col("vector").isNotNull())
        return rows.mapInPandas(ask, f"query_id {kind}, chunk_ord bigint, doc_id string, text string, section string, title string, url string, score double")
