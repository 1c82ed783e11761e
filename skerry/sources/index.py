"""The chunk index as Parquet tables: build, append, open; versions are swapped by one small pointer file.

A version holds the chunks, their packed blocks of postings and vectors, which is all that a search
reads, and the ids of its documents, which is all that an append reads of what is there.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.operators.fallback import not_indexed
from skerry.operators.search import SearchIndex, build_index, search
from skerry.session import checkpoint_folder, cut


class IndexError_(RuntimeError):
    """The index can't be opened or written."""


class ChunkIndex:
    """Chunks with vectors under ``folder``. A rebuild writes a new version, then points to it, so a failed one loses nothing."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _pointer(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/current.json")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _version(self) -> str | None:
        files, path = self._pointer()
        return json.loads(self.spark.read.text(path.toString(), wholetext=True).first()[0])["version"] if files.exists(path) else None

    def _point(self, version: str, chunks: int) -> None:
        files, path = self._pointer()
        out = files.create(path, True)
        out.write(bytearray(json.dumps({"version": version, "chunks": chunks}).encode()))
        out.close()

    def _read(self, what: str) -> DataFrame:
        version = self._version()
        if version is None:
            raise IndexError_(f"there is no index in {self.folder}; build one first")
        return self.spark.read.parquet(f"{self.folder}/{version}/{what}")

    def _write(self, chunks: DataFrame, version: str) -> None:
        """Blocks and ids first: an append that dies before the chunks are there is done again whole."""
        chunks.write.mode("append").parquet(f"{self.folder}/{version}/chunks")
        stored = chunks.select("chunk_ord", "doc_id", "text", "embedding")
        build_index(stored).blocks.write.mode("append").parquet(f"{self.folder}/{version}/blocks")
        chunks.groupBy("doc_id").agg(F.max("chunk_ord").alias("last")).write.mode("append").parquet(f"{self.folder}/{version}/documents")

    def create(self, chunks: DataFrame) -> ChunkIndex:
        if chunks.isEmpty():
            raise IndexError_("an index needs at least one chunk")
        version = f"{int(time.time())}-{uuid.uuid4().hex[:8]}"
        chunks = cut(chunks)
        self._write(chunks, version)
        self._point(version, chunks.count())
        return self

    def open(self) -> DataFrame:
        return self._read("chunks")

    def searchable(self) -> SearchIndex:
        return SearchIndex(self._read("blocks"))

    def append(self, chunks: DataFrame) -> int:
        """Add the chunks of documents that the index lacks; the number of chunks added. Run twice, it adds nothing.

        Only the table of document ids is read of what is there. Ordinals go on from the highest; the new
        rows are cut off first, for they are counted from what is then changed. One writer at a time.
        """
        known = self._read("documents")
        new = not_indexed(chunks, known)
        start = known.agg(F.coalesce(F.max("last"), F.lit(-1))).first()[0] + 1
        rows = cut(with_ordinals(new.drop("chunk_ord"), start))
        n = rows.count()
        if n:
            self._write(rows.select(*self.open().columns), self._version())
        return n

    def search(self, queries: DataFrame, k: int, alpha: float, per_doc: int, hybrid: bool) -> DataFrame:
        """Hits with text, section, title and url of their chunks; only the chunks that are hits are looked up."""
        hits = search(queries, self.searchable(), k, alpha, per_doc, hybrid)
        names = self.open().select("chunk_ord", "text", "section", F.col("metadata.title").alias("title"), F.col("metadata.source").alias("url"))
        return hits.join(names, "chunk_ord")

    def contains(self, docs: DataFrame) -> DataFrame:
        return docs.join(self._read("documents").select("doc_id").distinct(), "doc_id", "left_semi")

    def count(self) -> int:
        return self.open().count()

    def ready(self) -> bool:
        return self._version() is not None


def kept_index(chunks: DataFrame, source: DataFrame) -> SearchIndex:
    """The search index of a table of files, made from ``source`` (its rows) unless the shared folder has it already.

    It is kept under a digest of the files' names, sizes and times, so changed files get another one.
    """
    session = chunks.sparkSession
    path_of, conf = session._jvm.org.apache.hadoop.fs.Path, session._jsc.hadoopConfiguration()
    told = []
    for name in sorted(chunks.inputFiles()):
        status = (path := path_of(name)).getFileSystem(conf).getFileStatus(path)
        told.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    folder = f"{checkpoint_folder(session)}/search-{hashlib.sha256(chr(10).join(told).encode()).hexdigest()[:24]}"
    done = path_of(f"{folder}/_SUCCESS")
    if not done.getFileSystem(conf).exists(done):
        build_index(source).blocks.write.mode("overwrite").parquet(folder)
    return SearchIndex(session.read.parquet(folder))


def with_ordinals(chunks: DataFrame, start: int = 0, salts: int = 256) -> DataFrame:
    """``chunks`` with chunk_ord from ``start`` on, in the order of a hash of doc_id, doc_id, and the ordinal in chunk_id.

    Numbers come from counts per hash bucket, so no single task sorts all rows.
    """
    rows = chunks.withColumn("__salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    sizes = rows.groupBy("__salt").agg(F.count("*").alias("__n"))
    before = F.expr("coalesce(sum(__n) over (order by __salt rows between unbounded preceding and 1 preceding), 0)")
    offsets = F.broadcast(sizes.select("__salt", before.alias("__before")))  # at most ``salts`` rows
    place = F.expr("row_number() over (partition by __salt order by doc_id, cast(substring_index(chunk_id, '#', -1) as bigint), chunk_id)")
    rows = rows.withColumn("__place", place).join(offsets, "__salt")
    return rows.withColumn("chunk_ord", F.col("__before") + F.col("__place") - 1 + start).drop("__salt", "__place", "__before")
