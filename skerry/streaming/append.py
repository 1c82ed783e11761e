"""Documents that arrive as files are chunked, embedded and appended as a stream.

Each micro-batch goes through the same anti-join as a batch append, so a batch that is
replayed after a failure adds nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skerry.config import Settings
from skerry.operators.chunk import chunk_documents
from skerry.operators.providers import Provider, with_embedding
from skerry.sources.index import ChunkIndex


def append_documents(spark: SparkSession, arriving: str, schema: str, index: ChunkIndex, provider: Provider, checkpoint: str, settings: Settings | None = None, once: bool = True) -> StreamingQuery:
    """Follow Parquet files of doc_id, title, text in the folder ``arriving``; ``once`` takes what is there and ends."""
    settings = settings or Settings()

    def add(batch: DataFrame, _: int) -> None:
        docs = batch.filter("doc_id is not null").dropDuplicates(["doc_id"])
        meta = F.struct(F.coalesce("title", F.lit("")).alias("title"), F.lit("").alias("universe"), F.lit("").alias("source"))
        chunks = chunk_documents(docs, settings.chunk_chars, settings.chunk_overlap, metadata=meta)
        index.append(with_embedding(chunks, provider))

    stream = spark.readStream.schema(schema).parquet(arriving)
    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def latency_stream(events: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """event_type, window_start, n, total of a stream of events.

    To be written in append mode: a window comes out once, when the watermark has passed its end, and its state is then
    dropped; rows that arrive for it later than ``late`` are left to a batch rerun.
    """
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("event_type", F.col("window.start").alias("window_start"), "n", "total")


def follow_latencies(events: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write the closed windows of ``latency_stream`` to Parquet files; ``once`` takes what is there and ends."""
    writer = latency_stream(events).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
