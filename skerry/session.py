"""Session helpers: table access, and the shared folder in which lineage is cut."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str, wide: bool = False) -> DataFrame:
    """The Parquet table ``name`` of ``folder``; only the columns a plan uses are read.

    With ``wide``, for costly projections: rows are spread over all cores if the scan has far
    fewer partitions than cores, as a table of one small file has. Tables of many files are
    left as they are, so at scale nothing is shuffled.
    """
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if wide and df.rdd.getNumPartitions() <= cores // 2 else df


def checkpoint_folder(session: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``, which every executor shares.

    Only a local session without that setting (tests on one machine) gets a folder of its own; on a cluster it is an error.
    """
    context = session.sparkContext
    if context.getCheckpointDir() is None:
        folder = session.conf.get("spark.checkpoint.dir", None)
        if folder is None and context.master.partition("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="skerry-"))
    return context.getCheckpointDir()


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder, so the rows survive the loss of any executor."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager)


def slices(batch: pa.RecordBatch, text: int, rows: int, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of at most ``rows`` rows and, unless one row alone has more, ``size`` bytes of its column ``text``."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths, dtype=np.int64)
    begin = 0
    while begin < batch.num_rows:
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, min(begin + rows, int(np.searchsorted(ends, before + size, "right"))))
        yield batch.slice(begin, end - begin)
        begin = end
