"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lets Spark hand rows to Python in Arrow batches of 8 MB at most (its default is 64 MB, held
    once on either side of each task). It is set for the session and stays set, as Spark reads it
    when a result is asked for; results don't depend on it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def freeing(run):
    """run (Arrow batches to batches), with its memory given back when a task's batches are done:
    Python's workers live on for later tasks, and keep what their allocators hold otherwise."""

    def freed(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only with the GNU C library
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return freed


def doc_texts(docs: DataFrame) -> DataFrame:
    """doc_id (long) and text (null: empty) of a documents table; other columns are left out."""
    small_batches(docs.sparkSession)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def cut(df: DataFrame) -> DataFrame:
    """df written as Parquet to the checkpoint folder that all executors share, and read again.

    So its lineage is cut and it is worked out once (a reliable checkpoint() would run it twice).
    The session's spark.checkpoint.dir is used. Where it is unset, a session on one machine (master
    local) takes a temporary folder, as in tests; on a cluster that is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-"))
    path = f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def binary_column(col) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string or binary array (uint8) and its n + 1 offsets (int64)."""
    col = col.combine_chunks() if hasattr(col, "combine_chunks") else col
    wide = "large" in str(col.type)
    offsets = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def byte_chunks(batch, column: str, limit: int):
    """Slices of an Arrow batch whose column holds about limit bytes at most (or a single row)."""
    _, off = binary_column(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit integers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
