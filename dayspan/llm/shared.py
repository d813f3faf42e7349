"""Folders and tables that all executors see, and small column helpers of the text operators."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dayspan.session import shared_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the session's shared one."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again: cuts the lineage, survives lost executors."""
    folder = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


TEXT_ROWS, TEXT_BYTES = 1000, 8 << 20


def text_batches(df: DataFrame) -> DataFrame:
    """The table itself; Python functions on it get Arrow batches of about ``TEXT_ROWS`` rows or ``TEXT_BYTES`` bytes at most.

    The usual 10,000 rows are tens of megabytes of text, several times over in each worker, and
    far more where rows are long. Sets the session's batch sizes, and only ever lowers them.
    """
    for name, most in (("maxRecordsPerBatch", TEXT_ROWS), ("maxBytesPerBatch", TEXT_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        if not 0 < int(df.sparkSession.conf.get(name).rstrip("b")) <= most:
            df.sparkSession.conf.set(name, str(most))
    return df


def give_back() -> None:
    """Returns memory that Arrow and the C library keep for later; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def giving_back(work):
    """A batch function that gives its memory back at the end of a partition."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, other characters as they are."""
    return F.translate(text, UPPER, LOWER)


def bounded_broadcast(df: DataFrame, limit: int) -> DataFrame:
    """A broadcast hint if the table has at most ``limit`` rows, the plain table beyond."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
