"""Tables between steps, kept in the shared folder."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from landspan.session import scratch_path


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_end(spark: SparkSession) -> Iterator[None]:
    """What is written within is not read from its shuffles again, so their files go with the write."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def save(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again.

    Later steps read files that outlive any executor, and each step's work is done once.
    """
    path = scratch_path(df.sparkSession, name)
    with _shuffles_end(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save_dealt(df: DataFrame, name: str, key: str, n: int) -> DataFrame:
    """Like ``save``, as a table in ``n`` buckets by ``key``, which joins and groups by ``key`` read without a shuffle."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = "landspan_" + path.rsplit("/", 1)[1].replace("-", "_")
    with _shuffles_end(spark):
        df.write.format("parquet").bucketBy(n, key).option("path", path).saveAsTable(table)
    return spark.table(table)


def bounded_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Bound this session's Arrow batches by bytes, so that long texts do not fill a Python worker.

    A batch ends with the row that passes the bound; the results do not depend on it.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)


def give_back() -> None:
    """Freed memory goes back to the system: a Python worker that waits shares the executor's memory with its JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


def giving_back(work: Callable) -> Callable:
    """``work`` on a group, or on two, which gives back what the group before and its own arrays took."""

    def one(rows):
        give_back()
        out = work(rows)
        give_back()
        return out

    def two(rows, told):
        give_back()
        out = work(rows, told)
        give_back()
        return out

    return one if work.__code__.co_argcount == 1 else two
