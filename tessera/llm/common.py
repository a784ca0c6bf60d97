"""Shared plumbing of the training-data operators: inputs, words, and what they use of the library's functions."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import lineage
from tessera.functions.arrays import bind, running_max, running_sums
from tessera.functions.lineage import scratch, shared_dir

__all__ = ["SPACES", "WORD", "bind", "bounded_broadcasts", "clean_text", "kept", "release", "running_max", "running_sums", "scratch", "shared_dir", "table", "text_key", "written"]

#: Rows that go to a Python worker at once, and that a Parquet reader holds at once, while a table is written: texts and blobs
#: are long, and an executor's memory small.
BATCH_ROWS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.parquet.columnarReaderBatchSize": 512}
#: Spark takes a join's side for small by its files, which hold repeated names many times smaller than the driver does when it
#: builds the table to broadcast; above so many bytes of files none is broadcast unasked.
BROADCAST_BYTES = 256 << 10
#: What separates words in every contract: the space and the five ASCII control spaces.
SPACES = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clean_text(column: str = "text") -> Column:
    """Null texts count as empty ones."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    before = {name: spark.conf.get(name) for name in BATCH_ROWS}
    for name, most in BATCH_ROWS.items():
        spark.conf.set(name, str(min(int(before[name]), most) if int(before[name]) > 0 else most))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: lineage ends there and a lost executor costs nothing.
    Within ``scratch`` it goes when that ends."""
    with _small_batches(df.sparkSession):
        return lineage.written(df, what)


def kept(df: DataFrame, what: str) -> DataFrame:
    """As :func:`written`, but the table outlives the innermost ``scratch``."""
    with _small_batches(df.sparkSession):
        return lineage.kept(df, what)


@contextmanager
def bounded_broadcasts(spark: SparkSession) -> Iterator[None]:
    """What runs within broadcasts no table of more than BROADCAST_BYTES by itself, whatever the session allows."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before, allowed = spark.conf.get(name), spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    spark.conf.set(name, str(min(allowed, BROADCAST_BYTES)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def text_key(column: str = "text") -> Column:
    """128 bits that name a text; null texts and empty ones have one name."""
    return F.unhex(F.md5(clean_text(column)))


def release() -> None:
    """Gives memory that a worker has freed back to the system: workers are reused, and their executor's share is small."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only glibc has it
        pass
