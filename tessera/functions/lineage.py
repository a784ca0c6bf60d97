"""Written intermediate tables, which end lineage: a lost executor costs no more than the step it was in."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}
_local = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``, which all executors share; it goes when the JVM ends.

    Only a local session, which has one machine, may leave the setting unset: it gets a temporary folder.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        base = context.getCheckpointDir()
    folder = f"{base.rstrip('/')}/tessera-{context.applicationId}"
    if _folders.get(context.applicationId) != folder:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _folders[context.applicationId] = folder
    return folder


def _write(df: DataFrame, what: str, owner: list[str] | None) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    if owner is not None:
        owner.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back; within :func:`scratch` it goes when that ends."""
    return _write(df, what, _scratches()[-1] if _scratches() else None)


def kept(df: DataFrame, what: str) -> DataFrame:
    """As :func:`written`, but the table outlives the innermost :func:`scratch`."""
    return _write(df, what, _scratches()[-2] if len(_scratches()) > 1 else None)


def _scratches() -> list[list[str]]:
    if not hasattr(_local, "scratches"):
        _local.scratches = []
    return _local.scratches


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written within go at its end, and what they were shuffled by; results have to be :func:`kept`."""
    mine: list[str] = []
    _scratches().append(mine)
    try:
        yield
    finally:
        _scratches().remove(mine)
        context = spark.sparkContext
        for name in mine:
            path = context._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
        context._jvm.System.gc()  # the cleaner removes shuffles whose tables nothing refers to


def cut(df: DataFrame) -> DataFrame:
    """A loop's state, written and read back."""
    return written(df, "loop")
