"""Small helpers that several operators share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: The characters that part words; every other character belongs to a word.
SPACE = r"\x20\x09-\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share.

    Only in local mode (tests), where one machine is the cluster, a folder is made here if the session names none; elsewhere that is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='rastra-')}"
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows, read from files in the shared folder: cuts the lineage and survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_open: ContextVar[list[str] | None] = ContextVar("paths of the open scratch block", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete what operators store inside the block when it ends, failed or not; results must be written before that, elsewhere."""
    paths: list[str] = []
    before = _open.set(paths)
    try:
        yield
    finally:
        _open.reset(before)
        for path in paths:
            remove(spark, path)


def new_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that no other job uses."""
    path = f"{shared_dir(spark)}/rastra-{what}-{uuid.uuid4().hex}"
    if _open.get() is not None:
        _open.get().append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that new_path() named, once nothing reads it any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, what: str) -> DataFrame:
    """The same rows, read from Parquet in the shared folder: Catalyst knows their size then, and broadcasts them only if it is small."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    back = df.sparkSession.read.parquet(path)
    back.stored_at = path
    return back


def settled(df: DataFrame) -> DataFrame:
    """The same table, once Spark has had the chance to drop the shuffle files of the jobs before: it does so for plans that the driver's JVM has collected."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return df


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that stored() returned, once nothing reads them any more."""
    for df in tables:
        remove(df.sparkSession, df.stored_at)


def free_prefix(df: DataFrame, prefix: str) -> str:
    """The prefix, longer if need be, so that no column starts with it in any case: for columns of one's own beside the caller's."""
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix
