"""Lineage cuts in the folder the cluster shares, and session settings."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_open = threading.local()


def shared_folder(spark: SparkSession) -> str:
    """Folder for checkpoints and staged tables: the one named by the session.

    A session that names none gets a subfolder of its warehouse, whatever its master.
    """
    folder = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if folder:
        return folder.rstrip("/")
    folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_garimpo"
    spark.conf.set(_SETTING, folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if getattr(_open, "scratch", None):
        _open.scratch[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Folders that this thread names inside are dropped at the end, also after an error."""
    held: list[str] = []
    _open.scratch = [*getattr(_open, "scratch", []), held]
    try:
        yield
    finally:
        _open.scratch = _open.scratch[:-1]
        for path in held:
            drop_folder(spark, path)


def settled(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What `make` returns, stored; the folders it has staged on its way are dropped."""
    path = new_folder(spark, name)
    with scratch(spark):
        return stage_at(make(), path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder that `new_folder` named, once nothing reads it any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later plans start from stored rows, and survive lost executors."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write once, read back: for results several sinks use (e.g. hook answers)."""
    return stage_at(df, new_folder(df.sparkSession, name))


def stage_at(df: DataFrame, path: str) -> DataFrame:
    """`stage` into a folder the caller drops when it is done with it."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
