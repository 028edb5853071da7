"""A stored history of which a run rewrites only what it touches.

Entries lie in buckets by a hash of their link: ``<folder>/v=<n>/bucket=<b>``. A version
holds the buckets that its batch touched, and of each bucket the latest version counts.
A version counts once a pointer to it exists, one empty file made after its buckets are
complete: readers see the state before or after a run and nothing between, and a run that
fails leaves a folder that the next one writes anew. What later versions replace is removed
by `vacuum`, when no reader of older versions is left. One run writes at a time; of two, the
second fails at its pointer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from garimpo.functions.text import blank_to_null
from garimpo.operators.history import empty_history, history_upsert
from garimpo.schemas import HISTORY, HISTORY_COLUMNS


def create(history: DataFrame, folder: str, buckets: int) -> None:
    """Store a history, empty or not, as version 0; the number of buckets is fixed from then on.

    A bucket is read and written by one task: choose them so that one fits, some 100 MB.
    """
    spark = history.sparkSession
    if _numbers(spark, folder, "_upto-"):
        raise ValueError(f"{folder} holds a history")
    _mark(spark, f"{folder}/_buckets-{buckets}")
    _write(history, folder, 0, buckets)


def read(spark: SparkSession, folder: str, only: set[int] | None = None) -> DataFrame:
    """The history, or its entries in some buckets: no other folder is opened."""
    paths = [f"{folder}/v={v}/bucket={b}" for b, v in sorted(_latest(spark, folder).items()) if only is None or b in only]
    return spark.read.schema(HISTORY).parquet(*paths) if paths else empty_history(spark)


def upsert(batch: DataFrame, folder: str, now: Column, order: str = "collect_seq", relevant: Column | None = None) -> set[int]:
    """`history_upsert` of the buckets that hold a link of ``batch``, which should be stored; those buckets.

    The driver sees the numbers of the buckets, never links. An empty batch writes nothing.
    """
    spark = batch.sparkSession
    buckets = _buckets(spark, folder)
    linked = batch.filter(blank_to_null(F.col("job_link")).isNotNull())
    touched = {r.bucket for r in linked.select(_bucket(buckets)).distinct().collect()}
    if touched:
        after = history_upsert(read(spark, folder, touched), batch, now, order, relevant)
        _write(after, folder, max(_numbers(spark, folder, "_upto-")) + 1, buckets)
    return touched


def vacuum(spark: SparkSession, folder: str) -> int:
    """Remove buckets that a later version replaces and versions without pointer; how many folders went."""
    latest, known = _latest(spark, folder), set(_numbers(spark, folder, "_upto-"))
    old = []
    for v in _numbers(spark, folder, "v="):
        if v not in known:
            old.append(f"{folder}/v={v}")
        else:
            old += [f"{folder}/v={v}/bucket={b}" for b in _numbers(spark, f"{folder}/v={v}", "bucket=") if latest[b] != v]
    for path in old:
        _files(spark, path)[0].delete(_files(spark, path)[1], True)
    return len(old)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("job_link"), F.lit(buckets)).cast("int").alias("bucket")


def _write(history: DataFrame, folder: str, version: int, buckets: int) -> None:
    dealt = history.select(*HISTORY_COLUMNS, _bucket(buckets)).repartition("bucket")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/v={version}")
    _mark(history.sparkSession, f"{folder}/_upto-{version}")


def _latest(spark: SparkSession, folder: str) -> dict[int, int]:
    """Per bucket the version that counts."""
    versions = sorted(_numbers(spark, folder, "_upto-"))
    return {b: v for v in versions for b in _numbers(spark, f"{folder}/v={v}", "bucket=")}


def _buckets(spark: SparkSession, folder: str) -> int:
    if not _numbers(spark, folder, "_upto-"):
        raise ValueError(f"{folder} holds no history: create it first")
    return _numbers(spark, folder, "_buckets-")[0]


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _numbers(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    system, where = _files(spark, folder)
    names = [s.getPath().getName() for s in system.listStatus(where)] if system.exists(where) else []
    return [int(n.removeprefix(prefix)) for n in names if n.startswith(prefix)]


def _mark(spark: SparkSession, path: str) -> None:
    """An empty file that must not be there yet."""
    system, where = _files(spark, path)
    system.create(where, False).close()
