"""State as append-only partitions, one per micro-batch, and their compaction.

``<folder>/batch=<id>`` is written by micro-batch ``id`` only and overwritten if that
batch is run again, so replays after a failure leave the same state. Nothing older
is ever rewritten: a batch costs what it adds.

After many batches ``compact`` merges all but the latest into one base. A base is a folder
of its own that says in its name up to which batch it reaches; it counts once a pointer
to it exists, and the pointer is one empty file, made after the base is complete. A reader
takes the highest pointer, or the batches themselves while there is none, so it sees the state
before or after a compaction and nothing between. What a base replaces is removed by
``vacuum``, a step of its own, when no reader of older versions is left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

SEED = -1
Merge = Callable[[DataFrame], DataFrame]


def seed(df: DataFrame, folder: str) -> None:
    """State before the first batch; does nothing if it is there."""
    if _current(df.sparkSession, folder) is None:
        df.write.mode("ignore").parquet(f"{folder}/batch={SEED}")


def write_batch(df: DataFrame, folder: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")


def read_state(spark: SparkSession, folder: str, ddl: str, before: int | None = None) -> DataFrame:
    """All stored batches, or those before one (whole directories are skipped).

    Compacted batches come as their base. A batch that is run again is the latest one,
    which no base holds, so what lies before it is always known.
    """
    base = _current(spark, folder)
    ids = _batches(spark, folder)
    if base is not None and before is not None and before <= base:
        raise ValueError(f"batch {before} is compacted: the state before it is not kept")
    if base is not None:
        ids = [i for i in ids if i > base]
    paths = [f"{folder}/batch={i}" for i in ids if before is None or i < before]
    paths += [_base(folder, base)] if base is not None else []
    if not paths:
        return spark.createDataFrame([], ddl)
    return spark.read.schema(ddl).parquet(*paths)


def compact(spark: SparkSession, folder: str, ddl: str, merge: Merge = lambda state: state, files: int = 0) -> int | None:
    """Merge all batches but the latest into a new base; the batch it reaches to, None if there is nothing to do.

    ``merge`` must give the same for a state and for its parts merged before. A compaction that
    fails leaves a folder without pointer: nothing reads it and the next one writes it anew.
    """
    base, ids = _current(spark, folder), _batches(spark, folder)
    upto = sorted(ids)[-2] if len(ids) > 1 else None
    if upto is None or upto <= (SEED if base is None else base):
        return None
    state = merge(read_state(spark, folder, ddl, before=upto + 1))
    (state.repartition(files) if files else state).write.mode("overwrite").parquet(_base(folder, upto))
    _point(spark, folder, upto)
    return upto


def vacuum(spark: SparkSession, folder: str) -> int:
    """Remove batches, bases and pointers that the current base replaces; how many folders went."""
    base = _current(spark, folder)
    if base is None:
        return 0
    old = [f"{folder}/batch={i}" for i in _batches(spark, folder) if i <= base]
    old += [_base(folder, i) for i in _numbers(spark, folder, "_base-") if i < base]
    for path in old + [f"{folder}/_upto-{i}" for i in _numbers(spark, folder, "_upto-") if i < base]:
        _files(spark, path)[0].delete(_files(spark, path)[1], True)
    return len(old)


# names that begin with an underscore are no data for Spark's readers of the folder itself
def _base(folder: str, upto: int) -> str:
    return f"{folder}/_base-{upto}"


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _numbers(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    system, where = _files(spark, folder)
    names = [s.getPath().getName() for s in system.listStatus(where)] if system.exists(where) else []
    return [int(n.removeprefix(prefix)) for n in names if n.startswith(prefix)]


def _batches(spark: SparkSession, folder: str) -> list[int]:
    return _numbers(spark, folder, "batch=")


def _current(spark: SparkSession, folder: str) -> int | None:
    return max(_numbers(spark, folder, "_upto-"), default=None)


def _point(spark: SparkSession, folder: str, upto: int) -> None:
    system, where = _files(spark, f"{folder}/_upto-{upto}")
    system.create(where, True).close()
