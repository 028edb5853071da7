"""Helpers the corpus operators share: row numbers, running sums and components at scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from garimpo import runtime

ROWS_PER_BLOCK = 1 << 11


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks_for(rows: int, rows_per_block: int = ROWS_PER_BLOCK) -> int:
    return max(1, -(-rows // rows_per_block))


def numbered(
    df: DataFrame, name: str, by: list[str], key: Column, order: list[Column], blocks: int
) -> DataFrame:
    """Column `name`: gapless numbers from 0 within `by`, in the order of hash blocks of `key`.

    Rows of one group are numbered in `blocks` independent blocks; only one count per
    (group, block) meets in a window, so a group with most rows is no single task.
    Rows that agree in `key` and `order` get neighbouring numbers in any order.
    """
    block = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    rows = df.withColumn("_block", block)
    counts = rows.groupBy(*by, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)],
        F.col("_block").alias("_start_block"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
    )
    same = F.col("_block") == F.col("_start_block")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    within = Window.partitionBy(*by, "_block").orderBy(*order)
    return (
        rows.withColumn("_row", F.row_number().over(within) - 1)
        .join(starts, same, "left")
        .withColumn(name, (F.col("_start") + F.col("_row")).cast("long"))
        .drop("_block", "_row", "_start", "_start_block", *[f"_by{i}" for i in range(len(by))])
    )


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): smallest node that links reach, for each node of `edges` (a long, b long).

    Alternates large-star and small-star steps. Each step is an aggregation with a map-side
    half and joins on node ids; the stored edges of the round before are dropped. A hub with
    very many links is split by AQE, as its minimum has one row per node.
    """
    spark = edges.sparkSession
    small = F.least("a", "b")
    large = F.greatest("a", "b")
    path = runtime.new_folder(spark, "links")
    now = runtime.stage_at(
        edges.filter(F.col("a") != F.col("b")).select(small.alias("a"), large.alias("b")).distinct(), path
    )
    for _ in range(max_rounds):
        # large-star: larger neighbours of a node point to the smallest node around it
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        starred = (
            both.filter(F.col("b") > F.col("a")).join(lowest, "a")
            .select(F.col("m").alias("a"), "b")
            .filter(F.col("a") != F.col("b")).distinct()
        )
        # small-star: a node and its smaller neighbours point to the smallest of them
        parent = starred.groupBy("b").agg(F.min("a").alias("m"))
        joined = starred.join(parent, "b")
        linked = joined.select(F.col("m").alias("a"), F.col("a").alias("b")).unionAll(
            joined.select(F.col("m").alias("a"), "b")
        )
        new_path = runtime.new_folder(spark, "links")
        new = runtime.stage_at(linked.filter(F.col("a") != F.col("b")).distinct(), new_path)
        # done when every node has one parent and no parent has one itself
        tangled = (
            new.groupBy("b").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("b")
            .unionAll(new.select(F.col("a").alias("b")).distinct().join(new.select("b").distinct(), "b", "left_semi"))
        )
        done = tangled.isEmpty()
        runtime.drop_folder(spark, path)
        now, path = new, new_path
        if done:
            break
    else:
        raise RuntimeError("components did not settle")
    members = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return members.unionAll(members.select(F.col("root").alias("node"), "root").distinct())
