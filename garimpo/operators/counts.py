"""Stage counters, discard reasons and rule coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def stage_counts(flagged: DataFrame, flags: dict[str, str]) -> DataFrame:
    """Rows for which each boolean column holds, all in one aggregation."""
    return flagged.agg(
        F.count(F.lit(1)).alias("collected"),
        *[F.count_if(F.col(column)).alias(name) for name, column in flags.items()],
    )


def discard_reasons(discarded: DataFrame) -> DataFrame:
    return discarded.groupBy("stage", "reason").agg(F.count(F.lit(1)).alias("n"))


def label_coverage(labelled: DataFrame, labels: str = "labels") -> DataFrame:
    """Rows with at least one label, out of all."""
    return labelled.agg(
        F.count_if(F.size(labels) > 0).alias("covered"), F.count(F.lit(1)).alias("total")
    )


def label_frequency(labelled: DataFrame, labels: str = "labels") -> DataFrame:
    return (
        labelled.select(F.explode_outer(labels).alias("label")).filter(F.col("label").isNotNull())
        .groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    )
