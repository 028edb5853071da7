"""Sorts and ranks of whole tables without a one-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from garimpo import rules
from garimpo.functions.numbers import score_of
from garimpo.runtime import cut_lineage

BLOCK = 1 << 20
NULL_BLOCKS = 1 << 12


def position_in_group(df: DataFrame, group: Column, seq: str, position: str, *ties: str,
                      block: int = BLOCK, upto: int | None = None) -> DataFrame:
    """1-based position within a group by the integer ``seq``, for groups of any size.

    Rows are counted per (group, seq block). As ``seq`` is unique in a group, a block
    holds at most ``block`` rows whatever the skew, so numbering inside a block is a
    cheap window; block starts are running sums over the small table of counts. Rows
    without ``seq`` come last, dealt to ``NULL_BLOCKS`` blocks by a hash of their ``ties`` and
    in the order of ``ties`` inside a block. With ``upto``, blocks that begin beyond it are
    left out before the window.
    """
    last = F.lit((1 << 62) // block) + F.pmod(F.xxhash64(*ties), F.lit(NULL_BLOCKS))
    keyed = df.withColumn("_group", group).withColumn(
        "_block", F.coalesce(F.floor(F.col(seq) / F.lit(block)).cast("long"), last)
    )
    counts = keyed.groupBy("_group", "_block").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_group").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col("_group").alias("_g"), F.col("_block").alias("_b"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start")
    )
    if upto is not None:
        starts = starts.filter(F.col("_start") < upto)
    inside = Window.partitionBy("_group", "_block").orderBy(F.col(seq).asc_nulls_last(), *ties)
    return (
        keyed.join(starts, F.col("_group").eqNullSafe(F.col("_g")) & (F.col("_block") == F.col("_b")))
        .withColumn(position, F.col("_start") + F.row_number().over(inside))
        .drop("_block", "_start", "_g", "_b")
    )


def rank_by_score(df: DataFrame, score: Column, seq: str = "collect_seq", rank: str = "rank",
                  ties: tuple[str, ...] = ("job_link",)) -> DataFrame:
    """1-based position of every row by score (descending, NULL as 0), then by ``seq`` (NULL
    last) and those of ``ties`` that the rows have.

    One range-partitioned sort on all of them, so neither one score nor one place with most
    rows is a task of its own.
    """
    order = [F.desc("_score"), F.col(seq).asc_nulls_last(), *[t for t in ties if t in df.columns]]
    scored = df.withColumn("_score", F.coalesce(score, F.lit(0)))
    return with_position(scored.orderBy(*order), rank).select(*df.columns, rank)


def report_rank(df: DataFrame, seq: str = "collect_seq") -> DataFrame:
    """Report position: match score descending, ties in collection order."""
    return rank_by_score(df, score_of(F.col("match_score")), seq, "report_rank")


def score_sort(df: DataFrame, *ties: str) -> DataFrame:
    """Match score descending, anything that is no number counts as 0."""
    return df.orderBy(F.desc(score_of(F.col("match_score"))), *ties)


# Kind of each sortable column of the list view.
SORT_KINDS = {
    "status": "status", "match_score": "num", "score_clt": "num", "job_title": "str",
    "inferred_contract_type": "str", "workplace_type": "str", "location": "str",
    "error_class": "str", "first_seen_at": "date", "notes": "str",
}
OTHER_STATUS_RANK = 99


def sort_key(column: str) -> Column:
    kind, value = SORT_KINDS[column], F.col(column)
    if kind == "num":
        number = value.try_cast("double")
        return F.coalesce(F.when(~F.isnan(number), number), F.lit(float("-inf")))
    if kind == "status":
        result = F.lit(OTHER_STATUS_RANK)
        for name, place in rules.STATUS_RANK.items():
            result = F.when(value == name, F.lit(place)).otherwise(result)
        return result
    if kind == "date":
        return F.coalesce(value.cast("string"), F.lit(""))
    return F.collate(F.coalesce(value, F.lit("")), "pt_CI_AI")


def sort_order(column: str = "first_seen_at", direction: str | None = None) -> Column:
    """Text columns start ascending, all others descending."""
    ascending = direction == "asc" if direction else SORT_KINDS[column] == "str"
    return sort_key(column).asc() if ascending else sort_key(column).desc()


def typed_sort(df: DataFrame, column: str = "first_seen_at", direction: str | None = None,
               ties: tuple[str, ...] = ("first_seen_at", "job_link")) -> DataFrame:
    """List-view sort, a range-partitioned sort on the typed key."""
    return df.orderBy(sort_order(column, direction), *ties)


def with_position(ordered: DataFrame, position: str = "position") -> DataFrame:
    """Number the rows of a totally ordered DataFrame from 1.

    The sort numbers rows inside its range partitions; the stored result is then
    shifted by the row counts of the partitions before (one row per partition).
    """
    numbered = cut_lineage(ordered.withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    sizes = numbered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select(
        "_part",
        F.coalesce(
            F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("_start"),
    )
    local = F.col("_id") - F.shiftleft(F.col("_part"), 33)
    return (
        numbered.withColumn("_part", part)
        .join(starts, "_part")
        .withColumn(position, F.col("_start") + local + 1)
        .select(*ordered.columns, position)
    )
