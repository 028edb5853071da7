"""Keyed history: membership joins, upsert and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from garimpo.functions.numbers import is_relevant
from garimpo.functions.text import blank_to_null
from garimpo.schemas import HISTORY, HISTORY_COLUMNS, REFRESHED, USER_OWNED


def known_link_anti(df: DataFrame, history: DataFrame, link: str = "job_link") -> DataFrame:
    """Postings whose link is not in the history. Spark picks broadcast or shuffle by size."""
    return df.join(history.select(link), link, "left_anti").select(df.columns)


def known_link_semi(df: DataFrame, history: DataFrame, link: str = "job_link") -> DataFrame:
    return df.join(history.select(link), link, "left_semi").select(df.columns)


def _latest_of_batch(batch: DataFrame, order: str, relevant: Column) -> DataFrame:
    """Per link the last row; a batch normally holds a link once.

    A link counts as below the bar as soon as one of its rows is, because that row
    would already have been stored as such. A NULL order is the least.
    """
    columns = [c for c in REFRESHED if c in batch.columns]
    row = F.struct(*columns)
    return (
        batch.filter(blank_to_null(F.col("job_link")).isNotNull())
        .groupBy("job_link")
        .agg(F.max_by(row, F.struct(F.col(order).isNotNull(), F.col(order))).alias("new"), F.bool_and(relevant).alias("relevant"))
    )


def history_upsert(prior: DataFrame, batch: DataFrame, now: Column, order: str = "collect_seq",
                   relevant: Column | None = None) -> DataFrame:
    """Next state of the history after an analysed batch.

    Refreshed columns are overwritten, ``first_seen_at`` and the user's columns stay,
    a new posting below the bar starts as 'irrelevant', other entries pass through.
    Both sides are hashed on ``job_link`` once: the batch aggregation and the join
    share that partitioning, and a history table bucketed on it is not shuffled.
    Whether a posting is relevant is what the batch says in its column ``relevant``, if it
    has one; else the default thresholds decide.
    """
    if relevant is None:
        relevant = F.coalesce("relevant", F.lit(False)) if "relevant" in batch.columns else is_relevant(
            F.col("score_clt"), F.col("match_score")
        )
    new = _latest_of_batch(batch, order, relevant)
    old = prior.select("job_link", F.struct(*HISTORY_COLUMNS[1:]).alias("old"))
    joined = old.join(new, "job_link", "full_outer")
    touched = F.col("new").isNotNull()

    columns: list[Column] = [F.col("job_link")]
    for name in HISTORY_COLUMNS[1:]:
        before = F.col("old")[name]
        if name in REFRESHED:
            fresh = F.lit(None)
            if name in joined.schema["new"].dataType.names:
                fresh = F.col("new")[name]
            kind = prior.schema[name].dataType
            after = F.coalesce(fresh, F.lit(REFRESHED[name])).cast(kind)
        elif name == "first_seen_at":
            after = F.coalesce(before, now.cast("timestamp_ntz"))
        elif name == "last_processed_at":
            after = now.cast("timestamp_ntz")
        elif name == "status":
            after = F.coalesce(before, F.when(~F.col("relevant"), F.lit("irrelevant")))
        else:
            assert name in USER_OWNED
            after = before
        columns.append(F.when(touched, after).otherwise(before).alias(name))
    return joined.select(*columns)


def empty_history(spark) -> DataFrame:
    return spark.createDataFrame([], HISTORY)


def write_bucketed(history: DataFrame, table: str, buckets: int) -> None:
    """Store as a table hashed on ``job_link``; later joins on it skip that shuffle."""
    history.write.bucketBy(buckets, "job_link").sortBy("job_link").mode("overwrite").saveAsTable(table)
