"""User status events: validation, folding into the current state, joining back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from garimpo import rules
from garimpo.functions.text import blank_to_null
from garimpo.schemas import USER_OWNED

MISSING_LINK = "missing link"
NOTHING = "nothing to update"
BAD_STATUS = "invalid status"
BAD_CLASS = "invalid error_class"
UNKNOWN_LINK = "unknown link"


def payload_problem() -> Column:
    """First rule a status event breaks; NULL when it is well formed."""
    status, notes, error = F.col("status"), F.col("notes"), F.col("error_class")
    return (
        F.when(blank_to_null(F.col("link")).isNull(), MISSING_LINK)
        .when(status.isNull() & notes.isNull() & error.isNull(), NOTHING)
        .when(~status.isin(*rules.STATUSES), BAD_STATUS)
        .when(~error.isin("", *rules.ERROR_CLASSES), BAD_CLASS)
    )


def event_validation(events: DataFrame, history: DataFrame) -> DataFrame:
    """Events plus ``problem``: NULL is valid, else the first failing rule.

    ``history`` must hold a link once; one outer join finds unknown links. Events that are
    decided already, blank links among them, pass through it under keys that no link has,
    spread by a hash, so that they neither match nor meet in one task.
    """
    judged = events.withColumn("_payload", payload_problem())
    aside = F.concat(F.lit("\x00"), F.pmod(F.xxhash64(*events.columns), F.lit(1 << 16)).cast("string"))
    key = F.when(F.col("_payload").isNull(), F.col("link")).otherwise(aside)
    known = history.select(F.col("job_link").alias("_key"), F.lit(True).alias("_known"))
    unknown = F.when(F.col("_known").isNull(), F.lit(UNKNOWN_LINK))
    joined = judged.withColumn("_key", key).join(known, "_key", "left")
    return joined.select(*events.columns, F.coalesce("_payload", unknown).alias("problem"))


def valid_events(validated: DataFrame) -> DataFrame:
    return validated.filter(F.col("problem").isNull()).drop("problem")


def rejected_events(validated: DataFrame) -> DataFrame:
    return validated.filter(F.col("problem").isNotNull())


_FIELDS = ("status", "error_class", "notes")


def status_delta(events: DataFrame) -> DataFrame:
    """Last assignment of each field per link, with its place in the event order.

    An aggregation with partial sums, so a link with very many events is reduced in
    the map tasks. Deltas merge with :func:`merge_deltas` in any grouping.
    """
    order = F.struct("ts", "seq")
    cleared = F.when(F.col("status").isNotNull() & (F.col("status") != "error"), F.lit(""))
    assigned = {
        "status": F.col("status"),
        "error_class": F.coalesce(F.col("error_class"), cleared),
        "notes": F.left(F.col("notes"), F.lit(rules.NOTES_LENGTH)),
    }
    changes = events.select(
        F.col("link").alias("job_link"),
        order.alias("_at"),
        *[v.alias(n) for n, v in assigned.items()],
    )
    aggregates = [F.max("_at").alias("updated_at")]
    for name in _FIELDS:
        at = F.when(F.col(name).isNotNull(), F.col("_at"))
        aggregates += [F.max_by(name, at).alias(name), F.max(at).alias(f"{name}_at")]
    return changes.groupBy("job_link").agg(*aggregates)


def merge_deltas(deltas: DataFrame) -> DataFrame:
    aggregates = [F.max("updated_at").alias("updated_at")]
    for name in _FIELDS:
        at = F.col(f"{name}_at")
        aggregates += [F.max_by(name, at).alias(name), F.max(at).alias(f"{name}_at")]
    return deltas.groupBy("job_link").agg(*aggregates)


def current_status(delta: DataFrame) -> DataFrame:
    return delta.select(
        "job_link", "status", "error_class", "notes",
        F.col("updated_at")["ts"].alias("status_updated_at"),
    )


def status_fold(events: DataFrame) -> DataFrame:
    """Current status, error class, notes and update time per link from valid events."""
    return current_status(status_delta(events))


def apply_status(history: DataFrame, folded: DataFrame) -> DataFrame:
    """History with folded values on top; fields no event assigned keep theirs."""
    news = folded.select("job_link", *[F.col(c).alias(f"_{c}") for c in USER_OWNED])
    return history.join(news, "job_link", "left").select(
        *[
            F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in USER_OWNED else F.col(c)
            for c in history.columns
        ]
    )
