"""Status events as a stream; the event log is the truth, the current state is derived."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from garimpo import runtime
from garimpo.operators.status import (
    current_status, event_validation, merge_deltas, rejected_events, status_delta, valid_events,
)
from garimpo.schemas import STATUS_EVENT
from garimpo.streaming.batches import compact, read_state, write_batch

_AT = "struct<ts:timestamp_ntz,seq:bigint>"
DELTA = (
    f"job_link string, updated_at {_AT}, status string, status_at {_AT}, error_class string, "
    f"error_class_at {_AT}, notes string, notes_at {_AT}"
)


def stream_status(events: DataFrame, history: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Validate each micro-batch; store its folded delta and its rejected events.

    A delta has one row per touched link, so merging stays cheap however many
    events a link has; merged deltas equal one fold over all events.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        # stored once: source, rules and join run a single time for both outputs
        path = runtime.new_folder(batch.sparkSession, "checked")
        checked = runtime.stage_at(event_validation(batch, history), path)
        write_batch(status_delta(valid_events(checked)), f"{folder}/deltas", batch_id)
        write_batch(rejected_events(checked), f"{folder}/rejected", batch_id)
        runtime.drop_folder(batch.sparkSession, path)

    return (
        events.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def status_state(spark: SparkSession, folder: str) -> DataFrame:
    return current_status(merge_deltas(read_state(spark, f"{folder}/deltas", DELTA)))


def compact_status(spark: SparkSession, folder: str) -> int | None:
    """Merge the stored deltas but the latest: one row a link, whatever the number of batches."""
    return compact(spark, f"{folder}/deltas", DELTA, merge_deltas)


def rejected_log(spark: SparkSession, folder: str) -> DataFrame:
    return read_state(spark, f"{folder}/rejected", STATUS_EVENT + ", problem string")
