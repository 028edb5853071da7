"""Incremental runs: each micro-batch triages only postings not handled before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from garimpo.operators.history import empty_history, history_upsert, known_link_anti
from garimpo.schemas import HISTORY
from garimpo.streaming.batches import compact, read_state, seed, write_batch


def stream_ingest(postings: DataFrame, history_folder: str, checkpoint: str,
                  analyse: Callable[[DataFrame], DataFrame], now: Column,
                  prior: DataFrame | None = None) -> StreamingQuery:
    """Drain the stream into the history folder.

    Known links are removed before ``analyse``, so a batch only ever adds entries; the
    older partitions are read for their link column alone. Links that come twice in a
    batch become one entry.
    """
    spark = postings.sparkSession
    seed(empty_history(spark) if prior is None else prior, history_folder)

    def handle(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        known = read_state(session, history_folder, HISTORY, before=batch_id)
        analysed = analyse(known_link_anti(batch, known))
        entries = history_upsert(empty_history(session), analysed, now)
        write_batch(entries, history_folder, batch_id)

    return (
        postings.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def compact_history(spark, history_folder: str, files: int = 0) -> int | None:
    """Bring the entries of all batches but the latest into few files; each link has one entry already."""
    return compact(spark, history_folder, HISTORY, files=files)


def history_state(spark, history_folder: str) -> DataFrame:
    return read_state(spark, history_folder, HISTORY)
