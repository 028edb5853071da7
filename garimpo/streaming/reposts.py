"""Repost removal on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from garimpo.operators.dedupe import repost_keys
from garimpo.streaming.batches import read_state, write_batch

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def dedupe_within(stream: DataFrame, ttl: str, event_time: str = "posted_at") -> DataFrame:
    """First *arrival* per repost key; keys are forgotten ``ttl`` after the watermark."""
    keyed = stream.withColumns(repost_keys()).withColumn(event_time, F.col(event_time).cast("timestamp"))
    return keyed.withWatermark(event_time, ttl).dropDuplicatesWithinWatermark(list(repost_keys()))


def stream_dedupe(stream: DataFrame, folder: str, checkpoint: str, order: str = "collect_seq") -> StreamingQuery:
    """First posting per repost key in (batch, collection) order, for all time.

    The state holds one row per key, the least by (time of the batch, ``order``, a NULL last), in
    RocksDB: a batch reads and writes the keys that come in it and no others, however many
    there are. A key of an earlier batch keeps its row and with it that batch's time, so what
    carries the time of this batch is new. The times are those of the checkpoint: a batch that is
    run again has the same. The state holds the columns of ``stream``; select those that are
    wanted before. ``order`` must be unique in a key; equal rows count as one.
    """
    spark = stream.sparkSession
    keys = list(repost_keys())
    place = F.struct(F.col("_batch").alias("batch"), F.col(order).isNull().alias("late"), F.col(order).alias("order"))
    row = F.struct(place.alias("place"), *[F.struct(*[F.col(c) for c in stream.columns]).alias("row")])
    first = stream.withColumns(repost_keys() | {"_batch": F.current_timestamp()}).groupBy(*keys).agg(F.min(row).alias("first"))
    new = first.filter(F.col("first.place.batch") == F.current_timestamp()).select("first.row.*", *keys)

    def handle(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, folder, batch_id)

    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, ROCKSDB)  # a query takes the settings it starts with
    try:
        return (
            new.writeStream.outputMode("update").foreachBatch(handle)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
    finally:
        spark.conf.set(provider, before)


def kept_postings(spark, folder: str, ddl: str) -> DataFrame:
    return read_state(spark, folder, ddl)
