"""Streams over several micro-batches equal the batch result; replays change nothing."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from garimpo import schemas
from garimpo.operators import dedupe, history, status
from garimpo.streaming import batches, ingest, reposts, status_log

NOW = dt.datetime(2026, 1, 2, 3, 4, 5)
POSTING = "collect_seq long, job_link string, job_title string, company string, posted_at timestamp"


def split_files(df, folder, order, parts):
    """One file per range of ``order``, written one after the other."""
    bounds = [r[0] for r in df.select(order).orderBy(order).collect()]
    step = -(-len(bounds) // parts)
    for i in range(parts):
        chunk = bounds[i * step:(i + 1) * step]
        part = df.filter(F.col(order).between(chunk[0], chunk[-1])).coalesce(1)
        part.write.mode("append").parquet(folder)


def stream_of(spark, df, folder):
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def make_postings(spark, n=60):
    rows = [(i, f"l{i % 40}", f"Títle {i % 7}", f"ACME {i % 3}", NOW + dt.timedelta(hours=i)) for i in range(n)]
    return spark.createDataFrame(rows, POSTING)


def test_stream_dedupe(spark, tmp_path):
    df = make_postings(spark)
    split_files(df, str(tmp_path / "in"), "collect_seq", 4)
    stream = stream_of(spark, df, str(tmp_path / "in"))
    reposts.stream_dedupe(stream, str(tmp_path / "kept"), str(tmp_path / "cp")).awaitTermination()
    kept = reposts.kept_postings(spark, str(tmp_path / "kept"), "collect_seq long, job_link string")
    expected = dedupe.dedupe_reposts(df).select("collect_seq", "job_link")
    assert sorted(kept.collect()) == sorted(expected.collect())


def test_a_batch_touches_only_its_own_keys(spark, tmp_path):
    """Thirty batches with growing state: each updates as many rows as it has keys, and nothing reads what is stored."""
    rows = [(i, f"l{i}", f"t{i % 10 if i % 50 < 10 else i}", "c", NOW) for i in range(1500)]
    df = spark.createDataFrame(rows[::-1], POSTING)
    split_files(df, str(tmp_path / "in"), "collect_seq", 30)
    query = reposts.stream_dedupe(stream_of(spark, df, str(tmp_path / "in")), str(tmp_path / "kept"), str(tmp_path / "cp"))
    query.awaitTermination()
    told = [p["stateOperators"][0] for p in query.recentProgress if p["numInputRows"]]
    assert len(told) == 30 and {s["numRowsUpdated"] for s in told} == {50} and told[-1]["numRowsTotal"] == 10 + 30 * 40
    kept = reposts.kept_postings(spark, str(tmp_path / "kept"), "collect_seq long, job_link string")
    assert sorted(kept.collect()) == sorted(dedupe.dedupe_reposts(df).select("collect_seq", "job_link").collect())
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    # a second run knows the keys of the first
    late = spark.createDataFrame([(9000, "x", "t1", "C", NOW), (9001, "y", "new", "c", NOW), (None, "z", "new", "c", NOW), (None, "v", None, "", NOW)], POSTING)
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    reposts.stream_dedupe(stream_of(spark, df, str(tmp_path / "in")), str(tmp_path / "kept"), str(tmp_path / "cp")).awaitTermination()
    more = reposts.kept_postings(spark, str(tmp_path / "kept"), "collect_seq long, job_link string").collect()
    assert {r.job_link for r in more} - {r.job_link for r in kept.filter("collect_seq < 9000").collect()} == {"y", "v"}


def test_a_batch_run_again_keeps_the_same_rows(spark, tmp_path):
    df = make_postings(spark)
    split_files(df, str(tmp_path / "in"), "collect_seq", 3)
    real, seen = reposts.write_batch, []

    def fails(batch, folder, batch_id):
        real(batch, folder, batch_id)
        seen.append(batch_id)
        if seen.count(1) == 1 and batch_id == 1:
            raise RuntimeError("lost")

    reposts.write_batch = fails
    try:
        for _ in range(2):
            query = reposts.stream_dedupe(stream_of(spark, df, str(tmp_path / "in")), str(tmp_path / "kept"), str(tmp_path / "cp"))
            try:
                query.awaitTermination()
            except Exception:
                assert seen == [0, 1]
    finally:
        reposts.write_batch = real
    assert seen == [0, 1, 1, 2]
    kept = reposts.kept_postings(spark, str(tmp_path / "kept"), "collect_seq long, job_link string")
    assert sorted(kept.collect()) == sorted(dedupe.dedupe_reposts(df).select("collect_seq", "job_link").collect())


def test_compaction(spark, tmp_path, monkeypatch):
    folder, ddl = str(tmp_path / "state"), "k string, n long"

    def write(batch):
        rows = [(f"k{i}", batch * 100 + i) for i in range(batch % 3, 8)]
        batches.write_batch(spark.createDataFrame(rows, ddl), folder, batch)

    def merge(state):
        return state.groupBy("k").agg(F.max("n").alias("n"))

    def state():
        return sorted(tuple(r) for r in merge(batches.read_state(spark, folder, ddl)).collect())

    assert batches.read_state(spark, folder, ddl).count() == 0 and batches.vacuum(spark, folder) == 0
    batches.seed(spark.createDataFrame([("old", 1)], ddl), folder)
    assert batches.compact(spark, folder, ddl, merge) is None
    for batch in range(4):
        write(batch)
    wanted = state()
    # a failure between the base and its pointer loses nothing
    with monkeypatch.context() as patch:
        patch.setattr(batches, "_point", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        try:
            batches.compact(spark, folder, ddl, merge)
        except OSError:
            pass
    assert state() == wanted and batches.read_state(spark, folder, ddl).count() > len(wanted) + 8
    before = batches.read_state(spark, folder, ddl)
    assert batches.compact(spark, folder, ddl, merge, files=2) == 2 and state() == wanted
    assert sorted(tuple(r) for r in merge(before).collect()) == wanted  # a reader of the version before goes on
    assert batches.compact(spark, folder, ddl, merge) is None
    write(3)  # the latest batch once more
    assert state() == wanted
    assert batches.read_state(spark, folder, ddl, before=3).count() == 9
    for batch in (4, 5):
        write(batch)
    wanted = state()
    assert batches.compact(spark, folder, ddl, merge) == 4 and state() == wanted
    assert batches.vacuum(spark, folder) == 7 and state() == wanted
    batches.seed(spark.createDataFrame([("other", 1)], ddl), folder)
    assert sorted(p.name for p in tmp_path.joinpath("state").iterdir() if not p.name.startswith(".")) == ["_base-4", "_upto-4", "batch=5"]
    assert state() == wanted


def test_dedupe_within_watermark(spark, tmp_path):
    df = make_postings(spark)
    split_files(df, str(tmp_path / "in"), "collect_seq", 3)
    query = (
        reposts.dedupe_within(stream_of(spark, df, str(tmp_path / "in")), "90 days").writeStream.format("parquet")
        .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    keys = ["key_title", "key_company"]
    kept = spark.read.parquet(str(tmp_path / "out"))
    assert kept.count() == kept.select(keys).distinct().count() == dedupe.dedupe_reposts(df).count()


def scored(batch):
    return batch.withColumns({"match_score": (F.col("collect_seq") * 7 % 101).cast("int"), "score_clt": F.lit(0.9)})


def test_stream_ingest_and_replay(spark, tmp_path):
    df = make_postings(spark).dropDuplicates(["job_link"]).cache()
    prior = history.history_upsert(history.empty_history(spark), scored(df.filter("collect_seq < 5")), F.lit(NOW - dt.timedelta(1)))
    split_files(df, str(tmp_path / "in"), "collect_seq", 4)
    folder = str(tmp_path / "history")
    seen = []

    def analyse(batch):
        seen.append(batch.count())
        return scored(batch)

    args = (folder, str(tmp_path / "cp"), analyse, F.lit(NOW), prior)
    ingest.stream_ingest(stream_of(spark, df, str(tmp_path / "in")), *args).awaitTermination()
    state = ingest.history_state(spark, folder)
    fresh = history.known_link_anti(df, prior)
    expected = history.history_upsert(prior, scored(fresh), F.lit(NOW))
    columns = schemas.HISTORY_COLUMNS
    assert sorted(map(str, state.select(columns).collect())) == sorted(map(str, expected.select(columns).collect()))
    assert sum(seen) == fresh.count() and len(seen) > 1
    # The last batch once more, as after a failure: same state.
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "history").glob("batch=*"))
    again = spark.read.schema(schemas.HISTORY).parquet(f"{folder}/batch={last}")
    rows = spark.createDataFrame(again.collect(), again.schema)
    batches.write_batch(rows, folder, last)
    assert ingest.history_state(spark, folder).count() == expected.count()
    assert ingest.compact_history(spark, folder, files=1) == last - 1
    assert sorted(map(str, ingest.history_state(spark, folder).select(columns).collect())) == sorted(map(str, expected.select(columns).collect()))
    # A second run finds only known links.
    split_files(df, str(tmp_path / "in"), "collect_seq", 2)
    seen.clear()
    ingest.stream_ingest(stream_of(spark, df, str(tmp_path / "in")), *args).awaitTermination()
    assert len(seen) == 2 and sum(seen) == 0
    assert ingest.history_state(spark, folder).count() == expected.count()
    # Another checkpoint would number its batches from 0: the state before those is not kept.
    with pytest.raises(Exception, match="is compacted"):
        ingest.stream_ingest(stream_of(spark, df, str(tmp_path / "in")), folder, str(tmp_path / "cp2"), analyse, F.lit(NOW), prior).awaitTermination()


def test_stream_status(spark, tmp_path):
    rows = [(i, NOW + dt.timedelta(seconds=i // 2), f"j{i % 4}", ("new", "viewed", "error", None)[i % 4 - i % 3],
             f"n{i}" if i % 5 == 0 else None, "" if i % 7 == 0 else None) for i in range(80)]
    events = spark.createDataFrame(rows, schemas.STATUS_EVENT)
    past = history.empty_history(spark).unionByName(
        spark.createDataFrame([(f"j{i}",) for i in range(3)], "job_link string"), allowMissingColumns=True
    )
    split_files(events, str(tmp_path / "in"), "seq", 4)
    stream = stream_of(spark, events, str(tmp_path / "in"))
    status_log.stream_status(stream, past, str(tmp_path / "st"), str(tmp_path / "cp")).awaitTermination()
    checked = status.event_validation(events, past)
    expected = status.status_fold(status.valid_events(checked))
    found = status_log.status_state(spark, str(tmp_path / "st"))
    assert sorted(map(str, found.select(expected.columns).collect())) == sorted(map(str, expected.collect()))
    assert status_log.compact_status(spark, str(tmp_path / "st")) == 2
    assert sorted(map(str, status_log.status_state(spark, str(tmp_path / "st")).select(expected.columns).collect())) == sorted(map(str, expected.collect()))
    rejected = status_log.rejected_log(spark, str(tmp_path / "st"))
    assert rejected.count() == status.rejected_events(checked).count() > 0


def test_files_of_a_micro_batch_grow_with_the_table(spark, tmp_path, monkeypatch):
    """Four files whatever the table: no more tasks than that took a batch through the rules."""
    from workload import table_queries

    monkeypatch.setattr(table_queries, "ROWS_PER_FILE", 100)
    monkeypatch.setattr(table_queries.runtime, "new_folder", lambda _, name: str(tmp_path / name))
    spark.range(3_000).selectExpr("id AS event_id").write.parquet(str(tmp_path / "events.parquet"))
    stream, batches_seen = table_queries._stream(spark, str(tmp_path), "events", "event_id"), []

    def see(batch, _):
        batches_seen.append(sorted({r.event_id % 3 for r in batch.collect()}))

    stream.writeStream.foreachBatch(see).option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start().awaitTermination()
    assert batches_seen == [[0], [1], [2]]
    assert len(list((tmp_path / "source").glob("*.parquet"))) == 30 and table_queries._files(900) == 4
