"""History of which a run rewrites only the buckets it touches."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from garimpo.operators import history, history_store

NOW, LATER = dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 2)


def batch(spark, first, last, score=80):
    return spark.range(first, last).select(
        F.col("id").alias("collect_seq"), F.concat(F.lit("https://job/"), "id").alias("job_link"),
        F.lit("t").alias("job_title"), F.lit(score).alias("match_score"), F.lit(0.9).alias("score_clt"),
    )


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def folder(spark, tmp_path):
    path = str(tmp_path / "history")
    history_store.create(history.history_upsert(history.empty_history(spark), batch(spark, 0, 400), F.lit(NOW)), path, 16)
    return path


def files_of(path):
    return {str(p): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_state_is_that_of_the_whole_upsert(spark, folder):
    whole = history_store.read(spark, folder)
    assert whole.count() == 400
    for step in (batch(spark, 395, 405, 10), batch(spark, 0, 1), batch(spark, 390, 391), batch(spark, 500, 700)):
        expected = rows(history.history_upsert(history_store.read(spark, folder), step, F.lit(LATER)))
        history_store.upsert(step, folder, F.lit(LATER))
        assert rows(history_store.read(spark, folder)) == expected
        history_store.vacuum(spark, folder)
        assert rows(history_store.read(spark, folder)) == expected


def test_untouched_buckets_are_neither_read_nor_written(spark, folder, tmp_path):
    before = files_of(tmp_path)
    touched = history_store.upsert(batch(spark, 7, 9), folder, F.lit(LATER))
    assert 1 <= len(touched) <= 2
    after = files_of(tmp_path)
    assert {k: after[k] for k in before} == before
    written = {int(re.search(r"bucket=(\d+)", p)[1]) for p in after.keys() - before.keys()}
    assert written == touched
    read = history_store.read(spark, folder, touched).inputFiles()
    assert read and {int(re.search(r"bucket=(\d+)", p)[1]) for p in read} == touched
    assert all("/v=1/" in p for p in read)


def test_a_run_that_fails_before_its_pointer_changes_nothing(spark, folder, monkeypatch):
    before = rows(history_store.read(spark, folder))
    with monkeypatch.context() as m:
        m.setattr(history_store, "_mark", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            history_store.upsert(batch(spark, 0, 50, 1), folder, F.lit(LATER))
    assert rows(history_store.read(spark, folder)) == before
    history_store.upsert(batch(spark, 0, 2), folder, F.lit(LATER))  # writes the same version anew
    assert history_store.read(spark, folder).filter("last_processed_at > '2026-01-01'").count() == 2


def test_empty_histories_batches_and_links(spark, tmp_path):
    path = str(tmp_path / "none")
    with pytest.raises(ValueError):
        history_store.upsert(batch(spark, 0, 1), path, F.lit(NOW))
    history_store.create(history.empty_history(spark), path, 4)
    assert history_store.read(spark, path).count() == 0
    assert history_store.upsert(batch(spark, 0, 0), path, F.lit(NOW)) == set()
    no_link = batch(spark, 0, 2).withColumn("job_link", F.when(F.col("collect_seq") == 0, F.lit("")))
    assert history_store.upsert(no_link, path, F.lit(NOW)) == set()
    assert len(history_store.upsert(batch(spark, 0, 100), path, F.lit(NOW))) == 4
    assert history_store.read(spark, path).count() == 100
    with pytest.raises(ValueError):
        history_store.create(history.empty_history(spark), path, 8)
