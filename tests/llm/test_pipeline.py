"""The pipeline's stages against brute force, and the registered queries."""

import glob
import os

import pytest

import corpus_pipeline
from garimpo.llm import queries

TEN = {f"op{n}_" for n in range(1, 14)}


def test_every_operator_and_the_pipeline_are_registered():
    assert {q.split("_")[0] + "_" for q in queries.QUERIES if q != "pipeline"} == TEN and "pipeline" in queries.QUERIES
    assert set(queries.ORACLES) <= set(queries.QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact", "near", "mix", "pack"]


def test_stages(spark, docs, corpus):
    kept = docs
    ids = {r.doc_id: r.text for r in docs.collect()}
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = kept
        kept = corpus_pipeline.runtime.stage(stage(spark, kept, ""), name)
        seen.append((name, before, kept))
        if name != "pack":
            assert kept.columns == docs.columns
    found = {name: [r.doc_id for r in after.select("doc_id").collect()] for name, _, after in seen}
    no_letter = {i for i, t in ids.items() if not any(c.isalpha() for c in t or "")}
    assert not no_letter & set(found["language"]) and len(found["language"]) >= 0.8 * (len(ids) - len(no_letter))
    last = {}
    for i in found["language"]:
        last[ids[i]] = max(i, last.get(ids[i], i))
    assert sorted(found["exact"]) == sorted(last.values())

    def shingles(t):
        w = t.encode().split()
        return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))

    sets = {i: shingles(ids[i]) for i in found["exact"]}
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            shared = len(sets[a] & sets[b])
            if a < b and 5 * shared >= 4 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    assert sorted(found["near"]) == sorted(i for i in sets if top(i) == i)
    assert set(found["mix"]) <= set(found["near"]) and max(found["mix"].count(i) for i in found["mix"]) <= 3
    assert set(found["pack"]) == set(found["mix"])
    words = sum(len(ids[i].encode().split()) for i in found["mix"])
    assert sum(r["size"] for r in seen[-1][2].collect()) == words


def test_stages_of_repeated_rows(spark, repeated):
    rows = repeated.filter("text IS NOT NULL")
    texts = {r.text for r in rows.collect()}
    one = corpus_pipeline.identify_language(spark, repeated, "").collect()
    count = {t: sum(r.text == t for r in rows.collect()) for t in texts}
    assert one and all(sum(r.text == t for r in one) == count[t] for t in {r.text for r in one})
    assert any(r.doc_id is None for r in one)
    exact = corpus_pipeline.drop_exact_copies(spark, rows, "").collect()
    best = {}
    for r in rows.collect():
        best[r.text] = max(best.get(r.text, -1), -1 if r.doc_id is None else r.doc_id)
    assert sorted(r.text for r in exact) == sorted(texts)
    assert {r.text: -1 if r.doc_id is None else r.doc_id for r in exact} == best
    near = corpus_pipeline.drop_near_copies(spark, rows, "").collect()
    assert sorted(r.text for r in near) == sorted(texts)  # none of these texts is like another


def test_a_verdict_holds_for_its_row_alone(spark):
    long = "one two three four five six seven eight nine ten " * 3
    rows = [(1, long, "en", "s"), (2, long, "en", "s"), (1, "another text of that id", "en", "s"), (None, "a text without id", "en", "s"), (None, long, "en", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.drop_exact_copies(spark, df, "").collect())
    assert found == [(0, "a text without id"), (1, "another text of that id"), (2, long)]
    mixed = corpus_pipeline.mix_sources(spark, df, "").collect()
    assert any(r.doc_id is None for r in mixed)
    words = sum(len(t.split()) for _, t, _, _ in rows)
    assert abs(sum(len(r.text.split()) for r in mixed) - words) <= 30


def test_clashing_columns_come_through(spark):
    """Columns named as the helpers are keep their values through all stages but the last."""
    long = "one two three four five six seven eight nine ten " * 3
    rows = [(i, f"{long} and {i} " * (1 + n), "en", "s", 10 + n, "c", 20 + n, 30 + n, 40 + n) for n, i in enumerate((1, 2, 2, None, 5))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, row_number int, content string, times int, turn int, grp int")
    whole = {tuple(r) for r in df.collect()}
    kept = df
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.runtime.stage(stage(spark, kept, ""), "kept")
        assert kept.columns == df.columns and {tuple(r) for r in kept.collect()} <= whole
    assert kept.count()


@pytest.mark.parametrize("name", ["docs", "repeated"])
def test_mix_takes_what_the_operator_says(request, spark, name):
    """The border of each source stands for the verdicts of its rows."""
    from collections import Counter

    from pyspark.sql import functions as F

    from garimpo.llm import mixing

    df = request.getfixturevalue(name)
    rows = corpus_pipeline.runtime.stage(df.withColumn("row_number", F.monotonically_increasing_id()), "rows") if name == "repeated" else df.withColumn("row_number", F.col("doc_id"))
    named = rows.withColumn("content", F.xxhash64(*df.columns))
    told = mixing.mix(named, F.array("source"), mixing.words(F.col("text")), tell=("content", "row_number"))
    wanted = Counter({(r.doc_id, r.content): 0 for r in told.collect()})
    for r in told.collect():
        wanted[r.doc_id, r.content] += r.copies
    found = Counter((r.doc_id, r.content) for r in corpus_pipeline.mix_sources(spark, df, "").select("doc_id", F.xxhash64(*df.columns).alias("content")).collect())
    assert found == +wanted and max(found.values()) > 1


def test_run_leaves_only_its_result(spark, tmp_path, docs, monkeypatch):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    folder = str(tmp_path / "shared")
    os.mkdir(folder)
    monkeypatch.setattr(corpus_pipeline.runtime, "shared_folder", lambda _: folder)
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert found.count() > 20 and [x.split("-")[0] for x in os.listdir(folder)] == ["pack"]


def test_pipeline_of_no_documents(spark, empty):
    kept = empty
    for name, stage in corpus_pipeline.STAGES:
        kept = corpus_pipeline.runtime.stage(stage(spark, kept, ""), name)
    assert kept.count() == 0


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from workload.check import compare

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    verdict, _ = compare(spark, con, name, queries.QUERIES[name], queries.ORACLES[name], folder)
    assert verdict.startswith("ok"), verdict
