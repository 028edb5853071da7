"""Every query against its SQL on the smallest tables, and proof that rules hit and miss."""

import glob
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from garimpo import rules
from garimpo.functions.text import fold_text, scan_text
from workload import adapter as A
from workload import all_queries
from workload.check import compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_every_query_has_its_sql():
    assert set(all_queries.QUERIES) == set(all_queries.ORACLES) and set(all_queries.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", list(all_queries.QUERIES))
def test_query_equals_sql(spark, con, name):
    verdict, _ = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert verdict.startswith("ok"), verdict
    assert verdict != "ok 0"


def test_rules_hit_and_miss(spark):
    postings = A.postings(spark, SF)
    folded = postings.select(
        fold_text(scan_text(F.col("job_title"), F.col("company"), F.col("description"))).alias("scan"),
        fold_text(F.col("job_title")).alias("title"), fold_text(F.col("description")).alias("text"),
    )
    tests = [("scan", p) for _, p in rules.STRONG_RULES + rules.HINT_RULES] + [("title", p) for _, p in rules.TITLE_RULES]
    tests += [("text", "|".join(rules.ONSITE_PATTERNS)), ("text", "|".join(rules.REMOTE_PATTERNS))]
    found = folded.agg(*[F.count_if(F.col(c).rlike(p)).alias(f"c{i}") for i, (c, p) in enumerate(tests)],
                       F.count(F.lit(1)).alias("n")).first()
    assert all(0 < found[i] < found.n for i in range(len(tests)))


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "report_rank"
