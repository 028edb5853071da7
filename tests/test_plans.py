"""What the plans must and must not hold."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from garimpo.operators import capping, dedupe, filters, history, hooks, ranking, status
from garimpo.plans import flow
from workload import adapter as A
from workload import all_queries

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """Postings as parquet, the way a library user has them."""
    path = str(tmp_path_factory.mktemp("postings") / "p")
    A.postings(spark, SF).write.parquet(path)
    return spark.read.parquet(path)


def test_age_filter_reaches_the_scan_and_columns_are_pruned(files):
    plan = plan_of(filters.posted_within(files, "semana", dt.datetime(2001, 8, 1)).select("job_link"))
    assert "GreaterThanOrEqual(posted_at,2001-07-25" in plan
    assert "description" not in plan.split("ReadSchema")[1]


def test_texts_are_scanned_once(spark, files):
    """No rule is evaluated twice, though labels are filtered on and selected."""
    labelled = flow.label_postings(files)
    plan = plan_of(flow.decide_contract(labelled, None).filter("accepted").select("job_link", "contract_evidence"))
    assert plan.count("prestador(?:a)?") == 1 and plan.count("translate(") == 2


def test_answers_are_parsed_once(spark):
    plan = plan_of(all_queries.QUERIES["first_valid_response"](spark, SF))
    assert plan.count("from_json(") == 1


def test_keep_first_combines_before_the_shuffle(files):
    plan = plan_of(dedupe.dedupe_reposts(files))
    assert "partial_min_by" in plan and "Window" not in plan
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1


def test_cap_drops_blocks_before_it_numbers(files):
    plan = plan_of(capping.limit_cap(files, 5))
    assert "_start" in plan and plan.index("Window") < plan.index("Join")  # the join is below the window


def test_status_fold_combines_before_the_shuffle(spark):
    plan = plan_of(status.status_delta(A.status_events(spark, SF)))
    assert "partial_max_by" in plan and "Window" not in plan


def test_rank_has_no_one_task_window_over_rows(files):
    df = files.withColumn("match_score", F.lit(70))
    plan = plan_of(ranking.rank_by_score(df, F.col("match_score")))
    single = plan.split("Exchange SinglePartition")[1:]
    assert all("HashAggregate" in part[:400] for part in single)


def test_bucketed_history_is_not_shuffled(spark, files):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.sources.v1.useBucketing", "true")
    try:
        history.write_bucketed(A.history(spark, SF), "history_b", 4)
        batch = files.withColumns({"match_score": F.lit(1), "score_clt": F.lit(0.5)})
        plan = plan_of(history.history_upsert(spark.table("history_b"), batch, F.lit("2026-01-01 00:00:00")))
        assert plan.count("Exchange hashpartitioning") == 1  # the batch only
        anti = plan_of(history.known_link_anti(files, spark.table("history_b")))
        assert anti.count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS history_b")


def test_hook_sees_only_undecided_rows(files):
    undecided = flow.needs_answer(flow.label_postings(files))
    plan = plan_of(hooks.hook_answers(undecided, lambda row: None, ["description"], "contract"))
    assert plan.index("MapInPandas") < plan.index("Filter")  # printed top down: Python above the filter


def test_no_cross_joins_anywhere(spark):
    for name in ("triage_ranked", "profile_cross", "plan_cross", "cap_per_group", "report_markdown", "status_fold"):
        plan = plan_of(all_queries.QUERIES[name](spark, SF))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
