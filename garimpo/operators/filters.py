"""Row filters. Each is a plain predicate, so Catalyst can move and merge them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from garimpo import rules
from garimpo.functions.labels import Rules, title_scope_reason
from garimpo.functions.numbers import is_relevant
from garimpo.functions.places import (
    PlaceRules,
    conflicts_with_remote,
    workplace_code,
    workplace_matches,
)
from garimpo.functions.text import fold_text, fold_word, text_contains
from garimpo.functions.times import wall_clock


def missing_id_filter(df: DataFrame, posting_id: str = "posting_id") -> DataFrame:
    return df.filter(F.col(posting_id).isNotNull())


def workplace_filter(
    df: DataFrame, model: Column | None = None, places: PlaceRules = PlaceRules()
) -> DataFrame:
    model = F.col("workplace_type") if model is None else model
    return df.filter(workplace_matches(F.col("location"), model, places))


def remote_conflict() -> Column:
    """In a remote search, a description that declares on-site or hybrid work only."""
    return (fold_text(F.col("workplace_type")) == "remoto") & conflicts_with_remote(F.col("description"))


def remote_conflict_filter(df: DataFrame) -> DataFrame:
    return df.filter(~remote_conflict())


def closed_filter(df: DataFrame, closed: str = "is_closed") -> DataFrame:
    return df.filter(~F.coalesce(F.col(closed), F.lit(False)))


def posted_within(
    df: DataFrame, period: str | None, run_ts: dt.datetime, column: str = "posted_at"
) -> DataFrame:
    """Age filter against a literal bound, so that it reaches the parquet scan."""
    seconds = rules.PERIOD_SECONDS.get(fold_word(period))
    if seconds is None:
        return df
    bound = run_ts - dt.timedelta(seconds=seconds)
    return df.filter(F.col(column) >= wall_clock(bound))


def workplace_code_filter(df: DataFrame, model: str | None, column: str = "workplace_type") -> DataFrame:
    """Keep postings of the searched work model; an unknown model keeps all."""
    wanted = rules.WORKPLACE_CODES.get(fold_word(model))
    return df if wanted is None else df.filter(workplace_code(F.col(column)) == wanted)


def title_scope_filter(df: DataFrame, table: Rules = rules.TITLE_RULES) -> DataFrame:
    return df.filter(title_scope_reason(F.col("job_title"), table).isNull())


def role_filter(df: DataFrame) -> DataFrame:
    """Only an explicit false drops a posting."""
    return df.filter(F.coalesce(F.col("core_role_compatible"), F.lit(True)))


def contract_gate(df: DataFrame) -> DataFrame:
    return df.filter(F.coalesce(F.col("accepted"), F.lit(True)))


def relevance_filter(
    df: DataFrame,
    min_clt: float = rules.MIN_CLT_SCORE,
    min_match: float = rules.MIN_MATCH_SCORE,
    clt_gate: bool = True,
) -> DataFrame:
    return df.filter(is_relevant(F.col("score_clt"), F.col("match_score"), min_clt, min_match, clt_gate))


def text_search(df: DataFrame, query: str) -> DataFrame:
    return df.filter(text_contains([F.col("job_title"), F.col("company"), F.col("location")], query))
