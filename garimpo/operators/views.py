"""List view over the history: output columns, tabs, counters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from garimpo import rules
from garimpo.functions.numbers import is_relevant
from garimpo.functions.text import blank_to_null, text_contains


def job_view(history: DataFrame, min_clt: float = rules.MIN_CLT_SCORE,
             min_match: float = rules.MIN_MATCH_SCORE, clt_gate: bool = True) -> DataFrame:
    """One row per entry with every default filled in and the relevance flag.

    ``score_clt`` stays a nullable number; write 'N/A' when rendering.
    """
    def filled(name: str, default: object) -> Column:
        return F.coalesce(F.col(name), F.lit(default)).alias(name)

    na = rules.NOT_AVAILABLE
    return history.select(
        F.col("job_link").alias("link"),
        filled("job_title", na),
        filled("company", na),
        filled("location", na),
        filled("workplace_type", na),
        F.coalesce("inferred_contract_type", "contract_type", F.lit(na)).alias("inferred_contract_type"),
        F.col("score_clt"),
        filled("match_score", 0),
        F.col("first_seen_at"),
        F.col("last_processed_at"),
        filled("status", "new"),
        filled("error_class", ""),
        filled("notes", ""),
        is_relevant(F.col("score_clt"), F.col("match_score"), min_clt, min_match, clt_gate).alias("relevant"),
    )


@dataclass(frozen=True)
class ViewFilter:
    tab: str = "jobs"  # jobs, applied or errors
    query: str = ""
    only_relevant: bool = True
    only_new: bool = True
    hide_applied: bool = False
    show_irrelevant: bool = False


def is_pending(status: Column, error_class: Column) -> Column:
    """An error that still lacks its class; it stays visible everywhere."""
    return (status == "error") & blank_to_null(error_class).isNull()


def shown_in_tab(wanted: ViewFilter) -> Column:
    status = F.col("status")
    keep = text_contains([F.col("job_title"), F.col("company"), F.col("location")], wanted.query)
    if wanted.only_relevant:
        keep = keep & F.col("relevant")
    if wanted.tab == "errors":
        keep = keep & (status == "error")
    elif wanted.tab == "applied":
        keep = keep & (status == "applied")
    else:
        keep = keep & (status != "error")
        if not wanted.show_irrelevant:
            keep = keep & (status != "irrelevant")
        if wanted.only_new:
            keep = keep & (status == "new")
        if wanted.hide_applied:
            keep = keep & (status != "applied")
    return is_pending(status, F.col("error_class")) | keep


def tab_filter(view: DataFrame, wanted: ViewFilter = ViewFilter()) -> DataFrame:
    return view.filter(shown_in_tab(wanted))


def status_counts(view: DataFrame, wanted: ViewFilter = ViewFilter()) -> DataFrame:
    """Counters over the whole view and the number shown under the filter: one pass."""
    status = F.col("status")
    hidden = status.isin("error", "irrelevant")
    return view.agg(
        F.count_if(shown_in_tab(wanted)).alias("shown"),
        F.count_if(~hidden).alias("total"),
        F.count_if(status == "viewed").alias("viewed"),
        F.count_if(status == "applied").alias("applied"),
        F.count_if(status == "error").alias("errors"),
        F.count_if(status == "irrelevant").alias("irrelevant"),
    )


def last_run(history: DataFrame) -> DataFrame:
    return history.agg(F.max("last_processed_at").alias("last_run"))
