"""From recorded model attempts to one analysis and one contract per posting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from garimpo.functions import answers
from garimpo.functions.contract import fallback_analysis
from garimpo.operators.columns import computed_once
from garimpo.operators.dedupe import keep_first

MATCH, CONTRACT = "match", "contract"


def read_answers(attempts: DataFrame, parser: Callable[[Column], Column], raw: str = "raw_text",
                 keep_invalid: bool = False) -> DataFrame:
    """Adds ``answer``, the parsed struct, for attempts that hold a valid one.

    Each text is parsed once, whatever is filtered or selected later. ``keep_invalid``
    keeps failed attempts with a NULL answer (for audits).
    """
    parsed = computed_once(attempts, {"answer": parser(F.col(raw))})
    return parsed if keep_invalid else parsed.filter(F.col("answer").isNotNull())


def match_answers(attempts: DataFrame, keep_invalid: bool = False) -> DataFrame:
    return read_answers(attempts, answers.parse_match, keep_invalid=keep_invalid)


def contract_answers(attempts: DataFrame, keep_invalid: bool = False) -> DataFrame:
    return read_answers(attempts, answers.parse_contract, keep_invalid=keep_invalid)


def first_valid_response(parsed: DataFrame) -> DataFrame:
    """Per posting and task the earliest attempt whose answer is valid.

    Order: cycle, provider, model. Only valid attempts are shuffled, at most one per
    posting and map task, and only the columns named here.
    """
    columns = ["job_link", "task", "cycle", "provider_rank", "model_rank", "answer"]
    valid = parsed.select(*columns).filter(F.col("answer").isNotNull())
    keys = {"key_link": F.col("job_link"), "key_task": F.col("task")}
    return keep_first(valid, keys, F.struct("cycle", "provider_rank", "model_rank"))


def best_answers(given: DataFrame, postings: DataFrame,
                 reader: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One valid answer per link of ``postings``, which should be stored.

    ``given`` are recorded attempts: those of other links leave by a semi join before any
    text is parsed. Answers that are read already (column ``answer``) pass as they are.
    """
    if "answer" in given.columns:
        return given
    links = postings.select("job_link").distinct()
    return first_valid_response(reader(given.join(links, "job_link", "left_semi")))


def provider_ranks(attempts: DataFrame, order: tuple[str, ...], column: str = "provider") -> DataFrame:
    """Rank attempts by the configured provider order; other providers are not available."""
    rank = F.lit(None).cast("int")
    for place, name in enumerate(order):
        rank = F.when(F.col(column) == name, F.lit(place)).otherwise(rank)
    return attempts.withColumn("provider_rank", rank).filter(F.col("provider_rank").isNotNull())


def merge_analysis(postings: DataFrame, analyses: DataFrame, analysis: str = "analysis") -> DataFrame:
    """Posting columns plus the analysis columns; the analysis wins on equal names."""
    fields = analyses.schema[analysis].dataType.names
    joined = postings.join(analyses.select("job_link", analysis), "job_link", "inner")
    return joined.select(
        *[c for c in postings.columns if c not in fields],
        *[F.col(analysis)[name].alias(name) for name in fields],
    )


def response_resolve(postings: DataFrame, best: DataFrame) -> DataFrame:
    """Every posting with its analysis, or with the neutral one if there is none."""
    found = best.select("job_link", F.col("answer").alias("analysis"))
    joined = postings.join(found, "job_link", "left").withColumn(
        "analysis", F.coalesce("analysis", fallback_analysis())
    )
    return joined.select(*[c for c in postings.columns], "analysis.*")
