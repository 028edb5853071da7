"""Text rendering of rows: report lines, bullets, dates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from garimpo import rules
from garimpo.functions.text import blank_to_null


def or_na(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(rules.NOT_AVAILABLE))


def table_text(value: Column) -> Column:
    """Cell text: pipes escaped, line breaks as blanks."""
    return F.replace(F.replace(or_na(value), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def bullet_list(items: Column) -> Column:
    """``- item`` lines; an empty or missing list is ``- N/A``."""
    lines = F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), or_na(x))), "\n")
    return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, lines).otherwise(F.lit("- N/A"))


def contract_shown() -> Column:
    return F.coalesce(F.col("inferred_contract_type"), F.col("contract_type"))


def report_row() -> Column:
    """The nine-column table line of a posting."""
    title, link = table_text(F.col("job_title")), blank_to_null(F.col("job_link"))
    linked = F.coalesce(F.concat(F.lit("["), title, F.lit("]("), link, F.lit(")")), title)
    cells = [
        F.coalesce("match_score", F.lit(0)).cast("string"),
        table_text(F.col("score_clt")),
        table_text(F.col("score_non_clt")),
        table_text(F.col("contract_margin")),
        linked,
        table_text(F.col("company")),
        table_text(contract_shown()),
        table_text(F.col("workplace_type")),
        table_text(F.col("location")),
    ]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def report_section(rank: Column) -> Column:
    """The detailed section of a posting, without its closing rule."""
    def line(text: str, value: Column, after: str = "") -> Column:
        return F.concat(F.lit(text), value, F.lit(after))

    lines = [
        F.concat(F.lit("## "), rank.cast("string"), F.lit(". "), or_na(F.col("job_title")), F.lit(" - "),
                 or_na(F.col("company"))),
        F.lit(""),
        line("- Match score: ", F.coalesce("match_score", F.lit(0)).cast("string"), "/100"),
        line("- Link: ", or_na(blank_to_null(F.col("job_link")))),
        line("- Inferred contract type: ", or_na(contract_shown())),
        line("- Score CLT: ", or_na(F.col("score_clt"))),
        line("- Score Non-CLT: ", or_na(F.col("score_non_clt"))),
        line("- Contract margin: ", or_na(F.col("contract_margin"))),
        line("- Contract evidence: ", or_na(F.col("contract_evidence"))),
        line("- Workplace type: ", or_na(F.col("workplace_type"))),
        line("- Location: ", or_na(F.col("location"))),
        line("\n### Strengths\n", bullet_list(F.col("strengths"))),
        line("\n### Gaps\n", bullet_list(F.col("gaps"))),
        line("\n### Verdict\n", or_na(F.col("verdict"))),
    ]
    return F.concat_ws("\n", *lines)


def fmt_date(value: Column) -> Column:
    """ISO text as dd/MM/yyyy; empty as a dash; anything unreadable as it is."""
    read = value.try_cast("timestamp_ntz")
    return F.coalesce(F.date_format(read, "dd/MM/yyyy"), blank_to_null(value), F.lit("—"))


def fmt_datetime(value: Column) -> Column:
    read = value.try_cast("timestamp_ntz")
    return F.coalesce(F.date_format(read, "dd/MM/yyyy, HH:mm:ss"), value)
