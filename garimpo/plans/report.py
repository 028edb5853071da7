"""Ranked Markdown report as an ordered, distributed text write."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from garimpo import rules, runtime
from garimpo.functions.render import report_row, report_section
from garimpo.operators.ranking import report_rank

_HEAD, _ROW, _RULE, _SECTION = 0, 1, 2, 3
_COLUMNS = (
    "| Score | Score CLT | Score Non-CLT | Margin | Job | Company | Contract | Model | Location |\n"
    "| ---: | ---: | ---: | ---: | --- | --- | --- | --- | --- |"
)


def report_lines(analysed: DataFrame, now: dt.datetime, min_clt: float = rules.MIN_CLT_SCORE,
                 min_match: float = rules.MIN_MATCH_SCORE, seq: str = "collect_seq") -> DataFrame:
    """Pieces ``(part, position, text)`` of the report on the relevant rows, unsorted.

    ``analysed`` carries the boolean ``relevant``. With nothing relevant the report
    is just its head. Its input is stored once, as counts, ranks and rows all read it.
    """
    analysed = runtime.stage(analysed, "report")
    shown = report_rank(analysed.filter("relevant"), seq)
    head = analysed.agg(F.count_if("relevant").alias("n"), F.count(F.lit(1)).alias("m")).select(
        F.lit(_HEAD).alias("part"), F.lit(0).cast("long").alias("position"),
        F.format_string(
            "# Filtered jobs\n\nGenerated at: " + now.strftime("%Y-%m-%d %H:%M:%S") + "\n"
            "Jobs shown: %d of %d analyzed "
            f"(filter: CLT score >= {min_clt}, match score >= {min_match})\n\n" + _COLUMNS,
            "n", "m",
        ).alias("text"),
    )
    rule = analysed.sparkSession.range(1).select(
        F.lit(_RULE).alias("part"), F.lit(0).cast("long").alias("position"), F.lit("\n---").alias("text")
    )
    pieces = F.array(
        F.struct(F.lit(_ROW).alias("part"), report_row().alias("text")),
        F.struct(
            F.lit(_SECTION).alias("part"),
            F.concat(F.lit("\n"), report_section(F.col("report_rank")), F.lit("\n\n---")).alias("text"),
        ),
    )
    rows = shown.select(F.col("report_rank").alias("position"), F.inline(pieces)).select(
        "part", "position", "text"
    )
    return head.unionByName(rows).unionByName(rule)


def write_report(lines: DataFrame, path: str) -> None:
    """Part files in report order; together they are the report.

    A range-partitioned sort, so a report of any length is written in parallel.
    """
    lines.orderBy("part", "position").select("text").write.mode("errorifexists").text(path)
