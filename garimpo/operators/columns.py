"""Keeping costly columns from being computed again by later operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns through a one-row generator.

    Catalyst copies the expression of a projected column into every filter and
    selection above it. Columns made by a generator are plain inputs to those, so
    long regex or JSON expressions run once per row, after the filters below.
    """
    made = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    return df.select("*", F.inline_outer(made))
