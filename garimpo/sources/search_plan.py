"""Configured searches: terms x filters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from garimpo.functions.places import period_seconds, workplace_code

DEFAULT_LOCATION = "Brasil"
DEFAULT_CAP = 3


@dataclass(frozen=True)
class SearchFilter:
    model: str | None = None
    location: str | None = None  # falls back to the plan's location
    geo_id: str | None = None


def plan_cross(terms: DataFrame, filters: Sequence[SearchFilter],
               location: str = DEFAULT_LOCATION) -> DataFrame:
    """Every term with every filter, numbered in loop order.

    ``terms(term_no, term)``. Filters are a short configured list, so the product is
    an ``inline`` over a literal array: a map, without a join.
    """
    filters = list(filters) or [SearchFilter()]
    listed = F.array(
        *[
            F.struct(
                F.lit(i).alias("filter_no"),
                F.lit(f.model).cast("string").alias("model"),
                F.lit(location if f.location is None else f.location).alias("location"),
                F.lit(f.geo_id).cast("string").alias("geo_id"),
            )
            for i, f in enumerate(filters)
        ]
    )
    return terms.select("term_no", "term", F.inline(listed)).withColumn(
        "search_group", F.col("term_no") * len(filters) + F.col("filter_no")
    )


def search_plan(terms: DataFrame, filters: Sequence[SearchFilter], location: str = DEFAULT_LOCATION,
                period: str | None = None, cap: int = DEFAULT_CAP) -> DataFrame:
    """Search parameters per (term, filter)."""
    return plan_cross(terms, filters, location).select(
        "search_group", "term", "location", "geo_id",
        workplace_code(F.col("model")).alias("model_code"),
        period_seconds(F.lit(period).cast("string")).alias("period_seconds"),
        F.lit(cap).alias("cap"),
    )
