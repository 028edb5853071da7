"""Score coercions and the relevance test."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from garimpo import rules


def as_float(value: Column) -> Column:
    """Number or NULL: text such as 'N/A' and NaN are not numbers."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number), number)


# Between two hundredths: the double next to the middle, and where it rounds to itself.
_MIDDLES = [(2 * i + 1) / 200 for i in range(100)]
_MIDDLE_UP = [round(m, 2) > i / 100 for i, m in enumerate(_MIDDLES)]


def round2(value: Column) -> Column:
    """Nearest hundredth of the binary value, as a float rounds: 0.695 is below 0.695 and gives 0.69.

    Exact for 0 to 1, where confidences lie; other values are rounded by their decimal text.
    """
    below = F.least(F.greatest(F.floor(value * 100), F.lit(0)), F.lit(99)).cast("int")
    middle = F.get(F.array(*map(F.lit, _MIDDLES)), below)
    up = (value > middle) | ((value == middle) & F.get(F.array(*map(F.lit, _MIDDLE_UP)), below))
    exact = (below + F.when(up, 1).otherwise(0)) / F.lit(100.0)
    return F.when((value >= 0) & (value <= 1), exact).otherwise(F.bround(value, 2))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def score_of(value: Column) -> Column:
    """Sort score: whole number, anything else counts as 0."""
    return F.coalesce(value.try_cast("int"), F.lit(0))


def is_relevant(
    score_clt: Column,
    match_score: Column,
    min_clt: float = rules.MIN_CLT_SCORE,
    min_match: float = rules.MIN_MATCH_SCORE,
    clt_gate: bool = True,
) -> Column:
    """Confidently CLT and well matched. Without a contract gate there is no CLT bar."""
    matched = F.coalesce(as_float(match_score), F.lit(0.0)) >= F.lit(float(min_match))
    if not clt_gate:
        return matched
    return F.coalesce(as_float(score_clt) >= F.lit(float(min_clt)), F.lit(False)) & matched
