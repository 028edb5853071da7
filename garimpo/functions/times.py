"""Wall-clock literals."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F


def wall_clock(moment: dt.datetime) -> Column:
    """TIMESTAMP_NTZ literal; a plain datetime literal would pass through time zones."""
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")
