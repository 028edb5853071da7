"""Posting ids and canonical links."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from garimpo import rules
from garimpo.functions.text import blank_to_null


def _first_group(text: Column, pattern: str) -> Column:
    return blank_to_null(F.regexp_extract(text, pattern, 1))


def without_query(url: Column) -> Column:
    return F.substring_index(url, "?", 1)


def extract_id(url: Column, urn: Column | None = None) -> Column:
    """Digits that identify the posting: from the URN, else from the link."""
    found = [
        _first_group(url, r"/view/(\d+)"),
        _first_group(url, r"currentJobId=(\d+)"),
        _first_group(without_query(url), r"-(\d+)(?:/|$)"),
    ]
    if urn is not None:
        found.insert(0, _first_group(urn, r"jobPosting:(\d+)"))
    return F.coalesce(*found)


def canonical_link(posting_id: Column, base: str = rules.LINK_BASE) -> Column:
    return F.concat(F.lit(base), posting_id)
