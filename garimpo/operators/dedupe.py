"""Keep-first operators. All are aggregations with a map-side half, so that a key
that holds a large share of the rows leaves each map task as a single row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from garimpo.functions.text import fold_text


def nulls_last(*columns: str) -> list[Column]:
    """Parts of an order in which a NULL comes after every value."""
    return [part for c in columns for part in (F.col(c).isNull().alias(f"_no_{c}"), F.col(c))]


def keep_first(df: DataFrame, keys: dict[str, Column], order: Column, copies: str | None = None) -> DataFrame:
    """One whole row per key: the one with the least ``order`` (unique per key); a NULL is the last.

    ``copies`` names an extra column with the number of rows of the key.
    """
    row = F.struct(*[F.col(c) for c in df.columns])
    aggregates = [F.min_by(row, F.struct(order.isNull(), order)).alias("row")]  # a struct is never NULL
    if copies:
        aggregates.append(F.count(F.lit(1)).alias(copies))
    kept = df.groupBy(*[k.alias(n) for n, k in keys.items()]).agg(*aggregates)
    return kept.select("row.*", *([copies] if copies else []))


def repost_keys(title: str = "job_title", company: str = "company") -> dict[str, Column]:
    return {"key_title": fold_text(F.col(title)), "key_company": fold_text(F.col(company))}


def dedupe_reposts(df: DataFrame, order: str = "collect_seq", copies: str | None = None) -> DataFrame:
    """First posting per (title, company), accents and case ignored; place ignored."""
    return keep_first(df, repost_keys(), F.col(order), copies)


def distinct_links(df: DataFrame, link: str = "job_link") -> DataFrame:
    return df.select(link).distinct()


def links_union(history: DataFrame, collected: DataFrame, link: str = "job_link") -> DataFrame:
    return history.select(link).union(collected.select(link)).distinct()


def collect_union(*groups: DataFrame) -> DataFrame:
    """Per-search results as one table; ``search_group, collect_seq`` keeps the order."""
    result = groups[0]
    for other in groups[1:]:
        result = result.unionByName(other)
    return result
