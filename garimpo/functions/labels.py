"""Ordered rule labels over folded text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from garimpo import rules
from garimpo.functions.text import fold_text, let, matches_any

Rules = Sequence[tuple[str, str]]


def _rule_hits(folded: Column, table: Rules) -> list[Column]:
    return [F.when(matches_any(folded, (pattern,)), F.lit(label)) for label, pattern in table]


def platform_contains(
    company: Column,
    platforms: Sequence[str] = rules.PLATFORMS,
    word_boundary: bool = False,
) -> Column:
    """First listed marketplace whose spelling occurs in the company, else NULL.

    A plain substring test by default, so "manufacturing" holds "turing";
    ``word_boundary`` asks for whole words.
    """
    def first(folded: Column) -> Column:
        result = F.lit(None).cast("string")
        for name in reversed(platforms):
            if word_boundary:
                hit = folded.rlike(r"(?U)(?<!\w)" + "\\Q" + name + "\\E" + r"(?!\w)")
            else:
                hit = F.contains(folded, F.lit(name))
            result = F.when(hit, F.lit(name)).otherwise(result)
        return result

    return let(fold_text(company), first)


def label_concat(*parts: Column) -> Column:
    """Concatenate label arrays, dropping NULL entries, keeping order."""
    return F.array_compact(F.concat(*parts))


def _platform_label(platform: Column) -> Column:
    return F.array(F.concat(F.lit(rules.PLATFORM_LABEL), platform))


def strong_labels(text: Column, company: Column, table: Rules = rules.STRONG_RULES) -> Column:
    """Labels of the high-precision rules found in the text, then the marketplace label."""
    platform = _platform_label(platform_contains(company))
    return let(
        fold_text(text), lambda folded: label_concat(F.array(*_rule_hits(folded, table)), platform)
    )


def hint_labels(
    text: Column,
    company: Column,
    strong: Rules = rules.STRONG_RULES,
    hints: Rules = rules.HINT_RULES,
) -> Column:
    """Strong labels, then hint labels, then the marketplace label."""
    return strong_labels(text, company, (*strong, *hints))


def first_rule(text: Column, table: Rules) -> Column:
    """Label of the first rule that matches the folded text, else NULL."""
    return let(fold_text(text), lambda folded: F.coalesce(*_rule_hits(folded, table)))


def title_scope_reason(title: Column, table: Rules = rules.TITLE_RULES) -> Column:
    """Why the title is out of scope; NULL when it is in scope or empty."""
    return first_rule(title, table)
