"""Expressions over raw HTML that need no element tree."""

from __future__ import annotations

from functools import cache
from html.entities import html5

from pyspark.sql import Column, functions as F

from garimpo import rules
from garimpo.functions.text import contains_any, fold_text, let

# Elements whose text is not part of the page text.
HIDDEN_ELEMENTS = ("script", "style", "template", "rt", "rp")


@cache
def _entity_table() -> str:
    names = ((n[:-1], c) for n, c in html5.items() if n.endswith(";") and not set("\n\t") & set(c))
    return "\n".join(f"{n}\t{c}" for n, c in names)


def unescape(text: Column) -> Column:
    """Named and numeric character references, each distinct one replaced once."""
    table = F.str_to_map(F.lit(_entity_table()), F.lit("\n"), F.lit("\t"))
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"&(#?\w+);"), F.lit(1)))

    def char(ref: Column) -> Column:
        digits = F.when(F.startswith(F.lower(ref), F.lit("#x")), F.substring(ref, 3, 8))
        digits = F.coalesce(digits, F.conv(F.substring(ref, 2, 8), 10, 16))
        known = digits.rlike("^[0-9A-Fa-f]{1,8}$")
        number = F.when(known, F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32"))
        return F.when(F.startswith(ref, F.lit("#")), number).otherwise(F.try_element_at(table, ref))

    def put(acc: Column, ref: Column) -> Column:
        whole = F.concat(F.lit("&"), ref, F.lit(";"))
        return F.coalesce(F.replace(acc, whole, char(ref)), acc)

    # "&amp;" last, or "&amp;lt;" would be resolved twice.
    plain = F.aggregate(F.array_remove(found, "amp"), text, put)
    text_out = F.replace(plain, F.lit("&amp;"), F.lit("&"))
    return F.when(F.contains(text, F.lit("&")), text_out).otherwise(text)


def page_text(html: Column, separator: str = " ") -> Column:
    """Text of a page; each run of tags becomes ``separator``."""
    hidden = r"(?is)<(" + "|".join(HIDDEN_ELEMENTS) + r")\b[^>]*>.*?</\1\s*>|<!--.*?-->"
    tags = r"(?s)(?:<[/!?a-zA-Z][^>]*>)+"
    bare = F.regexp_replace(F.regexp_replace(html, hidden, "<i>"), tags, separator)
    return let(bare, unescape)


def closed_flag(html: Column, phrases: tuple[str, ...] = rules.CLOSED_PHRASES) -> Column:
    """A class of a closed posting, or a closed phrase in the folded page text."""
    marked = html.rlike(
        r"(?is)<\w[^>]*\bclass\s*=\s*(?:\"[^\"]*(?:" + rules.CLOSED_CLASS + r")"
        r"|'[^']*(?:" + rules.CLOSED_CLASS + r")|[^\s\"'>]*(?:" + rules.CLOSED_CLASS + r"))"
    )
    return marked | let(fold_text(page_text(html)), lambda t: contains_any(t, tuple(phrases)))
