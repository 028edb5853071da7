"""Text folding and small string helpers, as Column expressions.

Folding is compatibility decomposition, removal of combining marks, lower case.
Spark has no normalisation function, so the tables are derived once from
``unicodedata`` and applied with ``translate`` (one character to one or none)
and, only for rows that hold such a character, ``replace`` (one to many).
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, functions as F

from garimpo import rules

# Characters Python's str.strip() removes: every code point with isspace().
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


@dataclass(frozen=True)
class FoldTables:
    single_from: str  # decomposes to one character ...
    single_to: str  # ... this one, at the same position
    dropped: str  # combining marks
    many_from: str  # decomposes to several characters ...
    many_to: tuple[str, ...]  # ... these, at the same position


@cache
def fold_tables() -> FoldTables:
    singles, dropped, many = [], [], []
    for code in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF:
            continue
        ch = chr(code)
        if unicodedata.combining(ch):
            dropped.append(ch)
            continue
        if not unicodedata.decomposition(ch):  # Hangul syllables: see _hangul
            continue
        flat = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
        if flat == ch:
            continue
        if not flat:
            dropped.append(ch)
        elif len(flat) == 1:
            singles.append((ch, flat))
        else:
            many.append((ch, flat))
    return FoldTables(
        "".join(s for s, _ in singles),
        "".join(t for _, t in singles),
        "".join(dropped),
        "".join(s for s, _ in many),
        tuple(t for _, t in many),
    )


def _char_class(chars: str) -> str:
    """Inside of a regex class that holds all of ``chars``, as few ranges.

    Ranges are exact among Latin letters and general punctuation, where almost all
    text lives; elsewhere near ones are merged. A long exact class would make the
    regex engine test hundreds of ranges per character, and a character taken in
    by a merge only costs one more look-up.
    """
    ranges: list[list[int]] = []
    for code in sorted(set(map(ord, chars))):
        exact = code < 0x250 or 0x2000 <= code < 0x2070
        if ranges and code - ranges[-1][1] <= (1 if exact else 512) and ranges[-1][1] >= (0 if exact else 0x250):
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges)


def _special() -> str:
    """Matches each character that may become several; a superset of them."""
    return "[" + _char_class(fold_tables().many_from) + r"\x{AC00}-\x{D7A3}]"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


# Jamo of a composed Hangul syllable, by the arithmetic of the Unicode standard.
_HANGUL = """aggregate(array(cast(conv(hex(encode(ch, 'UTF-16BE')), 16, 10) as int) - 44032), '', (none, i) ->
  decode(unhex(concat(hex(4352 + i div 588), hex(4449 + i % 588 div 28),
                      if(i % 28 > 0, hex(4519 + i % 28), ''))), 'UTF-16BE'))"""


@cache
def _fold_lambda() -> str:
    """SQL lambda that folds its argument; text, since it is one long constant."""
    t = fold_tables()
    special = _quoted(_special())
    many_to = _quoted("\n".join(t.many_to))
    # Each *distinct* multi-character code point of a row is replaced once.
    expanded = f"""aggregate(array_distinct(regexp_extract_all(t, {special}, 0)), t, (acc, ch) -> CASE
      WHEN instr({_quoted(t.many_from)}, ch) > 0 THEN
        replace(acc, ch, element_at(split({many_to}, '\\n', -1), instr({_quoted(t.many_from)}, ch)))
      WHEN ch BETWEEN '\uac00' AND '\ud7a3' THEN replace(acc, ch, {_HANGUL}) ELSE acc END)"""
    source, target = _quoted(t.single_from + t.dropped), _quoted(t.single_to)
    return f"""t -> CASE WHEN t IS NULL THEN '' WHEN octet_length(t) = char_length(t) THEN lower(t)
      ELSE lower(translate(CASE WHEN t RLIKE {special} THEN {expanded} ELSE t END, {source}, {target})) END"""


def fold_text(text: Column) -> Column:
    """Accent-insensitive lower-case form; NULL becomes ''.

    Three branches, evaluated lazily per row: plain ASCII needs only ``lower``;
    most other rows one ``translate``; rows with ligatures, fractions, ellipses,
    Hangul etc. are expanded first.
    """
    return F.call_function("transform", F.array(text), F.expr(_fold_lambda()))[0]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row.

    Catalyst copies an expression to each of its uses; binding it to a lambda
    variable keeps costly ones (JSON, long regexes) to a single evaluation.
    """
    return F.transform(F.array(value), use)[0]


def fold_word(word: str | None) -> str:
    """Fold a parameter on the driver, as ``fold_text`` folds a column."""
    flat = unicodedata.normalize("NFKD", word or "")
    return "".join(c for c in flat if not unicodedata.combining(c)).lower()


def strip(text: Column) -> Column:
    """Trim every Unicode white space at both ends (SQL ``trim`` drops blanks only)."""
    return F.btrim(text, F.lit(WHITESPACE))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def scan_text(title: Column, company: Column, description: Column) -> Column:
    """Non-empty parts joined by a blank; what the label rules look at."""
    return F.concat_ws(" ", blank_to_null(title), blank_to_null(company), blank_to_null(description))


def contains_any(text: Column, needles: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for needle in needles:
        hit = hit | F.contains(text, F.lit(needle))
    return hit


def matches_any(text: Column, patterns: tuple[str, ...]) -> Column:
    """One alternation: a single regex pass when only the boolean is needed.

    (?U): \\b \\w \\s \\d see every script, as they do in Python patterns.
    """
    hit = text.rlike("(?U)(?:" + "|".join(patterns) + ")")
    key = patterns[0] if len(patterns) == 1 else patterns
    words = rules.NEEDED_WORDS.get(key)
    return contains_any(text, words) & hit if words else hit


def text_contains(haystack: list[Column], query: str) -> Column:
    """Case-insensitive literal substring over the blank-joined columns."""
    wanted = query.strip().lower()
    if not wanted:
        return F.lit(True)
    joined = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in haystack])
    return F.contains(F.lower(joined), F.lit(wanted))
