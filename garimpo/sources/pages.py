"""Search and detail pages: a pages table in, cards or descriptions out.

The element tree has no SQL form, so pages pass through ``mapInArrow``: one Spark
task per input split, rows in batches, no shuffle. What cannot be read, a page or one card
of it, comes out as a row with ``error`` set; the other cards of the page stay.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from garimpo import rules, schemas
from garimpo.functions.links import canonical_link, extract_id, without_query
from garimpo.functions.text import fold_word
from garimpo.sources.markup import Element, parse

# Class names of the pages.
CARD = re.compile(r"^(base-card|base-search-card)$")
CARD_TITLE = re.compile(r"base-search-card__title|job-search-card__title")
CARD_COMPANY = re.compile(r"base-search-card__subtitle|job-search-card__subtitle")
CARD_LINK = re.compile(r"base-card__full-link|base-search-card__full-link")
CARD_LOCATION = re.compile(r"job-search-card__location")
DETAIL_BODY = (
    re.compile(r"^show-more-less-html__markup$"),
    re.compile(r"^description__text$"),
)
CLOSED = re.compile(rules.CLOSED_CLASS)
WHOLE_PAGE_MINIMUM = 100


def _text(element: Element | None, default: str | None) -> str | None:
    return "".join(element.strings()).strip() if element is not None else default


def read_card(card: Element) -> tuple:
    link = card.find(CARD_LINK, "a")
    return (
        _text(card.find(CARD_TITLE), rules.UNTITLED),
        _text(card.find(CARD_COMPANY), rules.UNKNOWN_COMPANY),
        _text(card.find(CARD_LOCATION), None),
        link.attrs.get("href", "") if link is not None else "",
        card.attrs.get("data-entity-urn"),
    )


CardReader = Callable[[Element], tuple]
_CARDS = pa.schema([("page_id", pa.int64()), ("position", pa.int32())] + [(n, pa.string()) for n in schemas.names(schemas.CARD_WITH_ERROR)[2:]])
_DETAILS = pa.schema([("page_id", pa.int64()), ("description", pa.string()), ("is_closed", pa.bool_()), ("error", pa.string())])


def _pages_of(batch: pa.RecordBatch) -> Iterator[tuple[int, str | None]]:
    return zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _cards_of_page(page_id: int, html: str | None, read: CardReader) -> Iterator[tuple]:
    nothing = (None,) * 5
    try:
        cards = [e for e in parse(html or "").walk() if e.has_class(CARD)]
    except Exception as problem:
        yield (page_id, -1, *nothing, _said(problem))
        return
    for i, card in enumerate(cards):
        try:
            yield (page_id, i, *read(card), None)
        except Exception as problem:  # this card only
            yield (page_id, i, *nothing, _said(problem))


def _said(problem: Exception) -> str:
    return str(problem) or type(problem).__name__


def scan_cards(pages: DataFrame, read: CardReader = read_card) -> DataFrame:
    """One row per card of a search page, in page order.

    A card that ``read`` cannot take is a row with its place and ``error``; a page that has no
    readable tree is one such row with place -1. ``read`` gives title, company, location, link
    and urn of a card element.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([row for page in _pages_of(batch) for row in _cards_of_page(*page, read)], _CARDS)

    return pages.select("page_id", "html").mapInArrow(run, schemas.CARD_WITH_ERROR)


def card_postings(cards: DataFrame, search_location: str, base: str = rules.LINK_BASE) -> DataFrame:
    """Cards with id and canonical link; cards without an id keep NULL there.

    Rows with ``error`` stay, with nothing but their place: ``readable_cards`` leaves them out.
    """
    posting_id = extract_id(without_query(F.col("card_link")), F.col("urn"))
    readable = F.col("error").isNull()
    return (
        cards.withColumn("location", F.when(readable, F.coalesce("location", F.lit(search_location))))
        .withColumn("posting_id", F.when(readable, posting_id))
        .withColumn("job_link", canonical_link(F.col("posting_id"), base))
        .drop("card_link", "urn")
    )


def readable_cards(postings: DataFrame) -> DataFrame:
    return postings.filter(F.col("error").isNull()).drop("error")


def detail_of(html: str) -> tuple[str, bool]:
    """Description text and closed flag of one detail page."""
    page = parse(html)
    folded = fold_word(" ".join(page.strings()))
    closed = page.find(CLOSED) is not None or any(p in folded for p in rules.CLOSED_PHRASES)
    body = next((b for b in map(page.find, DETAIL_BODY) if b is not None), None)
    if body is not None:
        text = "".join(body.strings(marks=True))
        return re.sub(r"\n\s*\n", "\n\n", text).strip(), closed
    whole = "".join(page.strings()).strip()
    return (whole if len(whole) > WHOLE_PAGE_MINIMUM else rules.DETAIL_EMPTY), closed


def _details_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for page_id, html in _pages_of(batch):
            if html is None:
                rows.append((page_id, rules.DETAIL_MISSING, False, None))
                continue
            try:
                rows.append((page_id, *detail_of(html), None))
            except Exception as problem:
                rows.append((page_id, rules.DETAIL_BROKEN, False, str(problem)))
        yield _batch(rows, _DETAILS)


def scan_detail_text(pages: DataFrame) -> DataFrame:
    """Description and closed flag per detail page; failures keep the row with a placeholder."""
    return pages.select("page_id", "html").mapInArrow(_details_of, schemas.DETAIL)
