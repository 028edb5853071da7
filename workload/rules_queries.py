"""Folding, labels, filters, links: per-row operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from garimpo import rules
from garimpo.functions import html, labels, links, numbers, places, render, text
from garimpo.operators import filters
from garimpo.plans import flow
from workload import adapter as A
from workload.registry import query


# --- text and labels ---------------------------------------------------------------------------
@query("fold_text", f"SELECT doc_id, {A.sql_fold('text')} AS folded FROM documents")
def fold_text(spark, sf):
    return A.table(spark, sf, "documents").select("doc_id", text.fold_text(F.col("text")).alias("folded"))


@query("scan_text", A.with_postings(f"SELECT job_link, {A.SQL_SCAN} AS scan_text FROM postings"))
def scan_text(spark, sf):
    return A.postings(spark, sf).select(
        "job_link",
        text.scan_text(F.col("job_title"), F.col("company"), F.col("description")).alias("scan_text"),
    )


@query(
    "platform_contains",
    A.with_postings(
        "SELECT job_link, CASE "
        + " ".join(f"WHEN contains({A.sql_fold('company')}, '{p}') THEN '{p}'" for p in rules.PLATFORMS)
        + " END AS platform FROM postings"
    ),
)
def platform_contains(spark, sf):
    return A.postings(spark, sf).select(
        "job_link", labels.platform_contains(F.col("company")).alias("platform")
    )


_STRONG = A.sql_labels("scan", "company", rules.STRONG_RULES)
_HINTS = A.sql_labels("scan", "company", rules.STRONG_RULES + rules.HINT_RULES)
_SCANNED = f"scanned AS (SELECT *, {A.sql_fold(A.SQL_SCAN)} AS scan FROM postings)"


@query("strong_labels", A.with_postings(f"SELECT job_link, {_STRONG} AS labels FROM scanned", _SCANNED))
def strong_labels(spark, sf):
    return flow.label_postings(A.postings(spark, sf)).select(
        "job_link", F.array_join("labels", ", ").alias("labels")
    )


@query("hint_labels", A.with_postings(f"SELECT job_link, {_HINTS} AS hints FROM scanned", _SCANNED))
def hint_labels(spark, sf):
    return flow.label_postings(A.postings(spark, sf), hints=True).select(
        "job_link", F.array_join("hints", ", ").alias("hints")
    )


@query(
    "label_concat",
    A.with_postings(
        "SELECT job_link, concat_ws(', ', CASE WHEN k % 2 = 0 THEN regime END, 'from ' || company, "
        "CASE WHEN k % 3 = 0 THEN workplace_type END) AS joined FROM postings"
    ),
)
def label_concat(spark, sf):
    k = F.col("collect_seq")
    joined = labels.label_concat(
        F.array(F.when(k % 2 == 0, F.col("regime"))),
        F.array(F.concat(F.lit("from "), "company"), F.when(k % 3 == 0, F.col("workplace_type"))),
    )
    return A.wide_postings(spark, sf).select("job_link", F.array_join(joined, ", ").alias("joined"))


# --- place, model, age ---------------------------------------------------------------------------
@query("workplace_filter", A.with_postings(f"SELECT job_link, location, workplace_type FROM postings WHERE {A.sql_workplace()}"))
def workplace_filter(spark, sf):
    return filters.workplace_filter(A.postings(spark, sf)).select("job_link", "location", "workplace_type")


@query("remote_conflict_filter", A.with_postings(f"SELECT job_link, description FROM postings WHERE NOT {A.sql_remote_conflict()}"))
def remote_conflict_filter(spark, sf):
    return filters.remote_conflict_filter(A.postings(spark, sf)).select("job_link", "description")


@query(
    "posted_within",
    A.with_postings(
        "SELECT job_link, posted_at FROM postings "
        "WHERE posted_at >= TIMESTAMP '2001-08-01 00:00:00' - INTERVAL 2592000 SECOND"
    ),
)
def posted_within(spark, sf):
    return filters.posted_within(A.postings(spark, sf), "Mês", A.RUN_TS).select("job_link", "posted_at")


@query(
    "workplace_code",
    A.with_postings(
        "SELECT job_link, CASE workplace_type WHEN 'remoto' THEN '2' WHEN 'hibrido' THEN '3' "
        "WHEN 'presencial' THEN '1' END AS code FROM postings WHERE workplace_type IN ('hibrido')"
    ),
)
def workplace_code(spark, sf):
    return filters.workplace_code_filter(A.postings(spark, sf), "Híbrido").select(
        "job_link", places.workplace_code(F.col("workplace_type")).alias("code")
    )


# --- ids and pages ---------------------------------------------------------------------------------
_PAGE_URLS = (
    # Links in all the known shapes, built on the page urls.
    "CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN url || '/jobs/view/' || page_id || '?a=1' "
    "WHEN 2 THEN url || '&currentJobId=' || page_id "
    "WHEN 3 THEN 'https://x.example/view/some-title-' || page_id || '/?ref=9-8' ELSE url || '-' || page_id END"
)


def _page_links(spark, sf):
    return A.table(spark, sf, "pages").select("page_id", F.expr(_PAGE_URLS).alias("link"))


_SQL_ID = (
    "coalesce(nullif(regexp_extract(link, '/view/(\\d+)', 1), ''), "
    "nullif(regexp_extract(link, 'currentJobId=(\\d+)', 1), ''), "
    "nullif(regexp_extract(split_part(link, '?', 1), '-(\\d+)(?:/|$)', 1), ''))"
)
_SQL_LINKS = f"WITH links AS (SELECT page_id, {_PAGE_URLS} AS link FROM pages)"


@query("extract_id", f"{_SQL_LINKS} SELECT page_id, {_SQL_ID} AS posting_id FROM links")
def extract_id(spark, sf):
    return _page_links(spark, sf).select("page_id", links.extract_id(F.col("link")).alias("posting_id"))


@query(
    "canonical_link",
    f"{_SQL_LINKS} SELECT page_id, split_part(link, '?', 1) AS bare, '{A.LINK}' || {_SQL_ID} AS job_link FROM links",
)
def canonical_link(spark, sf):
    return _page_links(spark, sf).select(
        "page_id", links.without_query(F.col("link")).alias("bare"),
        links.canonical_link(links.extract_id(F.col("link")), A.LINK).alias("job_link"),
    )


@query("missing_id_filter", f"{_SQL_LINKS} SELECT page_id, {_SQL_ID} AS posting_id FROM links WHERE {_SQL_ID} IS NOT NULL")
def missing_id_filter(spark, sf):
    ids = _page_links(spark, sf).select("page_id", links.extract_id(F.col("link")).alias("posting_id"))
    return filters.missing_id_filter(ids)


# Closed phrases, in text and across tags, and closed classes, added to some pages.
_PAGE_HTML = (
    "html || CASE page_id % 9 WHEN 0 THEN '<p>Esta vaga n&atilde;o aceita<br>mais candidaturas.</p>' "
    "WHEN 1 THEN '<figure class=\"x closed-job\"></figure>' WHEN 2 THEN '<div>NO LONGER accepting applications</div>' "
    "WHEN 3 THEN '<script>var t = \"vaga encerrada\";</script>' WHEN 4 THEN '<b>Vaga encer</b>rada' "
    "WHEN 5 THEN '<!-- vaga encerrada -->' ELSE '' END"
)
_CLOSED = "page_id % 9 IN (0, 1, 2)"


def _closing_pages(spark, sf):
    return A.table(spark, sf, "pages").select("page_id", F.expr(_PAGE_HTML).alias("html"))


@query("closed_flag", f"SELECT page_id, {_CLOSED} AS is_closed FROM pages")
def closed_flag(spark, sf):
    return _closing_pages(spark, sf).select("page_id", html.closed_flag(F.col("html")).alias("is_closed"))


@query("closed_filter", f"SELECT page_id FROM pages WHERE NOT ({_CLOSED})")
def closed_filter(spark, sf):
    flagged = _closing_pages(spark, sf).select("page_id", html.closed_flag(F.col("html")).alias("is_closed"))
    return filters.closed_filter(flagged).select("page_id")


# --- scope and relevance --------------------------------------------------------------------------
@query("title_scope_filter", A.with_postings(f"SELECT job_link, job_title FROM postings WHERE {A.sql_title_reason()} IS NULL"))
def title_scope_filter(spark, sf):
    return filters.title_scope_filter(A.postings(spark, sf)).select("job_link", "job_title")


@query("role_filter", A.with_postings("SELECT job_link FROM postings WHERE k % 5 <> 1"))
def role_filter(spark, sf):
    k = F.col("collect_seq")
    flagged = A.postings(spark, sf).withColumn(
        "core_role_compatible", F.when(k % 5 == 1, False).when(k % 5 == 2, True)
    )
    return filters.role_filter(flagged).select("job_link")


# Scores as text, some of them no numbers.
_SCORE_TEXT = "CASE WHEN k % 6 = 0 THEN 'N/A' WHEN k % 6 = 1 THEN 'NaN' ELSE CAST(confidence_pct / 100.0 AS {}) END"


def _text_scores(spark, sf):
    k, number = F.col("collect_seq"), F.col("confidence_pct").cast("double") / 100
    return A.wide_postings(spark, sf).select(
        "job_link",
        F.when(k % 6 == 0, "N/A").when(k % 6 == 1, "NaN").otherwise(number.cast("string")).alias("score_clt"),
        F.when(k % 7 != 0, F.col("raw_score")).alias("match_score"),
    )


@query(
    "relevance_filter",
    A.with_postings(
        "SELECT job_link, raw_score AS match_score FROM postings "
        "WHERE k % 6 > 1 AND k % 7 <> 0 AND confidence_pct >= 70 AND raw_score >= 70"
    ),
)
def relevance_filter(spark, sf):
    return filters.relevance_filter(_text_scores(spark, sf)).select("job_link", "match_score")


@query(
    "as_float",
    A.with_postings(
        "SELECT job_link, CASE WHEN k % 6 > 1 THEN round(CAST(confidence_pct AS DOUBLE) / 100, 4) END AS score "
        "FROM postings"
    ),
)
def as_float(spark, sf):
    return _text_scores(spark, sf).select("job_link", F.round(numbers.as_float(F.col("score_clt")), 4).alias("score"))


@query("round2", "SELECT l_orderkey, l_linenumber, round_even(l_extendedprice / 7, 2) AS rounded FROM lineitem")
def round2(spark, sf):
    return A.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", numbers.round2(F.col("l_extendedprice") / 7).alias("rounded")
    )


@query(
    "text_search",
    A.with_postings(
        "SELECT job_link, job_title, location FROM postings "
        "WHERE contains(lower(job_title || ' ' || company || ' ' || location), 'norte são')"
    ),
)
def text_search(spark, sf):
    return filters.text_search(A.postings(spark, sf), "  NORTE São ").select("job_link", "job_title", "location")


@query(
    "truncate_notes",
    f"SELECT doc_id, left(text, {rules.NOTES_LENGTH}) AS notes FROM documents",
)
def truncate_notes(spark, sf):
    return A.table(spark, sf, "documents").select(
        "doc_id", F.left(F.col("text"), F.lit(rules.NOTES_LENGTH)).alias("notes")
    )


@query(
    "fmt_date",
    A.with_postings(
        "SELECT job_link, CASE k % 4 WHEN 0 THEN '—' WHEN 1 THEN 'soon' ELSE strftime(posted_at, '%d/%m/%Y') END "
        "AS shown FROM postings"
    ),
)
def fmt_date(spark, sf):
    k = F.col("collect_seq")
    iso = F.date_format("posted_at", "yyyy-MM-dd'T'HH:mm:ss")
    shown = render.fmt_date(F.when(k % 4 == 1, "soon").when(k % 4 > 1, iso))
    return A.postings(spark, sf).select("job_link", shown.alias("shown"))
