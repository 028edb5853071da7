"""Joins, dedupe, caps, history, views, status events, ranks, sets, pages, streams."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from garimpo import rules, runtime
from garimpo.functions import render
from garimpo.functions.times import wall_clock
from garimpo.operators import capping, counts, dedupe, history, history_store, prototypes, ranking, status, views
from garimpo.plans import flow, report
from garimpo.schemas import HISTORY_COLUMNS
from garimpo.sources import history_json, pages, search_plan
from garimpo.streaming import ingest, reposts, status_log
from workload import adapter as A
from workload import answer_queries as answered
from workload.registry import query

NOW = dt.datetime.fromisoformat(A.NOW_TEXT)


# --- membership and sets --------------------------------------------------------------------------
@query(
    "known_link_anti",
    A.with_postings("SELECT job_link, job_title FROM postings WHERE job_link NOT IN (SELECT job_link FROM history)", A.SQL_HISTORY),
)
def known_link_anti(spark, sf):
    return history.known_link_anti(A.postings(spark, sf), A.history(spark, sf)).select("job_link", "job_title")


@query(
    "known_link_semi",
    A.with_postings(
        "SELECT seq, link FROM status_events WHERE link IN (SELECT job_link FROM history)", A.SQL_HISTORY,
        A.SQL_EVENTS,
    ),
)
def known_link_semi(spark, sf):
    known = A.history(spark, sf).withColumnRenamed("job_link", "link")
    return history.known_link_semi(A.status_events(spark, sf), known, "link").select("seq", "link")


@query("distinct_links", A.with_postings("SELECT DISTINCT job_link FROM listings", A.SQL_LISTINGS))
def distinct_links(spark, sf):
    wide = A.wide_postings(spark, sf)
    return dedupe.distinct_links(wide.unionByName(A.relisted(wide)))


@query("links_union", A.with_postings("SELECT job_link FROM postings WHERE k % 5 = 0 OR k % 3 = 0"))
def links_union(spark, sf):
    collected = A.postings(spark, sf).filter("collect_seq % 3 = 0")
    return dedupe.links_union(A.history(spark, sf), collected)


@query("collect_union", A.with_postings("SELECT search_group, collect_seq, job_link FROM listings", A.SQL_LISTINGS))
def collect_union(spark, sf):
    wide = A.wide_postings(spark, sf)
    return dedupe.collect_union(wide, A.relisted(wide)).select("search_group", "collect_seq", "job_link")


# --- dedupe and caps ---------------------------------------------------------------------------------
@query(
    "dedupe_reposts",
    A.with_postings(
        "SELECT collect_seq, job_link, job_title, company, location FROM postings QUALIFY row_number() OVER "
        f"(PARTITION BY {A.sql_fold('job_title')}, {A.sql_fold('company')} ORDER BY collect_seq) = 1"
    ),
)
def dedupe_reposts(spark, sf):
    return dedupe.dedupe_reposts(A.postings(spark, sf)).select(
        "collect_seq", "job_link", "job_title", "company", "location"
    )


@query(
    "dedupe_documents",
    "SELECT doc_id, lang, source FROM documents QUALIFY row_number() OVER "
    f"(PARTITION BY {A.sql_fold('text')}, {A.sql_fold('lang')} ORDER BY doc_id) = 1",
)
def dedupe_documents(spark, sf):
    """The same operator on real prose: text as title, language as company."""
    docs = A.table(spark, sf, "documents").withColumnsRenamed({"text": "job_title", "lang": "company"})
    return dedupe.dedupe_reposts(docs, "doc_id").select("doc_id", F.col("company").alias("lang"), "source")


CAP = 40
_OWNED = "owned AS (SELECT * FROM listings QUALIFY row_number() OVER (PARTITION BY job_link ORDER BY search_group, collect_seq) = 1)"


def _listings(spark, sf):
    wide = A.wide_postings(spark, sf)
    return wide.unionByName(A.relisted(wide)).select(*A.POSTING_COLUMNS)


@query(
    "cap_per_group",
    A.with_postings(
        "SELECT search_group, collect_seq, job_link FROM owned QUALIFY row_number() OVER "
        f"(PARTITION BY search_group ORDER BY collect_seq) <= {CAP}",
        A.SQL_LISTINGS, _OWNED,
    ),
)
def cap_per_group(spark, sf):
    return capping.cap_per_group(_listings(spark, sf), CAP).select("search_group", "collect_seq", "job_link")


_GREEDY = [
    f"g{g} AS (SELECT search_group, collect_seq, job_link FROM listings WHERE search_group = {g}"
    + "".join(f" AND job_link NOT IN (SELECT job_link FROM g{e})" for e in range(g))
    + f" ORDER BY collect_seq LIMIT {CAP})"
    for g in range(10)
]


@query(
    "cap_per_group_greedy",
    A.with_postings(" UNION ALL ".join(f"SELECT * FROM g{g}" for g in range(10)), A.SQL_LISTINGS, *_GREEDY),
)
def cap_per_group_greedy(spark, sf):
    return capping.cap_per_group_greedy(_listings(spark, sf), CAP).select(
        "search_group", "collect_seq", "job_link"
    )


@query(
    "limit_cap",
    A.with_postings(
        "SELECT search_group, collect_seq FROM postings QUALIFY row_number() OVER "
        "(PARTITION BY search_group ORDER BY collect_seq) <= 100"
    ),
)
def limit_cap(spark, sf):
    return capping.limit_cap(A.postings(spark, sf), 100).select("search_group", "collect_seq")


@query(
    "limit_cap_large",
    A.with_postings(
        "SELECT search_group, collect_seq FROM (SELECT k AS collect_seq, CASE WHEN search_group <> 3 THEN search_group END AS search_group "
        "FROM postings) QUALIFY row_number() OVER (PARTITION BY search_group ORDER BY collect_seq) <= 20000"
    ),
)
def limit_cap_large(spark, sf):
    """A cap beyond most groups, and a group without a number."""
    rows = A.postings(spark, sf).withColumn("search_group", F.when(F.col("search_group") != 3, F.col("search_group")))
    return capping.limit_cap(rows, 20_000).select("search_group", "collect_seq")


@query(
    "rank_nulls",
    A.with_postings(
        "SELECT job_link, row_number() OVER (ORDER BY CASE WHEN k % 4 <> 0 THEN least(raw_score, 100) ELSE 0 END DESC, "
        "CASE WHEN k % 6 <> 0 THEN k END NULLS LAST, job_link) AS report_rank FROM postings"
    ),
)
def rank_nulls(spark, sf):
    """Every row gets a rank: no score counts as 0, no place in the collection comes last."""
    k = F.col("collect_seq")
    score = F.when(k % 4 != 0, F.least("raw_score", F.lit(100)))
    rows = A.wide_postings(spark, sf).select("job_link", score.alias("match_score"), F.when(k % 6 != 0, k).alias("collect_seq"))
    return ranking.report_rank(rows).select("job_link", "report_rank")


# --- search plan ----------------------------------------------------------------------------------------
_FILTERS = (
    search_plan.SearchFilter("remoto", "Brasil", "900100"),
    search_plan.SearchFilter("híbrido", None, "900200"),
)


def _terms(spark, sf):
    """Search terms: every part, by its name and key."""
    return A.table(spark, sf, "part").select(
        F.col("p_partkey").alias("term_no"), F.concat_ws(" ", "p_name", "p_partkey").alias("term")
    )


_PAIRS = """pairs AS (SELECT p_partkey * 2 + f.filter_no AS search_group, p_name || ' ' || p_partkey AS term, f.*
  FROM part, (VALUES (0, 'híbrido?no', 'Brasil', '900100', '2'), (1, 'x', 'Curitiba', '900200', '3'))
    AS f(filter_no, unused, location, geo_id, model_code))"""


@query("plan_cross", f"WITH {_PAIRS} SELECT search_group, term, filter_no, location, geo_id FROM pairs")
def plan_cross(spark, sf):
    return search_plan.plan_cross(_terms(spark, sf), _FILTERS, "Curitiba").select(
        "search_group", "term", "filter_no", "location", "geo_id"
    )


@query(
    "search_plan",
    f"WITH {_PAIRS} SELECT search_group, term, location, geo_id, model_code, 604800 AS period_seconds, 100 AS cap FROM pairs",
)
def search_plan_query(spark, sf):
    return search_plan.search_plan(_terms(spark, sf), _FILTERS, "Curitiba", "semana", 100)


# --- history -------------------------------------------------------------------------------------------
def _batch(spark, sf):
    """An analysed batch: every third posting, with text defaults left to the upsert."""
    k, pct = F.col("collect_seq"), F.col("confidence_pct").cast("double") / 100
    return A.wide_postings(spark, sf).filter("collect_seq % 3 = 0").select(
        "collect_seq", F.when(k % 30 != 27, F.col("job_link")).otherwise("").alias("job_link"), "job_title",
        F.when(k % 4 != 0, F.col("company")).alias("company"), "location", "workplace_type",
        F.lit("CLT").alias("contract_type"), F.lit("CLT").alias("inferred_contract_type"),
        F.when(k % 2 == 0, pct).alias("score_clt"), F.lit(None).cast("double").alias("score_non_clt"),
        F.lit("now").alias("contract_evidence"), F.col("raw_score").alias("match_score"),
    )


_BATCH = """batch AS (SELECT job_link, job_title, CASE WHEN k % 4 <> 0 THEN company END AS company, location,
    workplace_type, CASE WHEN k % 2 = 0 THEN CAST(confidence_pct AS DOUBLE) / 100 END AS score_clt,
    raw_score AS match_score, k FROM postings WHERE k % 3 = 0 AND k % 30 <> 27)"""
_UPSERTED = f"""upserted AS (SELECT coalesce(n.job_link, o.job_link) AS job_link,
    CASE WHEN n.k IS NULL THEN o.job_title ELSE n.job_title END AS job_title,
    CASE WHEN n.k IS NULL THEN o.company ELSE coalesce(n.company, 'N/A') END AS company,
    CASE WHEN n.k IS NULL THEN o.location ELSE n.location END AS location,
    CASE WHEN n.k IS NULL THEN o.contract_type ELSE 'CLT' END AS contract_type,
    CASE WHEN n.k IS NULL THEN o.inferred_contract_type ELSE 'CLT' END AS inferred_contract_type,
    round(CASE WHEN n.k IS NULL THEN o.score_clt ELSE n.score_clt END, 4) AS score_clt,
    round(CASE WHEN n.k IS NULL THEN o.score_non_clt END, 4) AS score_non_clt,
    CAST(NULL AS DOUBLE) AS contract_margin,
    CASE WHEN n.k IS NULL THEN o.contract_evidence ELSE 'now' END AS contract_evidence,
    CASE WHEN n.k IS NULL THEN o.workplace_type ELSE n.workplace_type END AS workplace_type,
    CASE WHEN n.k IS NULL THEN o.match_score ELSE n.match_score END AS match_score,
    coalesce(o.first_seen_at, TIMESTAMP '{A.NOW_TEXT}') AS first_seen_at,
    CASE WHEN n.k IS NULL THEN o.last_processed_at ELSE TIMESTAMP '{A.NOW_TEXT}' END AS last_processed_at,
    coalesce(o.status, CASE WHEN n.k IS NOT NULL AND NOT (coalesce(n.score_clt >= 0.7, false)
      AND n.match_score >= 70) THEN 'irrelevant' END) AS status,
    o.notes, o.status_updated_at, o.error_class
  FROM history o FULL JOIN batch n ON o.job_link = n.job_link)"""


def _upserted(spark, sf):
    return history.history_upsert(A.history(spark, sf), _batch(spark, sf), wall_clock(NOW))


@query("history_upsert", A.with_postings("SELECT * FROM upserted", A.SQL_HISTORY, _BATCH, _UPSERTED))
def history_upsert(spark, sf):
    return _upserted(spark, sf).withColumns(
        {c: F.round(c, 4) for c in ("score_clt", "score_non_clt")}
    )


@query("history_upsert_stored", A.with_postings("SELECT * FROM upserted", A.SQL_HISTORY, _BATCH, _UPSERTED))
def history_upsert_stored(spark, sf):
    """The same, of a stored history of which only the touched buckets are written again."""
    folder = runtime.new_folder(spark, "history")
    history_store.create(A.history(spark, sf), folder, buckets=32)
    history_store.upsert(runtime.stage(_batch(spark, sf), "batch"), folder, wall_clock(NOW))
    return history_store.read(spark, folder).withColumns({c: F.round(c, 4) for c in ("score_clt", "score_non_clt")})


@query(
    "history_outer",
    A.with_postings(
        """SELECT coalesce(n.job_link, o.job_link) AS job_link, o.k IS NOT NULL AS in_history, n.k IS NOT NULL AS in_batch
        FROM history o FULL JOIN batch n ON o.job_link = n.job_link""", A.SQL_HISTORY, _BATCH,
    ),
)
def history_outer(spark, sf):
    """Which side of the upsert each entry comes from, seen in its columns."""
    at = wall_clock(NOW)
    return _upserted(spark, sf).select(
        "job_link", (F.col("first_seen_at") < at).alias("in_history"),
        (F.col("last_processed_at") == at).alias("in_batch"),
    )


@query(
    "scan_history",
    A.with_postings(
        "SELECT job_link, job_title, match_score, round(score_clt, 4) AS score_clt, first_seen_at, status, notes "
        "FROM history WHERE k % 10 <> 5", A.SQL_ENTRIES,
    ),
)
def scan_history(spark, sf):
    """Files of some thousand entries, some of them no objects, and as many that are cut."""
    past = A.entries(spark, sf).withColumn("k", F.substring_index("job_link", "/", -1).cast("long"))
    fields = [c for c in HISTORY_COLUMNS if c != "job_link"]
    entry = F.when(F.col("k") % 10 == 5, F.lit("7")).otherwise(F.to_json(F.struct(*fields)))
    pair = F.concat(F.lit('"'), "job_link", F.lit('": '), entry)
    documents = past.select(F.floor(F.col("k") / 20_000).alias("doc"), pair.alias("pair")).groupBy("doc").agg(
        F.concat(F.lit("{"), F.array_join(F.collect_list("pair"), ", "), F.lit("}")).alias("value")
    )
    broken = F.struct((-1 - F.col("doc")).alias("doc"), F.expr("left(value, char_length(value) - 300)").alias("value"))
    folder = runtime.new_folder(spark, "documents")
    both = documents.select(F.inline(F.array(F.struct("doc", "value"), broken)))  # each is put together once
    both.write.partitionBy("doc").text(folder)  # one document a file
    return history_json.scan_history(spark, folder).select(
        "job_link", "job_title", "match_score", F.round("score_clt", 4).alias("score_clt"), "first_seen_at",
        "status", "notes",
    )


# --- list view -----------------------------------------------------------------------------------------
def _view(spark, sf):
    return views.job_view(A.entries(spark, sf))


_VIEW_PARTS = (A.SQL_ENTRIES, A.SQL_VIEW)


@query("job_view", A.with_postings("SELECT * EXCLUDE (k) FROM view_rows", *_VIEW_PARTS))
def job_view(spark, sf):
    return _view(spark, sf)


_PENDING = "status = 'error' AND error_class = ''"


@query(
    "tab_filter",
    A.with_postings(
        f"SELECT link, status FROM view_rows WHERE {_PENDING} OR (status <> 'error' AND status <> 'irrelevant' "
        "AND relevant AND status = 'new' AND contains(lower(job_title || ' ' || company || ' ' || location), 'de dados'))",
        *_VIEW_PARTS,
    ),
)
def tab_filter(spark, sf):
    return views.tab_filter(_view(spark, sf), views.ViewFilter(query="de Dados")).select("link", "status")


@query(
    "tab_filter_errors",
    A.with_postings(f"SELECT link, status, error_class FROM view_rows WHERE {_PENDING} OR (status = 'error' AND relevant)", *_VIEW_PARTS),
)
def tab_filter_errors(spark, sf):
    return views.tab_filter(_view(spark, sf), views.ViewFilter(tab="errors")).select("link", "status", "error_class")


@query(
    "tab_filter_applied",
    A.with_postings(f"SELECT link, status FROM view_rows WHERE {_PENDING} OR status = 'applied'", *_VIEW_PARTS),
)
def tab_filter_applied(spark, sf):
    wanted = views.ViewFilter(tab="applied", only_relevant=False)
    return views.tab_filter(_view(spark, sf), wanted).select("link", "status")


@query(
    "status_counts",
    A.with_postings(
        f"""SELECT count(*) FILTER ({_PENDING} OR (status NOT IN ('error', 'irrelevant', 'applied') AND relevant)) AS shown,
          count(*) FILTER (status NOT IN ('error', 'irrelevant')) AS total, count(*) FILTER (status = 'viewed') AS viewed,
          count(*) FILTER (status = 'applied') AS applied, count(*) FILTER (status = 'error') AS errors,
          count(*) FILTER (status = 'irrelevant') AS irrelevant FROM view_rows""", *_VIEW_PARTS,
    ),
)
def status_counts(spark, sf):
    return views.status_counts(_view(spark, sf), views.ViewFilter(only_new=False, hide_applied=True))


@query("last_run", A.with_postings("SELECT max(last_processed_at) AS last_run FROM history", A.SQL_ENTRIES))
def last_run(spark, sf):
    return views.last_run(A.entries(spark, sf))


@query(
    "score_sort",
    A.with_postings("SELECT link, match_score, row_number() OVER (ORDER BY match_score DESC, k) AS position FROM view_rows", *_VIEW_PARTS),
)
def score_sort(spark, sf):
    seq = F.substring_index("link", "/", -1).cast("long")
    ordered = ranking.score_sort(_view(spark, sf).withColumn("seq", seq), "seq")
    return ranking.with_position(ordered).select("link", "match_score", "position")


def _sorted_view(spark, sf, column, direction=None):
    ordered = ranking.typed_sort(
        _view(spark, sf).withColumnRenamed("link", "job_link"), column, direction, ("job_link",)
    )
    return ranking.with_position(ordered).select("job_link", column, "position")


def _sorted_sql(column, key):
    return A.with_postings(
        f"SELECT link AS job_link, {column}, row_number() OVER (ORDER BY {key}, link) AS position FROM view_rows", *_VIEW_PARTS
    )


@query("typed_sort_date", _sorted_sql("first_seen_at", "first_seen_at DESC"))
def typed_sort_date(spark, sf):
    return _sorted_view(spark, sf, "first_seen_at")


@query("typed_sort_number", _sorted_sql("score_clt", "coalesce(score_clt, -1) DESC"))
def typed_sort_number(spark, sf):
    return _sorted_view(spark, sf, "score_clt")


@query(
    "typed_sort_status",
    _sorted_sql("status", "CASE status WHEN 'new' THEN 0 WHEN 'viewed' THEN 1 WHEN 'applied' THEN 2 WHEN 'error' THEN 3 ELSE 99 END"),
)
def typed_sort_status(spark, sf):
    return _sorted_view(spark, sf, "status", "asc")


@query("typed_sort_text", _sorted_sql("location", A.sql_fold("location")))
def typed_sort_text(spark, sf):
    return _sorted_view(spark, sf, "location")


# --- status events ---------------------------------------------------------------------------------------
_EVENT_PARTS = (A.SQL_HISTORY, A.SQL_EVENTS)


def _checked(spark, sf):
    return status.event_validation(A.status_events(spark, sf), A.history(spark, sf))


@query("event_validation", A.with_postings("SELECT * FROM checked", *_EVENT_PARTS))
def event_validation(spark, sf):
    return _checked(spark, sf)


@query("status_fold", A.with_postings("SELECT * FROM folded", *_EVENT_PARTS, A.SQL_FOLD))
def status_fold(spark, sf):
    return status.status_fold(status.valid_events(_checked(spark, sf)))


@query(
    "status_applied",
    A.with_postings(
        """SELECT h.job_link, coalesce(f.status, h.status) AS status, coalesce(f.error_class, h.error_class) AS error_class,
          coalesce(f.notes, h.notes) AS notes, coalesce(f.status_updated_at, h.status_updated_at) AS status_updated_at
        FROM history h LEFT JOIN folded f ON h.job_link = f.job_link""", *_EVENT_PARTS, A.SQL_FOLD,
    ),
)
def status_applied(spark, sf):
    past = A.history(spark, sf)
    folded = status.status_fold(status.valid_events(_checked(spark, sf)))
    return status.apply_status(past, folded).select("job_link", "status", "error_class", "notes", "status_updated_at")


# --- pages ------------------------------------------------------------------------------------------------
def _card_pages(spark, sf):
    """A search page per order: its card, a card without id, and look-alike children; some pages
    have a card that cannot be read, some no readable tree."""
    esc = lambda c: F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("ã"), F.lit("&atilde;"))
    k = F.col("collect_seq")
    urn = F.when(k % 2 == 0, F.concat(F.lit(' data-entity-urn="urn:li:jobPosting:'), k, F.lit('"'))).otherwise("")
    card = F.concat(
        F.lit('<ul><li><div class="base-card relative base-search-card"'), urn, F.lit('>'),
        F.lit('<a class="base-card__full-link x" href="https://x.example/view/some-title-'), k, F.lit('?refId=1-2">go</a>'),
        F.lit('<div class="base-search-card__info"><h3 class="base-search-card__title">\n  '), esc("job_title"),
        F.lit(' <b></b></h3><h4 class="base-search-card__subtitle"><a> '), esc("company"), F.lit("</a></h4>"),
        F.when(k % 5 != 0, F.concat(F.lit('<span class="job-search-card__location">'), esc("location"), F.lit("</span>")))
        .otherwise(""),
        F.lit('</div></div></li><li><div class="base-card"><script>"<div class=base-card>"</script></div></li></ul>'),
        F.when(k % 11 == 0, '<div class="base-card" data-entity-urn="broken"></div>').otherwise(""),
    )
    card = F.when(k % 50 == 49, F.concat(F.lit("<![x[ "), card)).otherwise(card)
    return A.postings(spark, sf).select(k.alias("page_id"), card.alias("html"))


@query(
    "scan_cards",
    A.with_postings(
        f"""SELECT k AS page_id, position, CASE position WHEN 0 THEN job_title ELSE '{rules.UNTITLED}' END AS job_title,
          CASE position WHEN 0 THEN company ELSE '{rules.UNKNOWN_COMPANY}' END AS company,
          CASE WHEN position = 0 AND k % 5 <> 0 THEN location ELSE 'Brasil' END AS location,
          CASE position WHEN 0 THEN CAST(k AS VARCHAR) END AS posting_id,
          CASE position WHEN 0 THEN '{A.LINK}' || k END AS job_link
          , false AS failed
        FROM postings, (VALUES (0), (1)) AS p(position) WHERE k % 50 <> 49
        UNION ALL SELECT k, CASE WHEN k % 50 = 49 THEN -1 ELSE 2 END, NULL, NULL, NULL, NULL, NULL, true
        FROM postings WHERE k % 50 = 49 OR k % 11 = 0"""
    ),
)
def scan_cards(spark, sf):
    """Cards with those that cannot be read, in their places."""
    def read(card):
        if card.attrs.get("data-entity-urn") == "broken":
            raise ValueError("broken card")
        return pages.read_card(card)

    found = pages.card_postings(pages.scan_cards(_card_pages(spark, sf), read), "Brasil", A.LINK)
    return found.withColumn("failed", F.col("error").isNotNull()).drop("error")


@query(
    "scan_detail_text",
    A.with_postings(
        f"""SELECT k AS page_id, CASE WHEN k % 4 = 3 THEN '{rules.DETAIL_EMPTY}' ELSE
            trim(job_title || chr(10) || coalesce(nullif(description, '') || chr(10), '') || '- ' || company || chr(10)
            || '- a & b' || chr(10) || '- ' || location) END AS description, k % 4 = 2 AS is_closed
        FROM postings""".replace("coalesce(nullif(description, '') || chr(10), '')",
                                 "CASE WHEN description = '' THEN chr(10) ELSE description || chr(10) END"),
    ),
)
def scan_detail_text(spark, sf):
    k = F.col("collect_seq")
    kind = F.when(k % 2 == 0, "show-more-less-html__markup x").otherwise("description__text")
    body = F.concat(
        F.lit('<html><body><h1>Page</h1><div class="'), kind, F.lit('"><b>'), "job_title",
        F.lit("</b><br/><p>"), "description", F.lit("</p><ul><li>"), "company",
        F.lit("</li><li>a &amp; <i>b</i></li><!-- x --><li>"), "location", F.lit("</ul></div>"),
        F.when(k % 4 == 2, "<p>Candidaturas<b>encerradas</b></p>").otherwise("<p>Candidate-se</p>"),
    )
    html = F.when(k % 4 == 3, F.concat(F.lit("<p>short "), k, F.lit("</p>"))).otherwise(body)
    found = pages.scan_detail_text(A.postings(spark, sf).select(k.alias("page_id"), html.alias("html")))
    return found.select("page_id", "description", "is_closed")


_PLAIN = r"""regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->', '', 'g'),
  '<[/!?a-zA-Z][^>]*>', '', 'g')"""


@query(
    "scan_detail_whole_page",
    f"""WITH plain AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace({_PLAIN},
        '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', chr(160)), '&amp;', '&') AS page FROM pages)
    SELECT page_id, trim(page, ' ' || chr(10) || chr(9) || chr(13) || chr(160)) AS description FROM plain""",
)
def scan_detail_whole_page(spark, sf):
    return pages.scan_detail_text(A.table(spark, sf, "pages")).select("page_id", "description")


# --- report -----------------------------------------------------------------------------------------------
def _run_postings(spark, sf):
    return A.many_companies(A.postings(spark, sf))


def _analysed(spark, sf):
    return flow.triage(
        _run_postings(spark, sf), A.history(spark, sf), answered.contract_attempts(spark, sf), answered.match_attempts(spark, sf)
    )


def _scored(spark, sf):
    """Every posting as an analysed row, for the report operators."""
    k, pct = F.col("collect_seq"), F.col("confidence_pct").cast("double") / 100
    return A.wide_postings(spark, sf).select(
        "collect_seq", F.when(k % 10 != 0, F.col("job_link")).alias("job_link"),
        F.when(k % 11 != 0, F.concat("job_title", F.lit("\nII"))).alias("job_title"), "company", "location",
        "workplace_type", F.lit("CLT").alias("contract_type"),
        F.when(k % 3 != 0, F.col("regime")).alias("inferred_contract_type"),
        F.when(k % 4 != 0, pct).alias("score_clt"), F.when(k % 4 == 0, pct).alias("score_non_clt"),
        F.lit(None).cast("double").alias("contract_margin"), F.lit("e").alias("contract_evidence"),
        F.least(F.col("raw_score"), F.lit(100)).alias("match_score"),
        F.when(k % 2 == 0, F.array("company", "location")).alias("strengths"),
        F.array().cast("array<string>").alias("gaps"), F.lit("ok").alias("verdict"),
        ((k % 4 != 0) & (F.col("confidence_pct") >= 70) & (F.col("raw_score") >= 70)).alias("relevant"),
    )


def _sql_number(value: str) -> str:
    return f"coalesce(CAST({value} AS VARCHAR), 'N/A')"


_LINE = (
    "'| ' || match_score || ' | ' || " + _sql_number("score_clt") + " || ' | ' || " + _sql_number("score_non_clt")
    + " || ' | N/A | ' || CASE WHEN k % 10 <> 0 THEN '[' || title || '](' || job_link || ')' ELSE title END || ' | ' || company "
    "|| ' | ' || contract || ' | ' || workplace_type || ' | ' || location || ' |'"
)
_SCORED = """scored AS (SELECT k, collect_seq, job_link, company, location, workplace_type,
    CASE WHEN k % 11 = 0 THEN 'N/A' ELSE replace(job_title, '|', '\\|') || ' II' END AS title,
    CASE WHEN k % 11 = 0 THEN 'N/A' ELSE job_title || chr(10) || 'II' END AS raw_title,
    CASE WHEN k % 3 <> 0 THEN regime ELSE 'CLT' END AS contract,
    CASE WHEN k % 4 <> 0 THEN CAST(confidence_pct AS DOUBLE) / 100 END AS score_clt,
    CASE WHEN k % 4 = 0 THEN CAST(confidence_pct AS DOUBLE) / 100 END AS score_non_clt,
    least(raw_score, 100) AS match_score,
    k % 4 <> 0 AND confidence_pct >= 70 AND raw_score >= 70 AS relevant FROM postings)"""


@query("report_row", A.with_postings(f"SELECT collect_seq, {_LINE} AS table_line FROM scored", _SCORED))
def report_row(spark, sf):
    return _scored(spark, sf).select("collect_seq", render.report_row().alias("table_line"))


@query(
    "bullet_list",
    A.with_postings(
        "SELECT collect_seq, CASE WHEN k % 2 = 0 THEN '- ' || company || chr(10) || '- ' || location ELSE '- N/A' END AS strengths, "
        "'- N/A' AS gaps FROM scored", _SCORED,
    ),
)
def bullet_list(spark, sf):
    return _scored(spark, sf).select(
        "collect_seq", render.bullet_list(F.col("strengths")).alias("strengths"),
        render.bullet_list(F.col("gaps")).alias("gaps"),
    )


_RANKED = "ranked AS (SELECT *, row_number() OVER (ORDER BY match_score DESC, collect_seq) AS report_rank FROM scored WHERE relevant)"


@query("report_rank", A.with_postings("SELECT collect_seq, match_score, report_rank FROM ranked", _SCORED, _RANKED))
def report_rank(spark, sf):
    return ranking.report_rank(_scored(spark, sf).filter("relevant")).select("collect_seq", "match_score", "report_rank")


_NL = "chr(10)"
_SECTION = (
    "chr(10) || '## ' || report_rank || '. ' || raw_title || ' - ' || company || chr(10) || chr(10) || '- Match score: ' || match_score "
    "|| '/100' || chr(10) || '- Link: ' || CASE WHEN k % 10 <> 0 THEN job_link ELSE 'N/A' END || chr(10) "
    "|| '- Inferred contract type: ' || contract || chr(10) || '- Score CLT: ' || " + _sql_number("score_clt")
    + " || chr(10) || '- Score Non-CLT: ' || " + _sql_number("score_non_clt") + " || chr(10) || '- Contract margin: N/A' || chr(10) "
    "|| '- Contract evidence: e' || chr(10) || '- Workplace type: ' || workplace_type || chr(10) || '- Location: ' || location "
    "|| chr(10) || chr(10) || '### Strengths' || chr(10) || CASE WHEN k % 2 = 0 THEN '- ' || company || chr(10) || '- ' || location "
    "ELSE '- N/A' END || chr(10) || chr(10) || '### Gaps' || chr(10) || '- N/A' || chr(10) || chr(10) || '### Verdict' || chr(10) "
    "|| 'ok' || chr(10) || chr(10) || '---'"
)
_HEAD = (
    "'# Filtered jobs' || chr(10) || chr(10) || 'Generated at: " + A.NOW_TEXT + "' || chr(10) || 'Jobs shown: ' || "
    "count(*) FILTER (relevant) || ' of ' || count(*) || ' analyzed (filter: CLT score >= 0.7, match score >= 70)' || chr(10) || chr(10) "
    "|| '| Score | Score CLT | Score Non-CLT | Margin | Job | Company | Contract | Model | Location |' || chr(10) "
    "|| '| ---: | ---: | ---: | ---: | --- | --- | --- | --- | --- |'"
)


@query(
    "report_markdown",
    A.with_postings(
        f"SELECT 0 AS part, CAST(0 AS BIGINT) AS position, {_HEAD} AS text FROM scored UNION ALL SELECT 1, report_rank, {_LINE} FROM ranked "
        f"UNION ALL SELECT 2, 0, chr(10) || '---' UNION ALL SELECT 3, report_rank, {_SECTION} FROM ranked", _SCORED, _RANKED,
    ),
)
def report_markdown(spark, sf):
    return report.report_lines(_scored(spark, sf), NOW)


# --- the whole run ------------------------------------------------------------------------------------------
_RUN = (
    *answered.DECIDED_PARTS,
    A.SQL_HISTORY,
    f"""verdicts AS (SELECT *, CASE WHEN NOT ({A.sql_workplace()}) THEN 'location'
      WHEN {A.sql_remote_conflict()} THEN 'remote conflict' WHEN NOT accepted THEN 'contract type' END AS reason,
      {A.sql_title_reason()} AS title_reason
      FROM decided WHERE job_link NOT IN (SELECT job_link FROM history))""",
    f"""uniques AS (SELECT *, count(*) OVER (PARTITION BY {A.sql_fold('job_title')}, {A.sql_fold('company')}) AS copies
      FROM verdicts WHERE reason IS NULL QUALIFY row_number() OVER
      (PARTITION BY {A.sql_fold('job_title')}, {A.sql_fold('company')} ORDER BY collect_seq) = 1)""",
    """analysed AS (SELECT *, CASE WHEN answered THEN answer_score ELSE 50 END AS match_score,
      CASE WHEN answered THEN answer_role ELSE true END AS role_ok FROM uniques WHERE title_reason IS NULL)""",
    """marked AS (SELECT *, coalesce(score_clt >= 0.7, false) AND match_score >= 70 AS relevant FROM analysed WHERE role_ok)""",
)


@query(
    "triage_ranked",
    A.with_many_companies(
        """SELECT row_number() OVER (ORDER BY match_score DESC, collect_seq) AS report_rank, collect_seq, job_link, job_title,
          company, location, match_score, round(score_clt, 4) AS score_clt, inferred_contract_type FROM marked WHERE relevant""",
        *_RUN,
    ),
)
def triage_ranked(spark, sf):
    # Stored once: the counting and the numbering of the ranks, and in a real run the
    # report and the history, all read it.
    analysed = runtime.stage(_analysed(spark, sf), "analysed")
    ranked = ranking.report_rank(analysed.filter("relevant"))
    return ranked.select(
        "report_rank", "collect_seq", "job_link", "job_title", "company", "location", "match_score",
        F.round("score_clt", 4).alias("score_clt"), "inferred_contract_type",
    )


@query(
    "stage_counts",
    A.with_many_companies(
        """SELECT (SELECT count(*) FROM verdicts WHERE reason IS NULL) AS collected, CAST(sum(copies - 1) AS BIGINT) AS duplicates,
          count(*) AS unique_postings, count(*) FILTER (title_reason IS NOT NULL) AS out_of_title_scope,
          (SELECT count(*) FROM analysed WHERE NOT role_ok) AS out_of_role,
          (SELECT count(*) FROM marked WHERE relevant) AS relevant FROM uniques""",
        *_RUN,
    ),
)
def stage_counts(spark, sf):
    return flow.run_counts(
        flow.collect(
            _run_postings(spark, sf), A.history(spark, sf), answered.contract_attempts(spark, sf), keep_description=False
        ),
        answered.match_attempts(spark, sf),
    )


@query(
    "discard_reasons",
    A.with_many_companies(
        """SELECT stage, reason, count(*) AS n FROM (
          SELECT CASE WHEN reason = 'contract type' THEN 'contract' ELSE 'collect' END AS stage, reason FROM verdicts
            WHERE reason IS NOT NULL
          UNION ALL SELECT 'scope', title_reason FROM uniques WHERE title_reason IS NOT NULL
          UNION ALL SELECT 'scope', 'core role' FROM analysed WHERE NOT role_ok) GROUP BY ALL""",
        *_RUN,
    ),
)
def discard_reasons(spark, sf):
    new = history.known_link_anti(_run_postings(spark, sf), A.history(spark, sf))
    judged = runtime.stage(flow.judge(new, answered.contract_attempts(spark, sf)), "judged")
    early = judged.filter("reason is not null").select("job_link", "stage", "reason")
    scope = flow.scope_discards(judged.filter("reason is null"), answered.match_attempts(spark, sf))
    return counts.discard_reasons(early.unionByName(scope))


_COVER = A.sql_labels("scan", "company", rules.STRONG_RULES)
_LABELS = f"labelled AS (SELECT *, {_COVER} AS labels FROM (SELECT *, {A.sql_fold(A.SQL_SCAN)} AS scan FROM postings))"


@query("label_coverage", A.with_postings("SELECT count(*) FILTER (labels <> '') AS covered, count(*) AS total FROM labelled", _LABELS))
def label_coverage(spark, sf):
    return counts.label_coverage(flow.label_postings(A.postings(spark, sf)))


@query(
    "label_frequency",
    A.with_postings(
        "SELECT label, count(*) AS n FROM (SELECT unnest(string_split(labels, ', ')) AS label FROM labelled WHERE labels <> '') GROUP BY label",
        _LABELS,
    ),
)
def label_frequency(spark, sf):
    return counts.label_frequency(flow.label_postings(A.postings(spark, sf)))


# --- prototypes ---------------------------------------------------------------------------------------------
PROTOTYPES_PER_GROUP = 5  # a prototype set is configured by hand: that many vectors stand for it


def _prototypes(spark, sf, label, prototypes_per_group=PROTOTYPES_PER_GROUP):
    rows = A.table(spark, sf, "embeddings").filter(F.col("label") == label).orderBy("vec_id").limit(prototypes_per_group)
    return [r.embedding for r in rows.select("embedding").collect()]


_PROTO = f"(SELECT list(embedding) FROM (SELECT embedding FROM embeddings WHERE label = {{}} ORDER BY vec_id LIMIT {PROTOTYPES_PER_GROUP}))"
_COSINES = "list_max(list_transform({}, lambda p: list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(p AS DOUBLE[]))))"


@query(
    "prototype_classify",
    f"""WITH s AS (SELECT vec_id, {_COSINES.format(_PROTO.format(0))} AS a, {_COSINES.format(_PROTO.format(1))} AS b FROM embeddings)
    SELECT vec_id, round(a, 4) AS score_clt, round(b, 4) AS score_non_clt, round(a - b, 4) AS contract_margin,
      CASE WHEN a >= 0.55 AND a - b >= 0.08 THEN 'CLT' WHEN a - b <= -0.08 THEN 'NAO_CLT' ELSE 'AMBIGUA' END
        AS inferred_contract_type, a >= 0.55 AND a - b >= 0.08 AS accepted FROM s""",
)
def prototype_classify(spark, sf):
    scored = prototypes.prototype_classify(
        A.table(spark, sf, "embeddings"), "embedding", _prototypes(spark, sf, 0), _prototypes(spark, sf, 1)
    )
    return scored.select(
        "vec_id", *[F.round(c, 4).alias(c) for c in ("score_clt", "score_non_clt", "contract_margin")],
        "inferred_contract_type", "accepted",
    )


# --- streams --------------------------------------------------------------------------------------------------
BATCHES, FILES, ROWS_PER_FILE = 3, 4, 100_000


def _files(rows):
    """How many files a micro-batch comes in: a file is read by one task at least, and mostly by one at most."""
    return max(FILES, rows // BATCHES // ROWS_PER_FILE)


def _stream(spark, sf, name, key):
    """A test table as a stream of three micro-batches of some files each: rows by ``key`` mod 3."""
    df, folder = A.table(spark, sf, name), runtime.new_folder(spark, "source")
    files = _files(df.count())
    for part in range(BATCHES):  # one write after the other: the files' times are their order
        df.filter(F.col(key) % BATCHES == part).repartition(files).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(folder)


_STREAMED = tuple(
    part.replace("(PARTITION BY", f"(PARTITION BY k % {BATCHES},") if part.startswith("uniques") else part for part in _RUN
)


@query(
    "stream_ingest",
    A.with_many_companies(
        f"""SELECT job_link, status, last_processed_at FROM history UNION ALL
        SELECT job_link, CASE WHEN NOT relevant THEN 'irrelevant' END, TIMESTAMP '{A.NOW_TEXT}' FROM marked""",
        *_STREAMED,
    ),
)
def stream_ingest(spark, sf):
    """The triage run fed by a stream; reposts are those of a micro-batch, as of a batch run."""
    folder = runtime.new_folder(spark, "ingest")
    postings = A.many_companies(A.from_orders(_stream(spark, sf, "orders", "o_orderkey")).select(*A.POSTING_COLUMNS))

    def analyse(batch):
        return flow.triage(batch, None, answered.contract_attempts(spark, sf), answered.match_attempts(spark, sf))

    ingest.stream_ingest(
        postings, f"{folder}/history", f"{folder}/progress", analyse, wall_clock(NOW), A.history(spark, sf)
    ).awaitTermination()
    return ingest.history_state(spark, f"{folder}/history").select("job_link", "status", "last_processed_at")


_RELEVANT_STREAM = "coalesce(score_clt >= 0.4, false) AND match_score >= 20"


@query(
    "stream_ingest_settings",
    A.with_many_companies(
        f"""SELECT job_link, status FROM history UNION ALL
        SELECT job_link, CASE WHEN NOT ({_RELEVANT_STREAM}) THEN 'irrelevant' END FROM marked""",
        *_STREAMED,
    ),
)
def stream_ingest_settings(spark, sf):
    """The bars of the run, not the default ones, decide what the history stores as irrelevant."""
    folder = runtime.new_folder(spark, "ingest")
    postings = A.many_companies(A.from_orders(_stream(spark, sf, "orders", "o_orderkey")).select(*A.POSTING_COLUMNS))
    bars = flow.TriageSettings(min_clt=0.4, min_match=20)

    def analyse(batch):
        return flow.triage(batch, None, answered.contract_attempts(spark, sf), answered.match_attempts(spark, sf), bars)

    ingest.stream_ingest(
        postings, f"{folder}/history", f"{folder}/progress", analyse, wall_clock(NOW), A.history(spark, sf)
    ).awaitTermination()
    return ingest.history_state(spark, f"{folder}/history").select("job_link", "status")


@query(
    "stream_dedupe",
    A.with_postings(
        "SELECT collect_seq, job_link FROM postings QUALIFY row_number() OVER "
        f"(PARTITION BY {A.sql_fold('job_title')}, {A.sql_fold('company')} ORDER BY k % {BATCHES}, collect_seq) = 1"
    ),
)
def stream_dedupe(spark, sf):
    folder = runtime.new_folder(spark, "reposts")
    stream = A.from_orders(_stream(spark, sf, "orders", "o_orderkey")).select("collect_seq", "job_link", "job_title", "company")
    reposts.stream_dedupe(stream, f"{folder}/kept", f"{folder}/progress").awaitTermination()
    return reposts.kept_postings(spark, f"{folder}/kept", "collect_seq long, job_link string")


@query(
    "stream_dedupe_ttl",
    A.with_many_companies(
        f"SELECT {A.sql_fold('job_title')} AS key_title, {A.sql_fold('company')} AS key_company, count(*) AS kept "
        "FROM (SELECT DISTINCT job_title, company FROM postings) GROUP BY ALL"
    ),
)
def stream_dedupe_ttl(spark, sf):
    """Keys that live longer than the table's years: each is kept once, whichever row comes first."""
    folder = runtime.new_folder(spark, "ttl")
    stream = A.many_companies(A.from_orders(_stream(spark, sf, "orders", "o_orderkey"))).select("job_title", "company", "posted_at", "collect_seq")
    (
        reposts.dedupe_within(stream, "4000 days").writeStream.format("parquet").option("path", f"{folder}/kept")
        .option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    )
    return spark.read.parquet(f"{folder}/kept").groupBy("key_title", "key_company").agg(F.count(F.lit(1)).alias("kept"))


@query("stream_status", A.with_postings("SELECT * FROM folded", *_EVENT_PARTS, A.SQL_FOLD))
def stream_status(spark, sf):
    folder = runtime.new_folder(spark, "status")
    events = A.status_of(_stream(spark, sf, "events", "event_id"))
    status_log.stream_status(events, A.history(spark, sf), folder, f"{folder}/progress").awaitTermination()
    return status_log.status_state(spark, folder)
