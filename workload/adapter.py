"""Postings, answers, history and events derived from the test tables.

The same formulas exist twice: as Spark columns and as SQL text for the comparison
engine. ``k`` is the order key.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

RUN_TS = dt.datetime(2001, 8, 1)
NOW_TEXT = "2026-01-02 03:04:05"

TITLES = (
    "Estatístico de Risco", "Computer Vision Researcher", "Arquiteto de Lagos de Dados e Eventos",
    "Especialista de Dados e BI", "Power BI Report Builder", "Especialista em Pesquisa de Mercado",
    "Analista de Sistema Fiscal", "Programa Trainee Nodejs", "Graduate Statistician",
    "Contract: Speech Annotation", "Forecast Modeller | $38/hr", "Qlikado de Dados Abertos",
)
COMPANIES = ("Vento Norte", "Bravia Labs", "Toptal", "Crossing Hurdles", "Oficina Sul", "Clube Restructuring Ltda", "QZ")
LOCATIONS = (
    "Curitiba, PR", "Floripa, SC", "Grande Florianópolis", "São José dos Campos, SP",
    "Blumenau, SC", "Canadá", "São José do Rio Preto", "Patrocínio Paulista e Franca", "Porto, Portugal",
    "Recife, PE", "São José, Santa Catarina",
)
TEXTS = (
    "Registro em carteira, vale transporte e seguro de vida.",
    "Atuação como pessoa jurídica; é preciso ter CNPJ e emitir nota.",
    "Anywhere in the world, contractor at usd 62 per hour.",
    "Time hybrid: dois dias no escritório central.",
    "Home office ou presencial, conforme o projeto.",
    "Responsável pelo faturamento e pelo budget anual da área.",
    "We hire freelancers and self employed people (c2c, W-2).",
    "Encontros presenciais todas as manhãs.",
    "",
    "Bolsa de estágio; combinamos o valor hora.",
    "Buscamos prestadora de serviços para o site.",
)
MODELS = ("remoto", "hibrido", "presencial")
LINK = "https://jobs.example/view/"
REGIMES = {
    "1-URGENT": "PJ", "2-HIGH": "TEMPORARIO", "3-MEDIUM": "CLT", "4-NOT SPECIFIED": "INDEFINIDO",
    "5-LOW": "CLT",
}


SPREAD = "workload.spread"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table as it is. A session that measures the single small files of the test
    data may ask for them to be dealt to so many tasks; no other session does."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    tasks = spark.conf.get(SPREAD, None)
    return df.repartition(int(tasks)) if tasks else df


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), index.cast("int") + 1)


def sql_list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


# --- postings --------------------------------------------------------------------------------
def from_orders(orders: DataFrame) -> DataFrame:
    """Postings plus the raw fields answers are made of."""
    k, cust = F.col("o_orderkey"), F.col("o_custkey")
    regime = F.lit(None).cast("string")
    for priority, name in REGIMES.items():
        regime = F.when(F.col("o_orderpriority") == priority, F.lit(name)).otherwise(regime)
    return orders.select(
        k.alias("collect_seq"),
        F.concat(F.lit(LINK), k).alias("job_link"),
        _pick(TITLES, k % 12).alias("job_title"),
        _pick(COMPANIES, F.expr("(o_orderkey div 5) % 7")).alias("company"),
        _pick(LOCATIONS, F.expr("(o_orderkey div 3) % 11")).alias("location"),
        _pick(MODELS, k % 3).alias("workplace_type"),
        _pick(TEXTS, cust % 11).alias("description"),
        F.col("o_orderdate").alias("posted_at"),
        (cust % 10).cast("int").alias("search_group"),
        regime.alias("regime"),
        (k % 101).alias("confidence_pct"),
        (F.floor("o_totalprice") % 130).cast("int").alias("raw_score"),
        cust.alias("custkey"),
    )


def wide_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_orders(table(spark, sf_dir, "orders"))


POSTING_COLUMNS = (
    "collect_seq", "job_link", "job_title", "company", "location", "workplace_type",
    "description", "posted_at", "search_group",
)


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide_postings(spark, sf_dir).select(*POSTING_COLUMNS)


def many_companies(base: DataFrame) -> DataFrame:
    """Postings of a few hundred companies, so that a run has thousands of repost keys."""
    return base.withColumn("company", F.concat("company", F.lit(" "), F.expr("collect_seq % 89")))


def relisted(base: DataFrame) -> DataFrame:
    """Every eighth posting once more, in a later search group."""
    again = F.expr("cast((custkey + 3) % 10 as int)")
    return base.filter(F.col("collect_seq") % 8 == 0).withColumn("search_group", again)


def _sql_case(column: str, table_: dict[str, str]) -> str:
    return "CASE " + column + " " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in table_.items()) + " END"


SQL_POSTINGS = f"""postings AS (
  SELECT o_orderkey AS collect_seq, '{LINK}' || o_orderkey AS job_link,
    {sql_list(TITLES)}[CAST(o_orderkey % 12 AS INT) + 1] AS job_title,
    {sql_list(COMPANIES)}[CAST((o_orderkey // 5) % 7 AS INT) + 1] AS company,
    {sql_list(LOCATIONS)}[CAST((o_orderkey // 3) % 11 AS INT) + 1] AS location,
    {sql_list(MODELS)}[CAST(o_orderkey % 3 AS INT) + 1] AS workplace_type,
    {sql_list(TEXTS)}[CAST(o_custkey % 11 AS INT) + 1] AS description,
    o_orderdate AS posted_at, CAST(o_custkey % 10 AS INT) AS search_group,
    {_sql_case('o_orderpriority', REGIMES)} AS regime, o_orderkey % 101 AS confidence_pct,
    CAST(CAST(floor(o_totalprice) AS BIGINT) % 130 AS INT) AS raw_score, o_custkey AS custkey,
    o_orderkey AS k
  FROM orders)"""
SQL_LISTINGS = """listings AS (
  SELECT * FROM postings
  UNION ALL BY NAME
  SELECT * REPLACE (CAST((custkey + 3) % 10 AS INT) AS search_group) FROM postings WHERE k % 8 = 0)"""


def with_postings(body: str, *more: str) -> str:
    return "WITH " + ",\n".join((SQL_POSTINGS, *more)) + "\n" + body


def with_many_companies(body: str, *more: str) -> str:
    return with_postings(body, *more).replace(
        "% 7 AS INT) + 1] AS company", "% 7 AS INT) + 1] || ' ' || (o_orderkey % 89) AS company"
    )


def sql_fold(text: str) -> str:
    return f"lower(strip_accents(coalesce({text}, '')))"


# --- answers ------------------------------------------------------------------------------------
def _confidence_text(pct: Column) -> Column:
    return F.concat(F.floor(pct / 100).cast("string"), F.lit("."), F.lpad((pct % 100).cast("string"), 2, "0"))


def _wrapped(valid: Column, raw: Column, custkey: Column) -> Column:
    """Plain, fenced or prose-wrapped when valid; garbage, cut off or missing otherwise."""
    shape = custkey % 3
    good = (
        F.when(shape == 0, raw)
        .when(shape == 1, F.concat(F.lit("```json\n"), raw, F.lit("\n```")))
        .otherwise(F.concat(F.lit("Here it is: "), raw, F.lit(" Hope {this} helps.")))
    )
    bad = F.when(shape == 0, F.lit("no json at all")).when(shape == 1, F.substring(raw, 1, 14))
    return F.when(valid, good).otherwise(bad)


def match_json() -> Column:
    k = F.col("collect_seq")
    role = _pick(("true", "false", '"não"', '"yes"', "null"), k % 5)
    return F.concat(
        F.lit('{"match_score": '), F.col("raw_score"), F.lit(', "core_role_compatible": '), role,
        F.lit(', "strengths": ["Python", "s'), (k % 4).cast("string"),
        F.lit('"], "gaps": [], "verdict": "v} '), (k % 9).cast("string"), F.lit(" try "), F.col("a"), F.lit('"}'),
    )


def contract_json() -> Column:
    return F.concat(
        F.lit('{"regime": " '), F.lower("regime"), F.lit('", "confidence": '),
        _confidence_text(F.col("confidence_pct")), F.lit(', "evidence": " e'),
        (F.col("collect_seq") % 6).cast("string"), F.lit(" try "), F.col("a"), F.lit(' "}'),
    )


def attempts(wide: DataFrame, task: str) -> DataFrame:
    """Three attempts per posting, valid from attempt (3 - k % 3) % 3 on unless k % 7 = 0."""
    k = F.col("collect_seq")
    raw = match_json() if task == "match" else contract_json()
    spread = wide.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("_raw", raw)
    valid = (F.col("a") >= (3 - k % 3) % 3) & (k % 7 != 0)
    return spread.select(
        "job_link", F.lit(task).alias("task"),
        (F.floor(F.col("a") / 2) + 1).cast("int").alias("cycle"),
        (F.col("a") % 2).cast("int").alias("provider_rank"), F.lit(0).alias("model_rank"),
        _wrapped(valid, F.col("_raw"), F.col("custkey")).alias("raw_text"),
        F.col("collect_seq"),
    )


# What the first valid answer says, and which postings have one.
SQL_ANSWERS = """answers AS (
  SELECT *, k % 7 <> 0 AS answered, (3 - k % 3) % 3 AS attempt,
    least(raw_score, 100) AS answer_score,
    k % 5 NOT IN (1, 2) AS answer_role, confidence_pct / 100.0 AS confidence
  FROM postings)"""

# --- history and view -------------------------------------------------------------------------------
STATUS_VALUES = ("new", "viewed", "applied", "error", "irrelevant")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prior entries: every fifth posting, with user columns on most."""
    return history_of(wide_postings(spark, sf_dir))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entry for every posting: what the list view shows."""
    return entries_of(wide_postings(spark, sf_dir))


def history_of(wide: DataFrame) -> DataFrame:
    return entries_of(wide.filter("collect_seq % 5 = 0"))


def entries_of(wide: DataFrame) -> DataFrame:
    k = F.col("collect_seq")
    status = F.when(k % 4 == 1, "viewed").when(k % 4 == 2, "applied").when(k % 4 == 3, "error")
    pct = F.col("confidence_pct").cast("double") / 100
    clt = F.col("regime").isin("CLT", "INDEFINIDO")
    updated = F.when(status.isNotNull(), F.col("posted_at") + F.expr("interval 1 day"))
    return wide.select(
        "job_link", "job_title", "company", "location",
        F.when(k % 3 != 0, F.col("regime")).alias("contract_type"),
        F.when(k % 2 == 0, F.col("regime")).alias("inferred_contract_type"),
        F.when(clt, pct).alias("score_clt"), F.when(~clt, pct).alias("score_non_clt"),
        F.lit(None).cast("double").alias("contract_margin"),
        F.lit("earlier").alias("contract_evidence"),
        "workplace_type", F.least(F.col("raw_score"), F.lit(100)).alias("match_score"),
        F.col("posted_at").alias("first_seen_at"), F.col("posted_at").alias("last_processed_at"),
        status.alias("status"),
        F.when(k % 4 == 2, F.concat(F.lit("note "), k)).alias("notes"),
        updated.alias("status_updated_at"),
        F.when((k % 4 == 3) & (k % 3 == 0), "Não é CLT").alias("error_class"),
    )


SQL_HISTORY = """history AS (
  SELECT job_link, job_title, company, location,
    CASE WHEN k % 3 <> 0 THEN regime END AS contract_type,
    CASE WHEN k % 2 = 0 THEN regime END AS inferred_contract_type,
    CASE WHEN regime IN ('CLT', 'INDEFINIDO') THEN CAST(confidence_pct AS DOUBLE) / 100 END AS score_clt,
    CASE WHEN regime NOT IN ('CLT', 'INDEFINIDO') THEN CAST(confidence_pct AS DOUBLE) / 100 END AS score_non_clt,
    CAST(NULL AS DOUBLE) AS contract_margin, 'earlier' AS contract_evidence, workplace_type,
    least(raw_score, 100) AS match_score, posted_at AS first_seen_at, posted_at AS last_processed_at,
    CASE k % 4 WHEN 1 THEN 'viewed' WHEN 2 THEN 'applied' WHEN 3 THEN 'error' END AS status,
    CASE WHEN k % 4 = 2 THEN 'note ' || k END AS notes,
    CASE WHEN k % 4 <> 0 THEN posted_at + INTERVAL 1 DAY END AS status_updated_at,
    CASE WHEN k % 4 = 3 AND k % 3 = 0 THEN 'Não é CLT' END AS error_class, k
  FROM postings WHERE k % 5 = 0)"""
SQL_ENTRIES = SQL_HISTORY.replace(" WHERE k % 5 = 0", "")
SQL_VIEW = """view_rows AS (
  SELECT job_link AS link, job_title, company, location, workplace_type,
    coalesce(inferred_contract_type, contract_type, 'N/A') AS inferred_contract_type, score_clt,
    match_score, first_seen_at, last_processed_at, coalesce(status, 'new') AS status,
    coalesce(error_class, '') AS error_class, coalesce(notes, '') AS notes,
    coalesce(score_clt >= 0.7, false) AND match_score >= 70 AS relevant, k
  FROM history)"""


# --- status events ----------------------------------------------------------------------------------
def status_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as status updates: mostly known links, some unknown, some malformed."""
    return status_of(table(spark, sf_dir, "events"))


def status_of(e: DataFrame) -> DataFrame:
    status = (
        F.when(F.col("event_type") == "view", "viewed").when(F.col("event_type") == "purchase", "applied")
        .when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "new")
    )
    n = F.col("event_id")
    user = F.col("user_id")
    link = F.concat(F.lit(LINK), F.when(user % 10 == 0, user * 5 + 1).otherwise(user * 5))
    return e.select(
        n.alias("seq"), "ts",
        F.when(n % 97 == 0, F.lit("")).otherwise(link).alias("link"),
        F.when(n % 89 == 0, F.lit("bogus")).otherwise(status).alias("status"),
        F.when((F.col("event_type") == "click") & (n % 3 != 0), F.col("props")).alias("notes"),
        F.when(n % 83 == 0, F.lit("other"))
        .when((F.col("event_type") == "error") & (n % 2 == 0), F.lit("Escopo incorreto"))
        .alias("error_class"),
    )


SQL_EVENTS = f"""status_events AS (
  SELECT event_id AS seq, ts,
    CASE WHEN event_id % 97 = 0 THEN ''
      ELSE '{LINK}' || CASE WHEN user_id % 10 = 0 THEN user_id * 5 + 1 ELSE user_id * 5 END END AS link,
    CASE WHEN event_id % 89 = 0 THEN 'bogus' ELSE
      CASE event_type WHEN 'view' THEN 'viewed' WHEN 'purchase' THEN 'applied' WHEN 'error' THEN 'error'
        WHEN 'signup' THEN 'new' END END AS status,
    CASE WHEN event_type = 'click' AND event_id % 3 <> 0 THEN props END AS notes,
    CASE WHEN event_id % 83 = 0 THEN 'other'
      WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'Escopo incorreto' END AS error_class
  FROM events),
checked AS (
  SELECT e.*, CASE
    WHEN link = '' THEN 'missing link'
    WHEN status IS NULL AND notes IS NULL AND error_class IS NULL THEN 'nothing to update'
    WHEN status NOT IN ('new', 'viewed', 'applied', 'error') THEN 'invalid status'
    WHEN error_class NOT IN ('', 'Localidade/Modelo incorreto', 'Não é CLT', 'Escopo incorreto')
      THEN 'invalid error_class'
    WHEN link NOT IN (SELECT job_link FROM history) THEN 'unknown link' END AS problem
  FROM status_events e)"""
SQL_FOLD = """folded AS (
  SELECT link AS job_link,
    arg_max(status, ord) FILTER (status IS NOT NULL) AS status,
    arg_max(err, ord) FILTER (err IS NOT NULL) AS error_class,
    arg_max(left(notes, 2000), ord) FILTER (notes IS NOT NULL) AS notes,
    max(ts) AS status_updated_at
  FROM (SELECT *, row_number() OVER (ORDER BY ts, seq) AS ord,
          coalesce(error_class, CASE WHEN status <> 'error' THEN '' END) AS err
        FROM checked WHERE problem IS NULL)
  GROUP BY link)"""

# --- labels in SQL ------------------------------------------------------------------------------------
def sql_labels(text: str, company: str, table_) -> str:
    """Labels joined with ', ', or '' when there are none."""
    from garimpo.rules import PLATFORMS, PLATFORM_LABEL

    parts = [
        f"CASE WHEN regexp_matches({text}, '{pattern}') THEN '{label}' END" for label, pattern in table_
    ]
    platform = "CASE " + " ".join(
        f"WHEN contains({sql_fold(company)}, '{p}') THEN '{PLATFORM_LABEL}{p}'" for p in PLATFORMS
    ) + " END"
    return "concat_ws(', ', " + ", ".join([*parts, platform]) + ")"


SQL_SCAN = "concat_ws(' ', nullif(job_title, ''), nullif(company, ''), nullif(description, ''))"


def sql_workplace() -> str:
    from garimpo.rules import FOREIGN_PLACES

    place = sql_fold("location")
    foreign = " OR ".join(f"contains({place}, '{t}')" for t in FOREIGN_PLACES)
    return f"""CASE WHEN workplace_type = 'remoto' THEN NOT ({foreign})
    WHEN workplace_type = 'hibrido' THEN contains({place}, 'florianopolis') OR contains({place}, 'floripa')
      OR (contains({place}, 'sao jose') AND NOT contains({place}, 'dos campos')
          AND NOT contains({place}, 'do rio preto')
          AND (contains({place}, 'santa catarina') OR regexp_matches({place}, '\\bsc\\b')))
    ELSE true END"""


def sql_remote_conflict() -> str:
    from garimpo.rules import ONSITE_PATTERNS, REMOTE_PATTERNS

    text = sql_fold("description")
    onsite = "|".join(ONSITE_PATTERNS)
    remote = "|".join(REMOTE_PATTERNS)
    return (
        f"(workplace_type = 'remoto' AND regexp_matches({text}, '{onsite}') "
        f"AND NOT regexp_matches({text}, '{remote}'))"
    )


def sql_title_reason() -> str:
    from garimpo.rules import TITLE_RULES

    title = sql_fold("job_title")
    return "CASE " + " ".join(
        f"WHEN regexp_matches({title}, '{pattern}') THEN '{reason}'" for reason, pattern in TITLE_RULES
    ) + " END"
