"""Model answers: reading, parsing, resolving; prompts; hooks; model lists."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from garimpo import rules, runtime
from garimpo.functions import answers, contract, numbers
from garimpo.operators import chain, filters, hooks, models, prompts, resolve
from garimpo.plans import flow
from workload import adapter as A
from workload.registry import query

_TRIES = "tries AS (SELECT *, UNNEST([0, 1, 2]) AS a, a >= attempt AND answered AS valid FROM answers)"
_MATCH = (
    "answer_score AS match_score, answer_role AS core_role_compatible, 'Python|s' || (k % 4) AS strengths, "
    "'' AS gaps, 'v}} ' || (k % 9) || ' try ' || {} AS verdict"
)
_CONTRACT = "regime, round(CAST(confidence AS DOUBLE), 4) AS confidence, 'e' || (k % 6) || ' try ' || {} AS evidence"


def match_attempts(spark, sf):
    return A.attempts(A.wide_postings(spark, sf), "match")


def contract_attempts(spark, sf):
    return A.attempts(A.wide_postings(spark, sf), "contract")


def _attempt_no():
    return ((F.col("cycle") - 1) * 2 + F.col("provider_rank")).alias("attempt")


def _match_fields(struct: str):
    return [
        F.col(f"{struct}.match_score"), F.col(f"{struct}.core_role_compatible"),
        F.array_join(f"{struct}.strengths", "|").alias("strengths"),
        F.array_join(f"{struct}.gaps", "|").alias("gaps"), F.col(f"{struct}.verdict"),
    ]


# --- reading -------------------------------------------------------------------------------------
@query(
    "response_content",
    A.with_postings("SELECT job_link, CASE WHEN k % 4 = 0 THEN nullif(description, '') END AS content FROM postings"),
)
def response_content(spark, sf):
    k = F.col("collect_seq")
    message = F.struct(F.struct(F.col("description").alias("content")).alias("message"))
    other = F.struct(F.struct(F.lit("second").alias("content")).alias("message"))
    body = (
        F.when(k % 4 == 0, F.to_json(F.struct(F.array(message, other).alias("choices"))))
        .when(k % 4 == 1, F.lit('{"choices": [], "error": {"code": 429}}'))
        .when(k % 4 == 2, F.lit('{"choices": [{"message": {"content": null}}]}'))
        .otherwise(F.lit("<html>bad gateway</html>"))
    )
    return A.postings(spark, sf).select("job_link", answers.response_content(body).alias("content"))


@query(
    "transient_error_flag",
    """SELECT event_id, event_type = 'error' AND event_id % 2 = 0 OR event_type IN ('click', 'view') AS transient
    FROM events""",
)
def transient_error_flag(spark, sf):
    kind, n = F.col("event_type"), F.col("event_id")
    code = F.when(kind == "error", F.when(n % 2 == 0, 503).otherwise(404)).cast("int")
    message = (
        F.when(kind == "click", F.concat(F.lit("Too Many Requests: "), "props"))
        .when(kind == "view", F.concat(F.lit("model OVERLOADED "), "props"))
        .when(kind == "purchase", F.concat(F.lit("bad request "), "props"))
    )
    return A.table(spark, sf, "events").select("event_id", answers.transient_error(code, message).alias("transient"))


_BARE = (
    "CASE WHEN valid THEN CASE custkey % 3 WHEN 2 THEN {prose} ELSE {plain} END "
    "ELSE CASE custkey % 3 WHEN 0 THEN {garbage} WHEN 1 THEN {cut} END END"
)
_RAW_CONTRACT = (
    "'{\"regime\": \" ' || lower(regime) || '\", \"confidence\": ' || CAST(confidence AS DECIMAL(4, 2)) "
    "|| ', \"evidence\": \" e' || (k % 6) || ' try ' || a || ' \"}'"
)


@query(
    "strip_fence",
    A.with_postings(
        "SELECT job_link, a AS attempt, "
        + _BARE.format(
            prose=f"'Here it is: ' || {_RAW_CONTRACT} || ' Hope {{this}} helps.'", plain=_RAW_CONTRACT,
            garbage="'no json at all'", cut=f"trim(substr({_RAW_CONTRACT}, 1, 14))",
        )
        + " AS bare FROM tries",
        A.SQL_ANSWERS, _TRIES,
    ),
)
def strip_fence(spark, sf):
    return contract_attempts(spark, sf).select(
        "job_link", _attempt_no(), answers.strip_fence(F.col("raw_text")).alias("bare")
    )


@query(
    "first_json_object",
    A.with_postings(
        "SELECT job_link, a AS attempt, "
        + _BARE.format(
            prose=_RAW_CONTRACT, plain=_RAW_CONTRACT, garbage="NULL", cut="NULL",
        )
        + " AS candidate FROM tries",
        A.SQL_ANSWERS, _TRIES,
    ),
)
def first_json_object(spark, sf):
    text = answers.strip_fence(F.col("raw_text"))
    return contract_attempts(spark, sf).select(
        "job_link", _attempt_no(), answers.first_json_object(text).alias("candidate")
    )


@query(
    "parse_match",
    A.with_postings(
        f"SELECT job_link, a AS attempt, {_MATCH.format('a')} FROM tries WHERE valid", A.SQL_ANSWERS, _TRIES
    ),
)
def parse_match(spark, sf):
    parsed = resolve.match_answers(match_attempts(spark, sf))
    return parsed.select("job_link", _attempt_no(), *_match_fields("answer"))


@query(
    "parse_contract",
    A.with_postings(
        f"SELECT job_link, a AS attempt, {_CONTRACT.format('a')} FROM tries WHERE valid", A.SQL_ANSWERS, _TRIES
    ),
)
def parse_contract(spark, sf):
    parsed = resolve.contract_answers(contract_attempts(spark, sf))
    return parsed.select(
        "job_link", _attempt_no(), "answer.regime", F.round("answer.confidence", 4).alias("confidence"),
        "answer.evidence",
    )


_BOOLS = ("false", "true", '"No"', '" NÃO "', '"yes"', '""', "0", "2.5", "null", "[]", "[0]", "{}", '{"a":1}')
_FALSE_BOOLS = (0, 2, 3, 5, 6, 9, 11)


@query(
    "coerce_bool",
    f"SELECT o_orderkey, o_orderkey % {len(_BOOLS)} NOT IN {_FALSE_BOOLS} AS flag FROM orders",
)
def coerce_bool(spark, sf):
    raw = F.element_at(F.array(*map(F.lit, _BOOLS)), (F.col("o_orderkey") % len(_BOOLS)).cast("int") + 1)
    read = A.table(spark, sf, "orders").select("o_orderkey", F.try_parse_json(raw).alias("value"))
    return read.select("o_orderkey", answers.coerce_bool(F.col("value")).alias("flag"))


@query(
    "parser_hook",
    A.with_postings(
        "SELECT job_link, a AS attempt, custkey % 3 AS words FROM tries WHERE NOT valid AND custkey % 3 = 0",
        A.SQL_ANSWERS, _TRIES,
    ).replace("custkey % 3 AS words", "4 AS words"),
)
def parser_hook(spark, sf):
    """A caller's own parser: number of words of answers that hold no brace."""
    def words(raw):
        return F.when(~F.contains(raw, F.lit("{")), F.struct(F.size(F.split(raw, " ")).alias("words")))

    return resolve.read_answers(match_attempts(spark, sf), words).select("job_link", _attempt_no(), "answer.words")


@query(
    "provider_registry",
    A.with_postings(
        """SELECT job_link, arg_min(provider, rank) AS provider, min(rank) AS provider_rank, count(*) AS tries FROM (
          SELECT job_link, ['openrouter', 'gemini', 'other'][CAST((k + a) % 3 AS INT) + 1] AS provider,
            CAST((k + a) % 3 AS INT) AS rank FROM tries WHERE (k + a) % 3 < 2) GROUP BY job_link""",
        A.SQL_ANSWERS, _TRIES,
    ),
)
def provider_registry(spark, sf):
    n = (F.col("collect_seq") + F.col("attempt")) % 3
    named = match_attempts(spark, sf).withColumn("attempt", _attempt_no()).withColumn(
        "provider", F.element_at(F.array(*map(F.lit, (*rules.PROVIDERS, "other"))), n.cast("int") + 1)
    )
    ranked = resolve.provider_ranks(named, rules.PROVIDERS)
    return ranked.groupBy("job_link").agg(
        F.min_by("provider", "provider_rank").alias("provider"),
        F.min("provider_rank").alias("provider_rank"), F.count(F.lit(1)).alias("tries"),
    )


_HUNDREDTHS = "[" + ", ".join(str(round(i / 1000, 2)) for i in range(1001)) + "]"


@query(
    "round2_thousandths",
    f"SELECT o_orderkey, {_HUNDREDTHS}[CAST(o_orderkey % 1001 AS INT) + 1]::DOUBLE AS rounded, "
    f"{_HUNDREDTHS}[CAST(o_orderkey % 1001 AS INT) + 1] >= 0.7 AS sure FROM orders",
)
def round2_thousandths(spark, sf):
    """Confidences of three decimals: each of 0.000 to 1.000 with its rounded value."""
    value = (F.col("o_orderkey") % 1001) / F.lit(1000.0)
    return A.table(spark, sf, "orders").select(
        "o_orderkey", numbers.round2(value).alias("rounded"),
        numbers.is_relevant(numbers.round2(value), F.lit(100)).alias("sure"),
    )


# --- resolving ------------------------------------------------------------------------------------
@query(
    "first_valid_response",
    A.with_postings(
        f"""SELECT job_link, 'contract' AS task, CAST(1 + attempt // 2 AS INT) AS cycle,
          CAST(attempt % 2 AS INT) AS provider_rank, {_CONTRACT.format('attempt')} FROM answers WHERE answered""",
        A.SQL_ANSWERS,
    ),
)
def first_valid_response(spark, sf):
    best = resolve.first_valid_response(resolve.contract_answers(contract_attempts(spark, sf)))
    return best.select(
        "job_link", "task", "cycle", "provider_rank", "answer.regime",
        F.round("answer.confidence", 4).alias("confidence"), "answer.evidence",
    )


_RESOLVED = f"""SELECT job_link, job_title,
  CASE WHEN answered THEN answer_score ELSE 50 END AS match_score,
  CASE WHEN answered THEN answer_role ELSE true END AS core_role_compatible,
  CASE WHEN answered THEN 'Python|s' || (k % 4) ELSE '{"|".join(rules.FALLBACK_STRENGTHS)}' END AS strengths,
  CASE WHEN answered THEN '' ELSE '{"|".join(rules.FALLBACK_GAPS)}' END AS gaps,
  CASE WHEN answered THEN 'v}} ' || (k % 9) || ' try ' || attempt ELSE '{rules.FALLBACK_VERDICT}' END AS verdict
FROM answers"""


def _best_match(spark, sf):
    return resolve.first_valid_response(resolve.match_answers(match_attempts(spark, sf)))


def _flat(df):
    return df.select(
        "job_link", "job_title", "match_score", "core_role_compatible",
        F.array_join("strengths", "|").alias("strengths"), F.array_join("gaps", "|").alias("gaps"), "verdict",
    )


@query("response_resolve", A.with_postings(_RESOLVED, A.SQL_ANSWERS))
def response_resolve(spark, sf):
    return _flat(resolve.response_resolve(A.postings(spark, sf), _best_match(spark, sf)))


@query("merge_analysis", A.with_postings(_RESOLVED + " WHERE answered", A.SQL_ANSWERS))
def merge_analysis(spark, sf):
    analyses = _best_match(spark, sf).withColumnRenamed("answer", "analysis")
    return _flat(resolve.merge_analysis(A.postings(spark, sf), analyses))


@query("fallback_analysis", A.with_postings(_RESOLVED.replace("CASE WHEN answered", "CASE WHEN false"), A.SQL_ANSWERS))
def fallback_analysis(spark, sf):
    return _flat(
        A.postings(spark, sf).withColumn("analysis", contract.fallback_analysis()).select("*", "analysis.*")
    )


# --- contract -------------------------------------------------------------------------------------
_OUTSIDE = "regime IN ('PJ', 'FREELANCER', 'ESTAGIO', 'TEMPORARIO')"
_STRONG = A.sql_labels("scan", "company", rules.STRONG_RULES)
_LABELLED = f"labelled AS (SELECT *, {_STRONG} AS labels FROM (SELECT *, {A.sql_fold(A.SQL_SCAN)} AS scan FROM answers))"
_EVIDENCE = f"""'[LLM] regime=' || regime || ' confidence=' || CAST(confidence AS DECIMAL(4, 2)) || '. e' || (k % 6)
  || ' try ' || attempt || CASE WHEN {_OUTSIDE} AND confidence < 0.6
  THEN ' (confidence below 0.60; kept conservatively as assumed CLT).' ELSE '' END"""
SQL_DECIDED = f"""decided AS (SELECT *,
  CASE WHEN labels <> '' THEN 'PJ' WHEN NOT answered THEN 'INDEFINIDO'
    WHEN {_OUTSIDE} AND confidence >= 0.6 THEN regime ELSE 'CLT' END AS inferred_contract_type,
  NOT (labels <> '' OR answered AND {_OUTSIDE} AND confidence >= 0.6) AS accepted,
  CASE WHEN labels = '' AND answered AND NOT {_OUTSIDE} THEN CAST(confidence AS DOUBLE) END AS score_clt,
  CASE WHEN labels <> '' THEN 1.0 WHEN answered AND {_OUTSIDE} THEN CAST(confidence AS DOUBLE) END AS score_non_clt,
  CASE WHEN labels <> '' THEN '{rules.EVIDENCE_STRONG}' || labels
    WHEN NOT answered THEN '{rules.EVIDENCE_NO_ANSWER}' ELSE {_EVIDENCE} END AS contract_evidence
  FROM labelled)"""
DECIDED_PARTS = (A.SQL_ANSWERS, _LABELLED, SQL_DECIDED)
_DECISION = "job_link, inferred_contract_type, accepted, round(score_clt, 4) AS score_clt, round(score_non_clt, 4) AS score_non_clt, contract_evidence"


def best_contract(spark, sf):
    return resolve.first_valid_response(resolve.contract_answers(contract_attempts(spark, sf)))


def best_match(spark, sf):
    return _best_match(spark, sf)


def decided(spark, sf):
    return flow.decide_contract(flow.label_postings(A.postings(spark, sf)), best_contract(spark, sf))


def _decision(df):
    return df.select(
        "job_link", "inferred_contract_type", "accepted", F.round("score_clt", 4).alias("score_clt"),
        F.round("score_non_clt", 4).alias("score_non_clt"), "contract_evidence",
    )


@query("contract_decision", A.with_postings(f"SELECT {_DECISION} FROM decided", *DECIDED_PARTS))
def contract_decision(spark, sf):
    return _decision(decided(spark, sf))


@query("contract_gate", A.with_postings(f"SELECT {_DECISION} FROM decided WHERE accepted", *DECIDED_PARTS))
def contract_gate(spark, sf):
    return _decision(filters.contract_gate(decided(spark, sf)))


@query("evidence_text", A.with_postings(f"SELECT job_link, {_EVIDENCE} AS evidence FROM answers WHERE answered", A.SQL_ANSWERS))
def evidence_text(spark, sf):
    return best_contract(spark, sf).select("job_link", contract.evidence_text(F.col("answer")).alias("evidence"))


@query(
    "posting_record",
    A.with_postings(
        "SELECT collect_seq, job_link, job_title, company, location, workplace_type, "
        "inferred_contract_type AS contract_type, inferred_contract_type, score_clt, score_non_clt, "
        "CAST(NULL AS DOUBLE) AS contract_margin, contract_evidence, description FROM decided",
        *DECIDED_PARTS,
    ),
)
def posting_record(spark, sf):
    return flow.posting_record(decided(spark, sf))


# --- prompts ----------------------------------------------------------------------------------------
PROFILES = (
    prompts.Profile(
        name="data", summary="Builds data products.", level="Sênior",
        skills={"visao_e_ml": ("OCR", "Pose"), "plataformas_para_eventos": ("Kafka", "SQL")},
        soft_skills=("Clear writing",),
    ),
    prompts.Profile(name="plain", text="  Ready-made profile. "),
)
_PROFILE_TEXTS = (
    "Professional Summary:\nBuilds data products.\n\nTechnical Skills (Hard Skills):\n- Visao e ML: OCR, Pose\n"
    "- Plataformas para Eventos: Kafka, SQL\n\nSoft Skills:\n- Clear writing\n\nExperience Level: Sênior",
    "Ready-made profile.",
)


@query(
    "profile_cross",
    A.with_postings(
        "SELECT job_link, profile, profile_text FROM postings, (VALUES "
        + ", ".join(f"('{p.name}', '{t}')" for p, t in zip(PROFILES, _PROFILE_TEXTS))
        + ") AS profiles(profile, profile_text)"
    ),
)
def profile_cross(spark, sf):
    return prompts.profile_cross(A.postings(spark, sf), PROFILES).select("job_link", "profile", "profile_text")


@query(
    "profile_text",
    """SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN c_name ELSE
      'Professional Summary:' || chr(10) || 'Customer of ' || c_mktsegment
      || CASE WHEN c_custkey % 3 <> 0 THEN chr(10) || chr(10) || 'Technical Skills (Hard Skills):' || chr(10)
        || '- Visao e ML: ' || c_mktsegment || ', n' || c_nationkey || chr(10) || '- Runtimes e APIs: SQL' ELSE '' END
      || CASE WHEN c_custkey % 2 = 0 THEN chr(10) || chr(10) || 'Soft Skills:' || chr(10) || '- ' || c_name ELSE '' END
      || chr(10) || chr(10) || 'Experience Level: L' || c_nationkey END AS profile_text
    FROM customer""",
)
def profile_text(spark, sf):
    key, nation = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    skills = F.create_map(
        F.lit("visao_e_ml"), F.array("c_mktsegment", F.concat(F.lit("n"), nation)),
        F.lit("runtimes_e_APIS"), F.array(F.lit("SQL")),
    )
    shown = prompts.profile_text(
        F.when(key % 10 == 0, F.concat(F.lit(" \n"), "c_name", F.lit("\t"))),
        F.concat(F.lit("Customer of "), "c_mktsegment", F.lit("\n")),
        F.when(key % 3 != 0, skills),
        F.when(key % 2 == 0, F.array("c_name")),
        F.concat(F.lit("L"), nation),
    )
    return A.table(spark, sf, "customer").select("c_custkey", shown.alias("profile_text"))


def _sql_template(template: str, **values: str) -> str:
    pieces = re.split(r"<<(\w+)>>", template)
    return " || ".join(values[p] if i % 2 else "'" + p.replace("'", "''") + "'" for i, p in enumerate(pieces))


_FIELDS = {
    "title": "job_title", "company": "company", "location": "location",
    "description": "coalesce(nullif(description, ''), 'No description.')",
}


@query(
    "match_prompt",
    A.with_postings(
        f"SELECT job_link, profile, {_sql_template(prompts.MATCH_TEMPLATE, profile='profile_text', **_FIELDS)} AS prompt "
        "FROM postings, (VALUES "
        + ", ".join(f"('{p.name}', '{t}')" for p, t in zip(PROFILES, _PROFILE_TEXTS))
        + ") AS profiles(profile, profile_text)"
    ),
)
def match_prompt(spark, sf):
    paired = prompts.profile_cross(A.postings(spark, sf), PROFILES)
    return paired.select("job_link", "profile", prompts.match_prompt(F.col("profile_text")).alias("prompt"))


_HINTS = A.sql_labels("scan", "company", rules.STRONG_RULES + rules.HINT_RULES)
_HINT_SQL = f"CASE WHEN hints = '' THEN '' ELSE '{prompts.HINT_LINE}' || hints END"


@query(
    "contract_prompt",
    A.with_postings(
        f"SELECT job_link, {_sql_template(prompts.CONTRACT_TEMPLATE, hints=_HINT_SQL, **_FIELDS)} AS prompt FROM "
        f"(SELECT *, {_HINTS} AS hints FROM (SELECT *, {A.sql_fold(A.SQL_SCAN)} AS scan FROM postings))"
    ),
)
def contract_prompt(spark, sf):
    return flow.label_postings(A.postings(spark, sf), hints=True).select(
        "job_link", prompts.contract_prompt(F.col("hints")).alias("prompt")
    )


# --- hooks --------------------------------------------------------------------------------------------
def _title_scorer(row) -> str:
    """Stands in for a model: scores by title length, fails on some rows."""
    if row["collect_seq"] % 11 == 0:
        raise RuntimeError("model down")
    return '{"match_score": %d, "verdict": "scored"}' % (len(row["job_title"]) * 3)


def _title_scores(batch) -> list[str | None]:
    score = (batch["job_title"].str.len() * 3).astype(str)
    return ('{"match_score": ' + score + ', "verdict": "scored"}').where(batch["collect_seq"] % 11 != 0, None).tolist()


@query(
    "scorer_hook",
    A.with_postings(
        f"""SELECT job_link, CASE WHEN k % 11 = 0 THEN 50 ELSE CAST(least(100, length(job_title) * 3) AS INT) END AS match_score,
          CASE WHEN k % 11 = 0 THEN '{rules.FALLBACK_VERDICT}' ELSE 'scored' END AS verdict FROM postings"""
    ),
)
def scorer_hook(spark, sf):
    postings = A.postings(spark, sf)
    tries = runtime.stage(
        hooks.hook_answers(postings, _title_scorer, ["collect_seq", "job_title"], "match", answer_batch=_title_scores), "tries"
    )
    best = resolve.first_valid_response(resolve.match_answers(tries))
    return resolve.response_resolve(postings, best).select("job_link", "match_score", "verdict")


def _text_classifier(row) -> str | None:
    """Stands in for a model: a temporary contract if the text is short, else CLT."""
    size = len(row["description"] or "")
    if size == 0:
        return None
    regime = "TEMPORARIO" if size < 40 else "CLT"
    return '{"regime": "%s", "confidence": 0.8, "evidence": "size"}' % regime


def _text_classes(batch) -> list[str | None]:
    size = batch["description"].fillna("").str.len()
    regime = (size < 40).map({True: "TEMPORARIO", False: "CLT"})
    texts = '{"regime": "' + regime + '", "confidence": 0.8, "evidence": "size"}'
    return texts.where(size > 0, None).tolist()


@query(
    "classifier_hook",
    A.with_postings(
        f"""SELECT job_link, CASE WHEN labels <> '' THEN 'PJ' WHEN description = '' THEN 'INDEFINIDO'
            WHEN length(description) < 40 THEN 'TEMPORARIO' ELSE 'CLT' END AS inferred_contract_type,
          labels = '' AND (description = '' OR length(description) >= 40) AS accepted FROM labelled""",
        A.SQL_ANSWERS, _LABELLED,
    ),
)
def classifier_hook(spark, sf):
    labelled = flow.label_postings(A.postings(spark, sf))
    labelled = runtime.stage(labelled.select("job_link", "description", "labels"), "labelled")
    tries = runtime.stage(
        hooks.hook_answers(flow.needs_answer(labelled), _text_classifier, ["description"], "contract", answer_batch=_text_classes), "tries"
    )
    best = resolve.first_valid_response(resolve.contract_answers(tries))
    return flow.decide_contract(labelled, best).select("job_link", "inferred_contract_type", "accepted")


def _first_model(row) -> str | None:
    """Over its quota for a third of the rows; no JSON for another."""
    if row["collect_seq"] % 3 == 0:
        raise RuntimeError("HTTP 429: too many requests")
    return "I cannot say {yet}." if row["collect_seq"] % 3 == 1 else _scored(row, 0)


def _second_model(row) -> str | None:
    if row["collect_seq"] % 2 == 0:
        raise ConnectionError("connection refused")
    return f"So: {_scored(row, 1)} {{done}}"


def _other_provider(batch) -> list[str | None]:
    """Answers that are cut off for a fifth of the rows, and in later cycles for a 25th."""
    every = 5 if batch["cycle"].iloc[0] == 1 else 25
    return [_scored(row, 2)[: 12 if row["collect_seq"] % every == 0 else None] for row in batch.to_dict("records")]


def _scored(row, model: int) -> str:
    return '{"match_score": %d, "verdict": "by {%d}"}' % (len(row["job_title"]) + 10 * model, model)


CHAIN = ((chain.Model(_first_model), chain.Model(_second_model)), (chain.Model(lambda row: None, _other_provider),))


@query(
    "answer_chain",
    A.with_postings(
        """SELECT job_link, cycle, provider_rank, model_rank, CAST(length(job_title) + 10 * (provider_rank * 2 + model_rank) AS INT) AS match_score,
          'by {' || (provider_rank * 2 + model_rank) || '}' AS verdict, tries FROM (
          SELECT *, CASE WHEN own THEN 1 WHEN k % 5 <> 0 THEN 1 WHEN k % 25 <> 0 THEN 2 END AS cycle,
            CASE WHEN own THEN 0 WHEN k % 25 <> 0 THEN 1 END AS provider_rank,
            CASE WHEN own THEN CASE WHEN k % 3 = 2 THEN 0 ELSE 1 END WHEN k % 25 <> 0 THEN 0 END AS model_rank,
            CASE WHEN k % 3 = 2 THEN 1 WHEN own THEN 2 ELSE CASE WHEN k % 5 = 0 THEN 2 ELSE 1 END * CASE WHEN k % 3 = 0 THEN 3 ELSE 2 END END AS tries
          FROM (SELECT *, k % 3 = 2 OR k % 3 = 0 AND k % 2 = 1 AS own FROM postings))"""
    ),
)
def answer_chain(spark, sf):
    """Two models of one provider and one of another, each failing in its own way, for two cycles."""
    postings = runtime.stage(A.postings(spark, sf).select("job_link", "collect_seq", "job_title"), "postings")
    tries = chain.answer_chain(
        postings, CHAIN, answers.parse_match, ["collect_seq", "job_title"], "match", runtime.new_folder(spark, "chain"), max_cycles=2
    )
    counts = tries.groupBy("job_link").agg(F.count(F.lit(1)).alias("tries"))
    found = chain.chain_answers(tries).select("job_link", "cycle", "provider_rank", "model_rank", "answer.match_score", "answer.verdict")
    return counts.join(found, "job_link", "left")


# --- model lists ----------------------------------------------------------------------------------------
def _catalog(spark, sf):
    """Parts as models: some free, in several output shapes."""
    key = F.col("p_partkey")
    price = F.when(key % 3 == 0, F.when(key % 2 == 0, "0").otherwise("0.0")).when(key % 3 == 1, "0.002")
    outputs = (
        F.when(key % 5 == 0, F.array(F.lit("text")))
        .when(key % 5 == 1, F.array(F.lit("text"), F.lit("audio")))
    )
    modality = F.when(key % 5 == 2, "text+image->text").when(key % 5 == 3, "text->image")
    return A.table(spark, sf, "part").select(
        key.alias("position"),
        F.concat(F.regexp_replace("p_name", " ", "-"), F.lit("/"), F.floor(key / 6)).alias("id"),
        F.struct(price.alias("prompt"), price.alias("completion")).alias("pricing"),
        F.struct(outputs.alias("output_modalities"), modality.alias("modality")).alias("architecture"),
    )


_FREE = f"""free AS (SELECT p_partkey AS position, replace(p_name, ' ', '-') || '/' || (p_partkey // 6) AS id
  FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 5 IN (0, 2, 4)
  ORDER BY p_partkey LIMIT {rules.MAX_FREE_MODELS})"""


@query("catalog_filter", f"WITH {_FREE} SELECT position, id FROM free")
def catalog_filter(spark, sf):
    return models.catalog_filter(_catalog(spark, sf)).select("position", "id")


_CURATED = (*rules.CURATED_MODELS, "small-ring/0")


@query(
    "ordered_union_distinct",
    f"""WITH {_FREE}, listed AS (
      SELECT 0 AS list_no, CAST(i - 1 AS BIGINT) AS place, {A.sql_list(_CURATED)}[i] AS model_id
      FROM range(1, {len(_CURATED) + 1}) AS t(i)
      UNION ALL SELECT 1, position, id FROM free)
    SELECT model_id, arg_min(list_no, list_no * 1000000000 + place) AS list_no,
      arg_min(place, list_no * 1000000000 + place) AS place FROM listed GROUP BY model_id""",
)
def ordered_union_distinct(spark, sf):
    return models.ordered_union_distinct(_CURATED, models.catalog_filter(_catalog(spark, sf)))
