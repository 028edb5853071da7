"""The triage run as one lazy plan: collect gates, contract, dedupe, scope, relevance.

Cheap filters come first, answers are read and joined only for rows that need them, and
every folded text is computed once per stage. Where answers come as recorded attempts, the
rows that need them are stored, narrow, before the attempts are cut to their links.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from garimpo import rules, runtime
from garimpo.functions.contract import contract_decision, ungated_contract
from garimpo.functions.labels import hint_labels, strong_labels, title_scope_reason
from garimpo.functions.numbers import is_relevant
from garimpo.functions.places import PlaceRules, workplace_matches
from garimpo.functions.text import fold_word, scan_text
from garimpo.operators.dedupe import dedupe_reposts
from garimpo.operators.columns import computed_once
from garimpo.operators.filters import closed_filter, remote_conflict, workplace_filter
from garimpo.operators.history import known_link_anti
from garimpo.operators.resolve import best_answers, contract_answers, match_answers, response_resolve


@dataclass(frozen=True)
class TriageSettings:
    contract_type: str | None = "CLT"
    discard_confidence: float = rules.DISCARD_CONFIDENCE
    min_clt: float = rules.MIN_CLT_SCORE
    min_match: float = rules.MIN_MATCH_SCORE
    places: PlaceRules = field(default_factory=PlaceRules)

    @property
    def gated(self) -> bool:
        return fold_word(self.contract_type).strip() == "clt"


def collect_verdict(postings: DataFrame, settings: TriageSettings = TriageSettings()) -> DataFrame:
    """Adds ``reason``: why the posting is not collected (place, closed, work model)."""
    reason = F.when(
        ~workplace_matches(F.col("location"), F.col("workplace_type"), settings.places), "location"
    )
    if "is_closed" in postings.columns:
        reason = reason.when(F.coalesce("is_closed", F.lit(False)), "closed")
    reason = reason.when(remote_conflict(), "remote conflict")
    return computed_once(postings, {"reason": reason})


def label_postings(postings: DataFrame, hints: bool = False) -> DataFrame:
    """Adds ``labels`` (strong rules and marketplace), and ``hints`` on request."""
    text = scan_text(F.col("job_title"), F.col("company"), F.col("description"))
    columns = {"labels": strong_labels(text, F.col("company"))}
    if hints:
        columns["hints"] = hint_labels(text, F.col("company"))
    return computed_once(postings, columns)


def needs_answer(labelled: DataFrame) -> DataFrame:
    """Postings no strong label decides: only these go to a model."""
    return labelled.filter(F.size("labels") == 0)


def decide_contract(labelled: DataFrame, best: DataFrame | None,
                    settings: TriageSettings = TriageSettings()) -> DataFrame:
    """Adds the contract columns; ``best`` holds one valid contract answer per link."""
    if not settings.gated:
        decided = labelled.withColumn("_c", ungated_contract(settings.contract_type))
    elif best is None:
        nothing = F.lit(None).cast("struct<regime:string,confidence:double,evidence:string>")
        decided = labelled.withColumn("_answer", nothing).withColumn(
            "_c", contract_decision(F.col("labels"), F.col("_answer"), settings.discard_confidence)
        )
    else:
        found = best.select("job_link", F.col("answer").alias("_answer"))
        decided = labelled.join(found, "job_link", "left").withColumn(
            "_c", contract_decision(F.col("labels"), F.col("_answer"), settings.discard_confidence)
        )
    return decided.select(
        *[c for c in labelled.columns if c != "contract_type"],
        F.col("_c.inferred_contract_type").alias("contract_type"),
        "_c.*",
    )


def posting_record(decided: DataFrame, keep_description: bool = True) -> DataFrame:
    """The stored posting columns, with their defaults."""
    na = F.lit(rules.NOT_AVAILABLE)
    return decided.select(
        "collect_seq", "job_link", "job_title", "company", "location",
        F.coalesce("workplace_type", na).alias("workplace_type"),
        F.coalesce("contract_type", na).alias("contract_type"),
        F.coalesce("inferred_contract_type", na).alias("inferred_contract_type"),
        "score_clt", "score_non_clt", "contract_margin", "contract_evidence",
        *(["description"] if keep_description else []),
    )


def collect(postings: DataFrame, history: DataFrame | None, contract_given: DataFrame | None,
            settings: TriageSettings = TriageSettings(), keep_description: bool = True) -> DataFrame:
    """New, suitable, open postings whose contract type is accepted.

    The short location text is judged first, in or next to the scan; known links leave
    before any description is read; postings a strong label rejects leave before the
    join with the answers. The description is by far the widest column: without it, no
    later shuffle carries it.
    """
    suitable = workplace_filter(postings, places=settings.places)
    if "is_closed" in postings.columns:
        suitable = closed_filter(suitable)
    if history is not None:
        suitable = known_link_anti(suitable, history)
    conflict = computed_once(suitable, {"_conflict": remote_conflict()})
    suitable = conflict.filter(~F.col("_conflict")).drop("_conflict")
    best = None
    if settings.gated:
        suitable = needs_answer(label_postings(suitable))
        if contract_given is not None:
            suitable, best = _with_answers(suitable if keep_description else suitable.drop("description"), contract_given, contract_answers)
    decided = decide_contract(suitable, best, settings)
    return posting_record(decided.filter("accepted"), keep_description)


def _with_answers(rows: DataFrame, given: DataFrame, reader, needing: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """``rows`` and the best answers of those that need one."""
    if "answer" in given.columns:
        return rows, given
    rows = runtime.stage(rows, "to_answer")
    return rows, best_answers(given, rows if needing is None else rows.filter(needing), reader)


def analyse(collected: DataFrame, match_given: DataFrame,
            settings: TriageSettings = TriageSettings()) -> DataFrame:
    """Unique, in-scope postings with their analysis and the ``relevant`` flag."""
    unique = dedupe_reposts(collected)
    in_scope = unique.filter(title_scope_reason(F.col("job_title")).isNull())
    scored = response_resolve(*_with_answers(in_scope, match_given, match_answers)).filter("core_role_compatible")
    return scored.withColumn(
        "relevant",
        is_relevant(F.col("score_clt"), F.col("match_score"), settings.min_clt, settings.min_match,
                    settings.gated),
    )


def run_counts(collected: DataFrame, match_given: DataFrame,
               settings: TriageSettings = TriageSettings()) -> DataFrame:
    """Counters of a run: one pass, copies counted while reposts are removed."""
    unique = dedupe_reposts(collected, copies="copies")
    out_of_title = title_scope_reason(F.col("job_title")).isNotNull()
    flagged = response_resolve(
        *_with_answers(unique.withColumn("_title", out_of_title), match_given, match_answers, ~F.col("_title"))
    )
    relevant = is_relevant(
        F.col("score_clt"), F.col("match_score"), settings.min_clt, settings.min_match, settings.gated
    )
    in_scope = ~F.col("_title") & F.col("core_role_compatible")
    return flagged.agg(
        F.sum("copies").alias("collected"),
        F.sum(F.col("copies") - 1).alias("duplicates"),
        F.count(F.lit(1)).alias("unique_postings"),
        F.count_if("_title").alias("out_of_title_scope"),
        F.count_if(~F.col("_title") & ~F.col("core_role_compatible")).alias("out_of_role"),
        F.count_if(in_scope & relevant).alias("relevant"),
    )


def judge(new: DataFrame, contract_given: DataFrame | None,
          settings: TriageSettings = TriageSettings()) -> DataFrame:
    """Every posting with the ``stage`` and ``reason`` collection drops it for, NULL if kept.

    One pass; stage the result (``runtime.stage``) to both count and go on with it.
    """
    text = scan_text(F.col("job_title"), F.col("company"), F.col("description"))
    found = F.when(F.col("reason").isNull(), strong_labels(text, F.col("company")))
    labels = F.coalesce(found, F.array().cast("array<string>"))
    labelled = computed_once(collect_verdict(new, settings), {"labels": labels}).drop("description")
    best = None
    if settings.gated and contract_given is not None:
        undecided = F.col("reason").isNull() & (F.size("labels") == 0)
        labelled, best = _with_answers(labelled, contract_given, contract_answers, undecided)
    refused = F.col("reason").isNull() & ~F.col("accepted")
    stage = F.when(refused, "contract").when(F.col("reason").isNotNull(), "collect")
    return decide_contract(labelled, best, settings).select(
        "collect_seq", "job_link", "job_title", "company", stage.alias("stage"),
        F.coalesce("reason", F.when(refused, F.lit("contract type"))).alias("reason"),
    )


def scope_discards(collected: DataFrame, match_given: DataFrame) -> DataFrame:
    """Unique postings that analysis drops: by title rule, or by an incompatible role."""
    unique = dedupe_reposts(collected.select("collect_seq", "job_link", "job_title", "company"))
    judged = computed_once(unique, {"reason": title_scope_reason(F.col("job_title"))})
    resolved = response_resolve(*_with_answers(judged, match_given, match_answers, F.col("reason").isNull()))
    role = F.when(~F.col("core_role_compatible"), F.lit("core role"))
    return resolved.select(
        "job_link", F.lit("scope").alias("stage"), F.coalesce("reason", role).alias("reason")
    ).filter(F.col("reason").isNotNull())


def triage(postings: DataFrame, history: DataFrame | None, contract_given: DataFrame | None,
           match_given: DataFrame, settings: TriageSettings = TriageSettings()) -> DataFrame:
    """Analysed postings of a run, each with ``relevant``; input of report and history.

    Answers are given as recorded attempts, or as one read answer per link.
    """
    collected = collect(postings, history, contract_given, settings, keep_description=False)
    return analyse(collected, match_given, settings)
