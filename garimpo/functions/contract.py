"""Contract decision from rule labels and a parsed answer."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from garimpo import rules
from garimpo.functions.numbers import round2

def _outcome(inferred: Column, accepted: Column, clt: Column, non_clt: Column, evidence: Column) -> Column:
    nothing = F.lit(None).cast("double")
    return F.struct(
        inferred.alias("inferred_contract_type"),
        accepted.alias("accepted"),
        F.coalesce(clt, nothing).alias("score_clt"),
        F.coalesce(non_clt, nothing).alias("score_non_clt"),
        nothing.alias("contract_margin"),
        evidence.alias("contract_evidence"),
    )


def evidence_text(answer: Column, threshold: float = rules.DISCARD_CONFIDENCE) -> Column:
    """One line on what the model said, and why a doubtful row is kept."""
    confidence = answer["confidence"]
    base = F.rtrim(
        F.format_string(
            "[LLM] regime=%s confidence=%.2f. %s", answer["regime"], round2(confidence), answer["evidence"]
        )
    )
    doubtful = answer["regime"].isin(*rules.NON_CLT_REGIMES) & (confidence < threshold)
    note = f" (confidence below {threshold:.2f}; kept conservatively as assumed CLT)."
    return F.when(doubtful, F.concat(base, F.lit(note))).otherwise(base)


def contract_decision(
    labels: Column, answer: Column, threshold: float = rules.DISCARD_CONFIDENCE
) -> Column:
    """Strong labels reject; no answer keeps; a sure non-CLT regime rejects; else CLT."""
    null = F.lit(None).cast("double")
    regime, confidence = answer["regime"], answer["confidence"]
    outside = regime.isin(*rules.NON_CLT_REGIMES)
    rejected = outside & (confidence >= threshold)
    return (
        F.when(
            F.size(labels) > 0,
            _outcome(
                F.lit("PJ"), F.lit(False), null, F.lit(1.0),
                F.concat(F.lit(rules.EVIDENCE_STRONG), F.array_join(labels, ", ")),
            ),
        )
        .when(
            answer.isNull(),
            _outcome(F.lit("INDEFINIDO"), F.lit(True), null, null, F.lit(rules.EVIDENCE_NO_ANSWER)),
        )
        .otherwise(
            _outcome(
                F.when(rejected, regime).otherwise(F.lit("CLT")),
                ~rejected,
                F.when(~outside, round2(confidence)),
                F.when(outside, round2(confidence)),
                evidence_text(answer, threshold),
            )
        )
    )


def ungated_contract(requested: str | None) -> Column:
    """Outcome when the requested type is not CLT: nothing is inferred or rejected."""
    null = F.lit(None).cast("double")
    wanted = requested or rules.NOT_AVAILABLE
    return _outcome(F.lit(wanted), F.lit(True), null, null, F.lit(rules.EVIDENCE_NO_GATE))


def fallback_analysis(
    score: int = rules.FALLBACK_SCORE, strengths: tuple[str, ...] = rules.FALLBACK_STRENGTHS,
    gaps: tuple[str, ...] = rules.FALLBACK_GAPS, verdict: str = rules.FALLBACK_VERDICT,
) -> Column:
    """Neutral analysis for postings without a valid answer: never discards.

    The default texts are fixed values; a run with other model settings says so in its own.
    """
    return F.struct(
        F.lit(score).alias("match_score"),
        F.lit(True).alias("core_role_compatible"),
        F.array(*map(F.lit, strengths)).alias("strengths"),
        F.array(*map(F.lit, gaps)).alias("gaps"),
        F.lit(verdict).alias("verdict"),
    )
