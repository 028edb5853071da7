"""Nearest-prototype contract type on embeddings."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

MIN_CLT = 0.55
MIN_MARGIN = 0.08


def _unit(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


def best_cosine(vector: Column, prototypes: Sequence[Sequence[float]], mean_of: int = 1) -> Column:
    """Highest cosine to a prototype group, or the mean of the ``mean_of`` highest.

    Prototypes are configuration (a handful of vectors) and travel with the task, so
    this is a narrow map: one matrix product per Arrow batch, no join, no shuffle.
    """
    group = _unit(np.asarray(prototypes, dtype=np.float64))

    @F.arrow_udf("double")
    def cosine(rows: pa.Array) -> pa.Array:
        missing = rows.is_null().to_numpy(zero_copy_only=False)
        flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        score = np.full(len(rows), np.nan)
        if len(flat):
            scores = _unit(flat.reshape(-1, group.shape[1])) @ group.T
            top = np.sort(scores, axis=1)[:, -mean_of:]
            score[~missing] = top.mean(axis=1)
        return pa.array(score, mask=missing)

    return cosine(vector)


def prototype_classify(df: DataFrame, vector: str, clt: Sequence[Sequence[float]],
                       non_clt: Sequence[Sequence[float]], mean_of: int = 1,
                       min_clt: float = MIN_CLT, min_margin: float = MIN_MARGIN) -> DataFrame:
    """Score both groups and decide CLT, NAO_CLT or AMBIGUA; only CLT is accepted."""
    scored = df.withColumn("score_clt", best_cosine(F.col(vector), clt, mean_of)).withColumn(
        "score_non_clt", best_cosine(F.col(vector), non_clt, mean_of)
    )
    margin = F.col("score_clt") - F.col("score_non_clt")
    accepted = (F.col("score_clt") >= min_clt) & (margin >= min_margin)
    kind = (
        F.when(accepted, "CLT")
        .when(margin <= -min_margin, "NAO_CLT")
        .otherwise("AMBIGUA")
    )
    return scored.withColumns(
        {"contract_margin": margin, "inferred_contract_type": kind, "accepted": accepted}
    )
