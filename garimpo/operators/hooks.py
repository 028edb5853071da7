"""Plugging a Python model in: one answer text per posting, in Spark tasks.

The hook sees only rows that still need it and only the columns it asks for. Its
answers are rows of the responses table; write them (``runtime.stage``) before
several consumers read them, so that the model runs once per posting.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame

AnswerFn = Callable[[Mapping[str, object]], str | None]
BatchFn = Callable[[pd.DataFrame], Sequence[str | None]]


def hook_answers(df: DataFrame, answer: AnswerFn, inputs: list[str], task: str,
                 provider_rank: int = 0, model_rank: int = 0, cycle: int = 1,
                 answer_batch: BatchFn | None = None) -> DataFrame:
    """Attempts of one model; an exception is a failed attempt.

    ``answer_batch`` answers all rows of an Arrow batch in one call. Only a batch in which
    it fails, or answers too few, goes row by row through ``answer``, as all rows do without it.
    """
    columns = ["job_link", *[c for c in inputs if c != "job_link"]]
    schema = (
        "job_link string, task string, cycle int, provider_rank int, model_rank int, "
        "raw_text string, error_text string"
    )

    def at_once(batch: pd.DataFrame) -> tuple[list, list] | None:
        if answer_batch is None:
            return None
        try:
            texts = list(answer_batch(batch))
        except Exception:  # which row it was, the rows one by one will say
            return None
        return (texts, [None] * len(texts)) if len(texts) == len(batch) else None

    def one_by_one(batch: pd.DataFrame) -> tuple[list, list]:
        texts, errors = [], []
        for row in batch.to_dict("records"):
            try:
                texts.append(answer(row))
                errors.append(None)
            except Exception as problem:  # one bad row must not fail the job
                texts.append(None)
                errors.append(str(problem))
        return texts, errors

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, errors = at_once(batch) or one_by_one(batch)
            yield pd.DataFrame(
                {
                    "job_link": batch["job_link"], "task": task, "cycle": cycle,
                    "provider_rank": provider_rank, "model_rank": model_rank,
                    "raw_text": pd.Series(texts, dtype=object, index=batch.index),
                    "error_text": pd.Series(errors, dtype=object, index=batch.index),
                }
            )

    return df.select(*columns).mapInPandas(run, schema)
