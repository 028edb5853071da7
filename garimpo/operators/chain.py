"""Asking a chain of models until one gives a valid answer, in rounds over a whole table.

A round asks one model about all rows still open that come to it, and is stored. Within a
provider the next model is asked where the call itself failed; a text that is no valid answer
sends the row on to the next provider, and so does the failure of the last model. After the
last provider the cycle starts again with what is left. A row leaves with its first valid
answer, so no model ever sees a decided row.

A round reads the rounds of the provider before it and nothing older: what they left open is
their attempts without an answer, so the rounds shrink with what is left to do. A stored
round is never run again: a chain that was ended goes on with the first round that is missing.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from garimpo.functions.answers import transient_error
from garimpo.operators.hooks import AnswerFn, BatchFn, hook_answers
from garimpo.operators.resolve import read_answers


class Model(NamedTuple):
    answer: AnswerFn
    answer_batch: BatchFn | None = None


Providers = Sequence[Sequence[Model]]


def _stored(spark: SparkSession, path: str) -> bool:
    """Was the round written to its end? What a killed run left half done is written anew."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def _left_open(rounds: list[DataFrame]) -> DataFrame:
    """Links that the models of one provider were asked about in vain."""
    failed = F.col("answer").isNull()
    parts = [r.filter(failed & F.col("error_text").isNull()) for r in rounds[:-1]] + [rounds[-1].filter(failed)]
    left = parts[0].select("job_link", "transient")
    for part in parts[1:]:
        left = left.unionAll(part.select("job_link", "transient"))
    return left


def answer_chain(
    postings: DataFrame, providers: Providers, parser: Callable[[Column], Column], inputs: list[str], task: str, folder: str,
    max_cycles: int = 3, retry_wait: float = 0.0, tasks: int | None = None, only_transient: bool = False,
    sleep: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """All attempts of the chain (see ``chain_attempts``), asked for where they are not stored yet.

    ``postings`` should be a stored table. Rows that share a ``job_link`` are asked once, with the
    row least in ``inputs``; rows without one are not asked. A model sees the columns ``inputs`` and
    the number of the ``cycle``. ``tasks`` bounds how many calls run at a time. Before a further
    cycle the driver waits ``retry_wait`` seconds, unless nothing is open. With ``only_transient``
    a row comes into a further cycle only if its last failure was a passing one (quota, limit,
    overload); an invalid answer is none.
    """
    spark = postings.sparkSession
    columns = [c for c in inputs if c != "job_link"]
    rows = postings.select("job_link", *columns).filter(F.col("job_link").isNotNull())
    open_: DataFrame | None = None  # links; None: all
    for cycle in range(1, max_cycles + 1):
        for place, models in enumerate(providers):
            done: list[DataFrame] = []
            for number, model in enumerate(models):
                path = f"{folder}/cycle={cycle}/provider_rank={place}/model_rank={number}"
                if number:
                    open_ = done[-1].filter("error_text IS NOT NULL AND answer IS NULL")
                if not _stored(spark, path):
                    if open_ is not None:
                        if open_.isEmpty():
                            break
                        asked = rows.join(open_.select("job_link"), "job_link", "left_semi")
                    else:
                        asked = rows
                    _ask(asked, columns, model, parser, task, cycle, tasks).write.mode("overwrite").parquet(path)
                done.append(spark.read.parquet(path))
            if not done:
                return chain_attempts(spark, folder)  # nothing is open
            open_ = _left_open(done) if len(done) == len(models) else _left_open([*done, done[-1].filter("false")])
        if cycle < max_cycles:
            if only_transient:
                open_ = open_.filter("transient")
            if open_.isEmpty():
                break
            if retry_wait and not _stored(spark, f"{folder}/cycle={cycle + 1}/provider_rank=0/model_rank=0"):
                sleep(retry_wait)
    return chain_attempts(spark, folder)


def _ask(rows: DataFrame, columns: list[str], model: Model, parser: Callable[[Column], Column], task: str, cycle: int, tasks: int | None) -> DataFrame:
    least = F.struct(*columns) if columns else F.lit(0)
    once = rows.groupBy("job_link").agg(F.min(least).alias("row")).select("job_link", *[F.col("row")[c].alias(c) for c in columns])
    once = once.repartition(tasks) if tasks else once
    tries = hook_answers(once.withColumn("cycle", F.lit(cycle)), model.answer, [*columns, "cycle"], task, cycle=cycle, answer_batch=model.answer_batch)
    read = read_answers(tries, parser, keep_invalid=True)
    passing = F.col("answer").isNull() & F.col("error_text").isNotNull() & transient_error(F.lit(None).cast("int"), F.col("error_text"))
    # cycle, provider and model are in the path
    return read.withColumn("transient", passing).drop("cycle", "provider_rank", "model_rank")


def chain_attempts(spark: SparkSession, folder: str) -> DataFrame:
    """Stored attempts: job_link, task, raw_text, error_text, answer, transient, cycle, provider_rank, model_rank."""
    return spark.read.option("basePath", folder).parquet(folder)


def chain_answers(attempts: DataFrame) -> DataFrame:
    """The valid answer of each link that has one, as ``best_answers`` takes it: at most one a link."""
    return attempts.filter("answer IS NOT NULL").select("job_link", "task", "cycle", "provider_rank", "model_rank", "answer")
