"""Import of a history kept as JSON objects ``link -> entry``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from garimpo import runtime
from garimpo.schemas import HISTORY
from garimpo.sources import json_members


_FIELDS = [part.split() for part in HISTORY.split(",") if part.split()[0] != "job_link"]


def _typed(entries: DataFrame, *keep: str) -> DataFrame:
    """The entries' fields, read as texts in one pass over an entry, then each cast by itself."""
    texts = F.try_variant_get("entry", "$", "struct<" + ", ".join(f"{name}: string" for name, _ in _FIELDS) + ">")
    read = entries.select(*keep, "job_link", F.inline_outer(F.array(texts)))
    typed = [F.col(name) if kind == "string" else F.col(name).try_cast(kind).alias(name) for name, kind in _FIELDS]
    return read.select(*keep, "job_link", *typed)


def _is_object() -> Column:
    return F.startswith(F.schema_of_variant("entry"), F.lit("OBJECT"))


def history_entries(documents: DataFrame, body: str = "value") -> DataFrame:
    """One row per entry that is an object; unreadable documents give no rows.

    Two steps, since typing the entries at once would lose the whole document when
    a single entry is, say, a number.
    """
    entries = F.from_json(F.col(body), "map<string,variant>")
    return _typed(documents.select(F.explode(entries).alias("job_link", "entry")).filter(_is_object()))


def scan_history(spark: SparkSession, path: str) -> DataFrame:
    """`history_entries` of the files under ``path``, one document each, of any size.

    A file is read by as many tasks as it has byte ranges. The entries are stored before
    they are returned, as a document that turns out unreadable at its end has none.
    """
    runs = json_members.members(spark, path)
    read = runs.select("file", "sound", F.explode_outer("members").alias("job_link", "entry"))
    stored = runtime.stage(_typed(read.filter(~F.col("sound") | _is_object()), "file", "sound"), "history")
    unreadable = stored.filter(~F.col("sound")).select("file").distinct()
    return stored.join(unreadable, "file", "left_anti").drop("file", "sound")
