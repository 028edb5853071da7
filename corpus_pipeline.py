"""From raw documents to packed training bins: five stages, each over all its predecessor kept.

A stage computes a verdict a row, stores it without any text, drops what it staged on the way
and lets the verdict take effect on the table it was given. Where every doc_id is there once
it names the row; else the rows are stored with numbers first.

Defined cases: a row is decided by itself, whatever its doc_id: null ones stay as others do,
repeated rows are equal texts of which one stays, and two texts of one doc_id are two
documents. A null, empty or letterless text is in no language and goes with the first stage;
very long texts are read whole. Ties are decided by doc_id, then by a hash of the whole row.
Helper columns take names that the table does not have. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garimpo import runtime
from garimpo.llm import exact_dedup, language, mixing, ngram_join, packing
from garimpo.llm.common import read_table

ORACLE_SQL = None  # no stage but the second can be said in SQL; tests compare with brute force


def _free(docs: DataFrame, name: str) -> str:
    """`name`, or what must be added to it for a column that `docs` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _rows(docs: DataFrame) -> tuple[DataFrame, str]:
    """`docs` with a number for each row, and the name of that column."""
    key = _free(docs, "row_number")
    ids = docs.select(F.col("doc_id").cast("long").alias("i"))
    odd = ids.filter("i IS NULL").select("i").limit(1).unionAll(ids.groupBy("i").count().filter("count > 1").select("i").limit(1))
    if odd.isEmpty():
        return docs.withColumn(key, F.col("doc_id").cast("long")), key
    return runtime.stage(docs.withColumn(key, F.monotonically_increasing_id()), "rows"), key


def _by_row(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(F.col(key).alias("doc_id"), "text")


def _losers(rows: DataFrame, key: str, groups: DataFrame, largest: bool) -> DataFrame:
    """(row): of each group of `groups` (row, grp) of several rows all but the one with the largest
    or least doc_id; a null doc_id loses against any other, equal ones go by a hash of their contents."""
    columns = [c for c in rows.columns if c != key]
    several = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("grp")
    contested = runtime.stage(groups.join(several, "grp", "left_semi"), "contested")
    known = rows.select(F.col(key).alias("row"), F.col("doc_id").cast("long").alias("i"), F.xxhash64(*columns).alias("h")).join(contested, "row")
    known = runtime.stage(known, "known")
    missing = F.col("i").isNull()
    order = F.struct((~missing if largest else missing).alias("m"), "i", "h", "row")
    best = known.groupBy("grp").agg((F.max(order) if largest else F.min(order)).alias("o")).select(F.col("o.row").alias("row"))
    return known.join(best, "row", "left_anti").select("row")


def _without(docs: DataFrame, losers: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    rows, key = _rows(docs)
    gone = runtime.settled(docs.sparkSession, "verdicts", lambda: losers(rows, key))
    return rows.join(gone.withColumnRenamed("row", key), key, "left_anti").select(*docs.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language, or between two, go. No row is moved for it."""
    return language.accepted(docs, language.dictionaries(language.training_rows(docs)))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts one with the largest doc_id stays."""

    def losers(rows: DataFrame, key: str) -> DataFrame:
        found = runtime.stage(exact_dedup.exact_groups(_by_row(rows, key)).select(F.col("doc_id").alias("row"), F.col("keep_id").alias("grp")), "exact")
        return _losers(rows, key, found, largest=True)

    return _without(docs, losers)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows that similar shingle sets connect one with the least doc_id stays."""

    def losers(rows: DataFrame, key: str) -> DataFrame:
        found = ngram_join.near_duplicates(_by_row(rows, key)).select(F.col("doc_id").alias("row"), F.col("class_id").alias("grp"))
        return _losers(rows, key, runtime.settled(spark, "near", lambda: found), largest=False)

    return _without(docs, losers)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: not at all, once, or several times.

    In the seeded order the rows of a source with a copy more come first, but for a few that
    close the gap. So one row a source says where the border is, and no text is moved for it.
    """
    rows, key = _rows(docs)
    # the seeded order is that of the documents, not of the row numbers
    content, turn, at, late = (_free(docs, name) for name in ("content", "turn", "border", "late"))
    named = rows.withColumn(content, F.xxhash64(*docs.columns))
    size, source = mixing.words(F.col("text")), F.col("source").cast("string")
    tell = (content, key)
    found = mixing.mix(named, F.array(source), size, tell=tell)
    found = found.select(F.col("members")[0].alias("of"), "size", "copies", F.struct("seeded", "doc_id", "size", *tell).alias("place"), F.col(key).alias("row"))
    found = runtime.settled(spark, "mixed", lambda: found)
    worded = F.col("size") > 0
    first = found.groupBy("of", "copies").agg(F.min(F.when(worded, F.col("place"))).alias("first"), F.max(F.when(~worded, F.col("copies"))).alias("none"))
    borders = first.groupBy("of").agg(
        F.min(F.when(F.col("first").isNotNull(), F.struct("copies", "first"))).alias("low"),
        F.max(F.when(F.col("first").isNotNull(), F.col("copies"))).alias("high"), F.max("none").alias("none"),
    )
    borders = runtime.stage(borders.select(F.struct("*").alias(at)), "borders")
    own = F.col("of").eqNullSafe(F.col(f"{at}.of"))
    more = found.filter(worded).join(borders, own).filter((F.col("copies") > F.col(f"{at}.low.copies")) & (F.col("place") > F.col(f"{at}.low.first")))
    more = runtime.stage(more.select(F.col("row").alias(late)), "late")
    place = F.struct(mixing.seeded("doc_id", size, *tell), F.col("doc_id"), size, *tell)
    times = F.when(size == 0, F.col(f"{at}.none")).when((place < F.col(f"{at}.low.first")) | F.col(late).isNotNull(), F.col(f"{at}.high")).otherwise(F.col(f"{at}.low.copies"))
    taken = named.join(borders, source.eqNullSafe(F.col(f"{at}.of"))).join(more, F.col(key) == F.col(late), "left")
    return taken.withColumn(turn, F.explode(F.when(times > 0, F.sequence(F.lit(1), times)))).select(*docs.columns)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document: the bin it goes into, and where."""
    return packing.packed_documents(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language", identify_language),
    ("exact", drop_exact_copies),
    ("near", drop_near_copies),
    ("mix", mix_sources),
    ("pack", pack_bins),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        before, path = path, runtime.new_folder(spark, name)
        with runtime.scratch(spark):
            docs = runtime.stage_at(stage(spark, docs, sf_dir), path)
        if before:
            runtime.drop_folder(spark, before)
    return docs
