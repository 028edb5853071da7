"""N-gram Jaccard join with Bayesian pruning of candidates.

Documents are sets of five-word shingles. Equal sets are one class from the start. Classes
that agree in one of 32 bands of four MinHash values are candidates (a pair at similarity
0.8 misses all bands with probability 5e-8); candidates that hang together are compared in
blocks (`pairing`). A pair's MinHash values are compared sixteen at a time; it is dropped
once the posterior probability that it reaches the threshold is below `tolerance`. What
remains is verified exactly on the shingle sets.

A member meets only members whose set sizes allow the threshold: sizes fall into classes of
ratio 1.25, and a pair lies in the same class or in neighbouring ones.

Defined cases: a text without words (null, empty, white space) links with nothing; rows that
repeat a doc_id or a text are rows of their own; a row without doc_id links like any other, but names no
set or class: where no row has one, `set_id` and `class_id` are null and all rows are `kept`; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garimpo import runtime
from garimpo.llm import common, pairing, shingles

BANDS, STEP = 32, 16
SLICE = 256  # rows whose texts are copied at a time
_SKETCH = "doc_id long, ref string, key binary, n int, sketch binary"


def least_matches(threshold: float, tolerance: float, step: int = STEP, hashes: int = shingles.HASHES) -> list[int]:
    """After each step: how many values must have matched for a pair to stay.

    With a flat prior the posterior of the similarity after m matches in k is Beta(m + 1, k - m + 1);
    its mass above the threshold is the chance of at most m successes in k + 1 trials.
    """
    found = []
    for k in range(step, hashes + 1, step):
        mass, m = 0.0, -1
        while mass < tolerance:
            m += 1
            mass += comb(k + 1, m) * threshold**m * (1 - threshold) ** (k + 1 - m)
        found.append(m)
    return found


def _ref() -> Column:
    """By which a text is found again: its doc_id, without one its own hash."""
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("#"), F.sha2("text", 256))).alias("ref")


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, ref, key, n, sketch): name, size and MinHash values of each row's shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            texts = [t.as_buffer().to_pybytes() if t.is_valid else None for t in batch.column(1).cast(pa.large_binary())]
            keys, sizes, values = [], [], []
            for s in shingles.shingle_sets(texts, width):
                keys.append(shingles.set_key(s) if len(s) else None)
                sizes.append(len(s))
                values.append(shingles.minhash(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(2).cast(pa.string()), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(values, pa.binary())],
                names=["doc_id", "ref", "key", "n", "sketch"],
            )

    return docs.select("doc_id", "text", F.when(F.col("doc_id").isNull(), _ref()).alias("ref")).mapInArrow(run, _SKETCH)


def _bands(classes: DataFrame) -> DataFrame:
    """(band, cid): 32 rows a class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cid = batch.column(0).to_numpy()
            values = np.stack([np.frombuffer(s.as_buffer(), np.uint64) for s in batch.column(1)])  # two values a word
            pairs = values.reshape(len(cid), BANDS, -1)
            band = np.full((len(cid), BANDS), np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15))
            for i in range(pairs.shape[2]):
                band = shingles.mixed(band ^ pairs[:, :, i])
            yield pa.RecordBatch.from_arrays(
                [pa.array(band.view(np.int64).ravel()), pa.array(np.repeat(cid, BANDS))], names=["band", "cid"]
            )

    return classes.select("cid", "sketch").mapInArrow(run, "band long, cid long")


def _overlaps(left: list[np.ndarray], right: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs (left[a], right[b])."""
    rows, ra = np.unique(a, return_inverse=True)
    columns, rb = np.unique(b, return_inverse=True)
    if len(a) < 4 * (len(rows) + len(columns)):
        return np.array([_overlap(left[i], right[j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)], np.int64)
    one, two = [left[i] for i in rows], [right[j] for j in columns]
    common_ = np.intersect1d(np.concatenate(one), np.concatenate(two))
    total = np.zeros((len(rows), len(columns)), np.float32)
    for at in range(0, len(common_), 4096):  # a slice of the shared shingles at a time
        part = common_[at : at + 4096]
        total += _marks(one, part) @ _marks(two, part).T
    return total[ra, rb].astype(np.int64)


def _overlap(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def _marks(sets: list[np.ndarray], part: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(part)), np.float32)
    for i, s in enumerate(sets):
        x = s[np.searchsorted(s, part[0]) : np.searchsorted(s, part[-1], "right")]
        at = np.searchsorted(part, x)
        out[i, at[part[np.minimum(at, len(part) - 1)] == x]] = 1
    return out


def _similar(sketch: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, least: list[int], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs (left x right, or within left if both are the same) at num/den or more."""
    same = left is right
    matches = np.zeros((len(left), len(right)), np.int16)
    for k in range(STEP):
        matches += sketch[left, k][:, None] == sketch[right, k][None, :]
    stays = matches >= least[0]
    stays &= den * np.minimum(sizes[left][:, None], sizes[right][None, :]) >= num * np.maximum(sizes[left][:, None], sizes[right][None, :])
    if same:
        stays = np.triu(stays, 1)
    i, j = np.nonzero(stays)
    found = matches[i, j].astype(np.int64)
    for step, need in enumerate(least[1:], 1):
        span = slice(step * STEP, (step + 1) * STEP)
        found += (sketch[left[i], span] == sketch[right[j], span]).sum(axis=1)
        go = found >= need
        i, j, found = i[go], j[go], found[go]
    a, b = left[i], right[j]
    if len(a):
        shared = _overlaps(sets, sets, a, b)
        go = den * shared >= num * (sizes[a] + sizes[b] - shared)
        a, b = a[go], b[go]
    return a, b


def near_duplicates(
    docs: DataFrame, width: int = 5, threshold: tuple[int, int] = (4, 5), tolerance: float = 1e-7, block_rows: int = 256, block_shingles: int = 1 << 20
) -> DataFrame:
    """One row per document: doc_id, class_id, set_id, n_links, n_shingles, kept.

    `n_links` counts the other documents whose similarity reaches the threshold, equal ones
    included; `set_id` names the documents with an equal shingle set, `class_id` those that
    links connect, each by its least doc_id; `kept` is true for that document.
    """
    num, den = threshold
    least = least_matches(num / den, tolerance)
    rows = runtime.stage(sketches(docs, width), "sketches")
    classes = runtime.stage(
        rows.filter("key IS NOT NULL").groupBy("key")
        .agg(F.min("doc_id").alias("rep"), F.min("ref").alias("ref"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
        .withColumn("ref", F.coalesce(F.col("rep").cast("string"), "ref")).withColumn("cid", F.monotonically_increasing_id()),
        "classes",
    )
    bands = _bands(classes)
    buckets = bands.groupBy("band").agg(F.min("cid").alias("hub"), F.count(F.lit(1)).alias("members")).filter("members > 1").drop("members")
    stars = bands.join(buckets, "band").filter("cid != hub").select(F.col("hub").alias("a"), F.col("cid").alias("b"))
    together = common.components(stars.distinct())
    # every set with a candidate: its group, size class and block
    ratio = np.log(den / num)
    members = (
        classes.join(together, F.col("cid") == F.col("node")).select("cid", "ref", "key", "copies", "n", "sketch", F.col("root").alias("grp"), F.floor(F.log("n") / F.lit(float(ratio))).cast("int").alias("cls"))
    )
    members = runtime.stage(members, "members")
    blocks = members.groupBy("grp", "cls").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / block_rows), F.ceil(F.sum("n") / block_shingles)).cast("int").alias("blocks")
    )
    around = [blocks.select("grp", (F.col("cls") + d).alias("cls"), F.col("blocks").alias(name)) for d, name in ((0, "own"), (1, "below"), (-1, "above"))]
    dealt = members
    for side in around:
        dealt = dealt.join(side, ["grp", "cls"], "left")
    block = F.pmod(F.xxhash64("cid"), F.col("own")).cast("int")

    def met(size: str, lower: str, cls: int) -> Column:
        """Tasks (class of the lower block, its block, the other block, is the row in the other)."""
        other = F.when(F.col(size).isNull(), F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.col(size) - 1))
        me, first = F.col("block"), {"own": lambda o: F.least(o, F.col("block")), "me": lambda o: F.col("block"), "other": lambda o: o}[lower]
        last = {"own": lambda o: F.greatest(o, me), "me": lambda o: o, "other": lambda o: me}[lower]
        return F.transform(other, lambda o: F.struct(
            (F.col("cls") + cls).alias("c"), F.lit(lower != "own").cast("int").alias("cross"), first(o).alias("i"), last(o).alias("j"),
        ))

    dealt = dealt.withColumn("block", block)
    meetings = F.concat(met("own", "own", 0), met("above", "me", 0), met("below", "other", -1))
    texts = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text").unionByName(
        docs.filter("doc_id IS NULL AND text IS NOT NULL").select("text").distinct(), allowMissingColumns=True
    ).select(_ref(), "text")
    met_rows = dealt.withColumn("m", F.explode(meetings)).select(
        "grp", F.col("m.c").alias("c"), F.col("m.cross").alias("cross"), F.col("m.i").alias("i"), F.col("m.j").alias("j"),
        "cid", "ref", "key", "copies", "n", "sketch", "cls", "block",
    )
    met_rows = met_rows.join(texts, "ref")

    def compare(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        sets, first, seen = [], [], set()
        for at, (s, key) in enumerate(zip(shingles.shingle_sets([t.as_py().encode() for t in table.column("text")], width), table.column("key"), strict=True)):
            if shingles.set_key(s) == key.as_py() and key.as_py() not in seen:  # rows may repeat an id, with another text even
                seen.add(key.as_py())
                sets.append(s)
                first.append(at)
        table = table.take(first)
        ids, copies, sizes, cls, own = (table.column(c).to_numpy().astype(np.int64) for c in ("cid", "copies", "n", "cls", "block"))
        counts = np.zeros(len(ids), np.int64)
        nothing = np.empty(0, np.int64)
        if len(ids) < 2:
            return ids, counts, nothing, nothing
        sketch = np.stack([np.frombuffer(s.as_buffer(), np.uint32) for s in table.column("sketch")])
        c, cross, i, j = (table.column(x)[0].as_py() for x in ("c", "cross", "i", "j"))
        left = np.flatnonzero((cls == c) & (own == i))
        right = left if not cross and i == j else np.flatnonzero((cls == c + 1) if cross else (own == j))
        a, b = _similar(sketch, sizes, sets, left, right, least, num, den)
        np.add.at(counts, a, copies[b])
        np.add.at(counts, b, copies[a])
        return ids, counts, a, b

    found = runtime.stage(pairing.compared(met_rows.select("grp", "c", "cross", "i", "j", "cid", "key", "copies", "n", "sketch", "cls", "block", "text"), ["grp", "c", "cross", "i", "j"], compare), "links")
    counts = found.filter("b IS NULL").groupBy("a").agg(F.sum("n").alias("linked")).withColumnRenamed("a", "cid")
    roots = runtime.stage(common.components(found.filter("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "cid"), "roots")
    names = classes.join(roots, "cid").groupBy("root").agg(F.min("rep").alias("name"))
    named = classes.select("key", "cid", "rep", "copies").join(counts, "cid", "left").join(roots.join(names, "root"), "cid", "left")
    class_id = F.coalesce("name", "rep", "doc_id")
    return rows.join(named, "key", "left").select(
        "doc_id", class_id.alias("class_id"), F.coalesce("rep", "doc_id").alias("set_id"),
        (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("linked", F.lit(0))).cast("long").alias("n_links"),
        F.col("n").alias("n_shingles"), F.col("doc_id").eqNullSafe(class_id).alias("kept"),
    )


SQL = """
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
),
grams AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i : i + 4], ' '))) AS gram
  FROM worded WHERE len(w) > 0
),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
linked AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) = any_value(m.n) AND any_value(m.n) = any_value(o.n) AS same
  FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  JOIN sizes m ON m.doc_id = a.doc_id JOIN sizes o ON o.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id
  HAVING 5 * count(*) >= 4 * (any_value(m.n) + any_value(o.n) - count(*))
),
reached AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.b FROM reached r JOIN linked l ON r.b = l.a
),
classes AS (SELECT a, min(b) AS class_id FROM reached GROUP BY a)
SELECT d.doc_id, class_id,
  least(d.doc_id, coalesce((SELECT min(b) FROM linked l WHERE l.a = d.doc_id AND same), d.doc_id)) AS set_id,
  (SELECT count(*) FROM linked l WHERE l.a = d.doc_id) AS n_links, coalesce(n, 0)::INTEGER AS n_shingles, d.doc_id = class_id AS kept
FROM documents d JOIN classes c ON c.a = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""
