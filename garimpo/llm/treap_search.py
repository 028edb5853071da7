"""Ranked lexical search over K2-treaps of the term-document grid.

Terms are rows, documents are columns, and the cell of a term in a document holds its impact,
the term's part of the document's score. Each range of `span` documents has a tree of its own:
the grid is quartered again and again down to single cells, empty quarters are left out, and
every node keeps the greatest impact below it (stored as the gap to its parent's). An item
descends with all the paths of its rows at once: a range of documents is worth at most the sum
of the maxima of the cells that hold its rows there, the most promising ranges are halved
first, and a range that cannot reach the tenth best score so far is never opened. A cell of the
last level is one term in one document, so a range of one document is worth just its score.

Rows lie in order of weight, so that a quarter's maximum fits all its rows. The index holds the
rows of one block of items; items are searched in blocks of about `block_pairs` (item, term)
pairs, the only thing that travels to every task besides two numbers and one document count a
term. A task keeps the best `k` of an item over all its ranges.

Defined cases: a null or termless text has no terms, so it is never found and not counted; a
null doc_id comes last among equal scores; rows that repeat a doc_id are documents of their
own; items that share an item_id, or have none, are one item with the terms of all its rows; an
item without a known term has no rows; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from garimpo import runtime

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BYTES = bytes(b if b > 0x7F or chr(b).isalnum() else 0x20 for b in range(256)).translate(bytes.maketrans(UPPER.encode(), LOWER.encode()))
_POP = np.array([bin(m).count("1") for m in range(16)], np.int32)
_LAST = np.iinfo(np.int64).max
_INDEX = "docs array<long>, height int, masks array<binary>, gaps array<binary>"


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term), each once."""
    lower = F.translate(F.col("text"), UPPER, LOWER)
    return items.select("item_id", F.explode(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))).alias("term")).distinct()


def _postings(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """doc_id, number of terms, and which of `terms` a document holds how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(terms)}
        for batch in batches:
            sizes, rows, counts = [], [], []
            for text in batch.column(1):
                words = bytes(text.as_buffer()).translate(_BYTES).split() if text.is_valid else []
                found = Counter(map(number.get, words))
                found.pop(None, None)
                sizes.append(len(words))
                rows.append(list(found))
                counts.append(list(found.values()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(rows, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))],
                names=["doc_id", "n", "terms", "counts"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(
        run, "doc_id long, n long, terms array<int>, counts array<long>"
    )


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _spread(x: np.ndarray) -> np.ndarray:
    """A zero bit after each of the 32 low bits."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


def build(rows: np.ndarray, cols: np.ndarray, impacts: np.ndarray, height: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Quarters of each level that hold something (four bits a node), and the gap of each node's
    maximum to its parent's; the root's is negative, from 0."""
    codes = _spread(rows) << np.uint64(1) | _spread(cols)
    order = np.argsort(codes)
    codes, top = codes[order], impacts[order]
    masks, maxima, parents = [], [top], []
    for _ in range(height):
        above = codes >> np.uint64(2)
        starts = np.flatnonzero(np.concatenate([[True], above[1:] != above[:-1]]))
        masks.append(np.bitwise_or.reduceat((1 << (codes & np.uint64(3)).astype(np.uint8)).astype(np.uint8), starts))
        parents.append(np.repeat(np.arange(len(starts)), np.diff([*starts, len(codes)])))
        codes, top = above[starts], np.maximum.reduceat(top, starts)
        maxima.append(top)
    maxima, parents = maxima[::-1], parents[::-1]
    return masks[::-1], [-maxima[0], *(a[p] - b for a, b, p in zip(maxima, maxima[1:], parents, strict=False))]


class Treap(NamedTuple):
    """All nodes in one list, level by level, after an empty one that stands for what is absent."""

    height: int
    mask: np.ndarray
    child: np.ndarray
    most: np.ndarray


def opened(height: int, masks: list[np.ndarray], gaps: list[np.ndarray]) -> Treap:
    most = [np.zeros(1, np.int64), -gaps[0]]
    for mask, gap in zip(masks, gaps[1:], strict=True):
        most.append(np.repeat(most[-1], _POP[mask]) - gap)
    mask = np.concatenate([np.zeros(1, np.uint8), *masks, np.zeros(len(gaps[-1]), np.uint8)])
    sizes = _POP[mask]
    return Treap(height, mask, 2 + np.cumsum(sizes) - sizes, np.concatenate(most))


def search(tree: Treap, rows: np.ndarray, ids: np.ndarray, best: tuple[np.ndarray, np.ndarray], k: int, wide: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """`best` (scores, ids; highest first, then least id) with the documents of one tree taken in."""
    scores, names = best
    paths = np.full((1, len(rows)), 1, np.int64)
    level, begin = np.zeros(1, np.int64), np.zeros(1, np.int64)
    bound = tree.most[paths].sum(axis=1)
    while len(bound):
        least = scores[k - 1] if len(scores) >= k else 1
        open_ = np.flatnonzero(bound >= least)
        paths, level, begin, bound = paths[open_], level[open_], begin[open_], bound[open_]
        if not len(bound):
            break
        if len(bound) > wide:
            order = np.argpartition(-bound, wide)
            now, later = order[:wide], order[wide:]
        else:
            now, later = np.arange(len(bound)), np.empty(0, np.int64)
        down = tree.height - 1 - level[now]
        half = (rows[None, :] >> down[:, None] & 1) * 2
        mask, child = tree.mask[paths[now]], tree.child[paths[now]]
        found = []
        for side in (0, 1):
            bit = np.left_shift(1, half + side)
            there = mask & bit
            step = np.where(there, child + _POP[mask & (bit - 1)], 0)
            found.append((step, level[now] + 1, begin[now] + (side << down), tree.most[step].sum(axis=1)))
        step, deeper, at, worth = (np.concatenate(c) for c in zip(*found, strict=True))
        whole = (deeper == tree.height) & (worth >= least)
        if whole.any():
            scores, names = np.append(scores, worth[whole]), np.append(names, ids[at[whole]])
            order = np.lexsort((names, -scores))[:k]
            scores, names = scores[order], names[order]
        goes = (deeper < tree.height) & (worth >= least)
        paths = np.concatenate([paths[later], step[goes]])
        level, begin = np.concatenate([level[later], deeper[goes]]), np.concatenate([begin[later], at[goes]])
        bound = np.concatenate([bound[later], worth[goes]])
    return scores, names


def index(postings: DataFrame, row_of: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int, span: int) -> DataFrame:
    """One row for each `span` documents of a task: their ids and their tree."""
    height = max(1, int(max(span, len(row_of)) - 1).bit_length())

    def tree(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        lists = table.column("terms").combine_chunks()
        cols = np.repeat(np.arange(table.num_rows), np.diff(lists.offsets.to_numpy()))
        rows = lists.flatten().to_numpy()
        tf = table.column("counts").combine_chunks().flatten().to_numpy()
        m = 100 - 90 + 90 * table.column("n").to_numpy() * n_docs // n_terms
        impacts = weights[rows] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[cols]))
        masks, gaps = build(row_of[rows], cols, impacts, height)
        pack = zstandard.ZstdCompressor(level=1).compress
        return pa.RecordBatch.from_arrays(
            [pa.array([table.column("doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([height], pa.int32()),
             pa.array([[pack(x.tobytes()) for x in masks]], pa.list_(pa.binary())),
             pa.array([[pack(x.tobytes()) for x in gaps]], pa.list_(pa.binary()))],
            names=["docs", "height", "masks", "gaps"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, span - size)
                held.append(part)
                at, size = at + part.num_rows, size + part.num_rows
                if size == span:
                    yield tree(held)
                    held, size = [], 0
        if held:
            yield tree(held)

    return postings.filter(F.size("terms") > 0).mapInArrow(run, _INDEX)


def _found(trees: DataFrame, items: list[tuple[int | None, np.ndarray]], k: int) -> DataFrame:
    """(item_id, doc_id, score): the best `k` of each item among the trees of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in items]
        nameless = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in items]
        for batch in batches:
            for docs, height, masks, gaps in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                unpack = zstandard.decompress
                tree = opened(height, [np.frombuffer(unpack(x), np.uint8) for x in masks], [np.frombuffer(unpack(x), np.int64) for x in gaps])
                missing = np.array([d is None for d in docs])
                ids = np.array([_LAST if d is None else d for d in docs], np.int64)
                for i, (_, rows) in enumerate(items):
                    if not missing.any():
                        best[i] = search(tree, rows, ids, best[i], k)
                        continue
                    # places instead of ids, so that a null doc_id is no number
                    order = np.lexsort((ids, missing))
                    place = np.argsort(order)
                    scores, places = search(tree, rows, place, (np.empty(0, np.int64), np.empty(0, np.int64)), k)
                    at = order[places]
                    best[i] = _merged(best[i], (scores[~missing[at]], ids[at[~missing[at]]]), k)
                    nameless[i] = _merged(nameless[i], (scores[missing[at]], ids[at[missing[at]]]), k)
        for (item, _), named, unnamed in zip(items, best, nameless, strict=True):
            n = len(named[0]) + len(unnamed[0])
            yield pa.RecordBatch.from_arrays(
                [pa.array([item] * n, pa.int64()), pa.array([*named[1].tolist(), *[None] * len(unnamed[0])], pa.int64()),
                 pa.array(np.concatenate([named[0], unnamed[0]]))], names=["item_id", "doc_id", "score"],
            )

    return trees.mapInArrow(run, "item_id long, doc_id long, score long")


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    scores, names = np.append(a[0], b[0]), np.append(a[1], b[1])
    order = np.lexsort((names, -scores))[:k]
    return scores[order], names[order]


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, span: int = 4096, block_pairs: int = 100_000, trees_per_task: int = 2) -> DataFrame:
    """(item_id, rank, doc_id, score): the `k` best documents with score above 0 of each item."""
    pairs = runtime.stage(item_terms(items), "terms")
    blocks = max(1, -(-pairs.count() // block_pairs))
    numbered = pairs.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    parts = []
    for block in range(blocks):
        wanted: dict[int | None, list[bytes]] = {}
        for row in numbered.filter(F.col("block") == block).collect():
            wanted.setdefault(row.item_id, []).append(row.term.encode())
        if not wanted:
            continue
        terms = sorted({t for ts in wanted.values() for t in ts})
        postings = runtime.stage(_postings(docs, terms), "postings")
        total = postings.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
        if not total.docs:
            continue
        counts = dict(postings.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
        weights = np.array([weight(total.docs, counts.get(i, 0)) for i in range(len(terms))], np.int64)
        row_of = np.empty(len(terms), np.int64)
        row_of[np.argsort(-weights, kind="stable")] = np.arange(len(terms))
        number = {t: int(row_of[i]) for i, t in enumerate(terms) if counts.get(i)}
        paths = [(item, np.array([number[t] for t in ts if t in number], np.int64)) for item, ts in wanted.items()]
        trees = runtime.stage(index(postings, row_of, weights, total.docs, total.terms, span), "trees")
        tasks = max(1, trees.count() // trees_per_task)
        parts.append(_found(trees.repartition(tasks), [(i, p) for i, p in paths if len(p)], k))
    if not parts:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionAll(part)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS terms
  FROM documents
), size AS (SELECT count(*) AS docs, sum(len(terms)) AS total FROM d WHERE len(terms) > 0),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark),
tf AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) GROUP BY ALL),
w AS (
  SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM tf, size GROUP BY term
), scored AS (
  SELECT item_id, row, doc_id,
         CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // total)))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN w USING (term), size
  GROUP BY item_id, row, doc_id
), placed AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS INTEGER) AS rank, doc_id, score
  FROM scored WHERE score > 0
)
SELECT * FROM placed WHERE rank <= 10
"""
