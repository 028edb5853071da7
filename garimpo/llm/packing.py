"""Conflict-constrained best-fit packing of documents into bins of a fixed number of words.

Documents are dealt to packing groups of bounded size by a hash, so one source or cluster
spreads over all groups; equal rows are counted first and then dealt one by one. A group places its pieces largest first. Its bins are ordered by
what is left in them, in a tree over that residual; each bin carries a bitmap of the sources
and one of the duplicate clusters it holds. The search takes the successor of a piece's size
in that order and goes on, passing over subtrees whose bins all hold the piece's source,
until it meets the tightest bin that holds neither its source nor its cluster; else a new bin
is opened.

A text longer than a bin is cut into full pieces and a rest; every word goes into exactly
one bin. Pieces of one document share its source, so they never share a bin.

Defined cases: a null or empty text has size 0 and goes into any compatible bin; a null
source conflicts with nothing; rows that repeat a doc_id are rows of their own (and conflict,
having equal texts); other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garimpo import runtime
from garimpo.llm import common
from garimpo.llm.mixing import words


class Bins:
    """Open bins, ordered by residual: a binary tree over 0..capacity."""

    def __init__(self, capacity: int) -> None:
        self.width = 1 << capacity.bit_length()
        self.shared = [-1] * (2 * self.width)  # sources that all bins below hold; -1: no bins
        self.leaves: dict[int, dict[int, list[int]]] = {}  # residual -> sources -> bins
        self.left: list[int] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def _renew(self, residual: int) -> None:
        held = -1
        for mask in self.leaves.get(residual, ()):
            held &= mask
        at = residual + self.width
        self.shared[at] = held
        while at > 1:
            at >>= 1
            held = self.shared[2 * at] & self.shared[2 * at + 1]
            if self.shared[at] == held:
                break
            self.shared[at] = held

    def _put(self, b: int) -> None:
        self.leaves.setdefault(self.left[b], {}).setdefault(self.sources[b], []).append(b)
        self._renew(self.left[b])

    def _take(self, b: int) -> None:
        same = self.leaves[self.left[b]]
        same[self.sources[b]].remove(b)
        if not same[self.sources[b]]:
            del same[self.sources[b]]
        self._renew(self.left[b])

    def _successor(self, size: int, source: int) -> int | None:
        """Least residual >= size of a bin without `source`."""
        shared, at = self.shared, size + self.width
        open_ = lambda n: shared[n] != -1 and not (shared[n] & source)
        if open_(at):
            return size
        while at > 1:
            if not at & 1 and open_(at + 1):
                at += 1
                break
            at >>= 1
        else:
            return None
        while at < self.width:
            at = 2 * at if open_(2 * at) else 2 * at + 1
        return at - self.width

    def place(self, size: int, source: int, cluster: int, capacity: int) -> tuple[int, int]:
        """Bin and offset for a piece; bit 0 stands for no source or no cluster."""
        residual = self._successor(size, source)
        while residual is not None:
            for mask, bins in self.leaves[residual].items():
                if mask & source:
                    continue
                for b in bins:
                    if not self.clusters[b] & cluster:
                        offset = capacity - self.left[b]
                        self._take(b)
                        self.left[b] -= size
                        self.sources[b] |= source
                        self.clusters[b] |= cluster
                        self._put(b)
                        return b, offset
            residual = self._successor(residual + 1, source) if residual < capacity else None
        b = len(self.left)
        self.left.append(capacity - size)
        self.sources.append(source)
        self.clusters.append(cluster)
        self._put(b)
        return b, 0


def _bits(values: pd.Series) -> list[int]:
    codes, _ = pd.factorize(values)  # null: -1
    return [0 if c < 0 else 1 << int(c) for c in codes]


def _each(rows: DataFrame, same: list[str], block: int = 1 << 12) -> DataFrame:
    """Every row as often as its `n` says, with a number `copy` from 0. Only what exceeds a block
    of copies is dealt anew, block by block, before it becomes rows."""
    few = rows.filter(F.col("n") <= block).withColumn("start", F.lit(0).cast("long"))
    many = rows.filter(F.col("n") > block).withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(block).cast("long"))))
    blocks = few.unionByName(many.repartition(*same, "start"))
    last = F.least(F.col("start") + block, F.col("n")) - 1
    return blocks.withColumn("copy", F.explode(F.sequence("start", last))).select(*same, "copy")


def pack(docs: DataFrame, size: Column, cluster: Column, capacity: int = 2048, per_group: int = 20_000) -> DataFrame:
    """One row per piece: doc_id, source, piece, size, pack_group, bin, bin_offset.

    `per_group` is the number of documents a packing group has on average; more groups, not
    larger ones, take more documents.
    """
    rows = docs.select(
        F.col("doc_id").cast("string").alias("doc_id"), F.col("source").cast("string").alias("source"),
        size.cast("long").alias("words"), cluster.alias("cluster"),
    )
    same = rows.columns
    rows = runtime.stage(rows.groupBy(*same).agg(F.count(F.lit(1)).alias("n")), "to_pack")
    groups = common.blocks_for(rows.agg(F.sum("n")).first()[0] or 0, per_group)
    rows = _each(rows, same).withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "cluster", "copy"), F.lit(groups))).drop("copy")

    def run(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.concat(list(batches), ignore_index=True)
        pieces = (held["words"].clip(lower=1) + capacity - 1) // capacity
        held = held.loc[held.index.repeat(pieces)].reset_index(drop=True)
        held["piece"] = held.groupby(["doc_id", "cluster", "source"], dropna=False, sort=False).cumcount()
        repeat = (held["words"].clip(lower=1) + capacity - 1) // capacity
        held["piece"] = held["piece"] % repeat
        held["size"] = (held["words"] - held["piece"] * capacity).clip(upper=capacity)
        held = held.sort_values(["size", "doc_id", "piece", "cluster", "source"], ascending=[False, True, True, True, True], kind="stable").reset_index(drop=True)
        # only a cluster with several pieces here can conflict
        several = held["cluster"].where(held.duplicated("cluster", keep=False))
        bins = Bins(capacity)
        placed = [
            bins.place(int(n), s, c, capacity)
            for n, s, c in zip(held["size"].tolist(), _bits(held["source"]), _bits(several), strict=True)
        ]
        held["bin"] = [b for b, _ in placed]
        held["bin_offset"] = [o for _, o in placed]
        yield held[["doc_id", "source", "piece", "size", "pack_group", "bin", "bin_offset", "cluster"]]

    kind = "doc_id string, source string, piece long, size long, pack_group long, bin long, bin_offset long, cluster string"
    # numbers travel as text: with a null among them pandas would make doubles of them
    return rows.groupBy("pack_group").applyInPandas(run, kind).withColumn("doc_id", F.col("doc_id").cast("long"))


def packed_documents(docs: DataFrame, **options: int) -> DataFrame:
    """The query's rows; documents with equal texts are one duplicate cluster."""
    found = pack(docs, words(F.col("text")), F.coalesce(F.md5("text"), F.md5(F.lit(""))), **options)
    return found.withColumn("bin_id", F.concat_ws("-", "pack_group", "bin"))
