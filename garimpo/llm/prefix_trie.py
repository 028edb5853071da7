"""Prefix trie of conversations, its subtree totals found by time-forward processing.

1. Order. Turns are sorted by conversation and turn over ranges; a turn's number is its place in
   the sorted range, plus what the ranges before hold of a conversation that goes on there.
2. Names. A prefix is named by two 64-bit values: the exclusive or of hashes of (place, turn)
   over its turns, running within blocks of `block` turns, so that a long conversation is no
   single task. A name must stand for one place, one shorter prefix and one last turn (by a
   third hash); else all are named anew under another seed.
3. Nodes are an aggregation of the names, and find their parent by its name.
4. Totals. A node sends the totals of its subtree to its parent. Nodes are sorted by reverse
   level order, so all messages to a node are sent before its turn comes: they wait in a
   priority queue that keeps at most `in_memory` of them and spills the others as sorted runs.
   Below the crowded nodes (more than `crowd` members, or a 4096th of all conversations) each
   subtree is of one shard, and a task takes its shards one after the other; what shard roots
   send is added up by their parents, and the crowded nodes, at most 4096 a level, are
   processed in the same way. An unshared tail, whose nodes have one member, takes part as its
   top node alone: all its nodes have that one leaf and save nothing.
5. The ids of the conversations that end in a node are hashed in order. Spark joins them to
   strings of 4096 ids; SHA-256 itself takes the strings one after the other.

Spill files are written where Spark spills, without a name, and nothing but their task reads them.

Defined cases: rows without conv_id belong to no conversation; a null role or text is empty; a
null turn comes first; turns of one number are taken in the order of the SHA-256 of role and
text, equal rows one after the other; a conversation of a negative id takes its head from
conv_id - conv_id % 100 with the sign of conv_id, as SQL counts; other columns, whatever their
names, are ignored; an empty table has no nodes, not even the root.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import struct
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from garimpo import runtime

HEADS = 5
_SHARED = "conv_id long, depth long, n_children long, n_leaves long, saved_tokens long"
_EMPTY = hashlib.sha256(b"").hexdigest()
Key = tuple[int, ...]


class SpillingQueue:
    """Least keys first; beyond `in_memory` entries the whole heap becomes a sorted run on disk.

    An entry is a tuple of integers, the first `size` of which are its key.
    """

    def __init__(self, in_memory: int, width: int, size: int) -> None:
        self.in_memory, self.size = in_memory, size
        self.record = struct.Struct(f"<{width}q")
        self.heap: list[Key] = []
        self.runs: list[tuple[Key, int, Iterator[Key]]] = []  # heads of runs, a heap itself
        self.spilled = 0

    def _read(self, file) -> Iterator[Key]:
        with file:
            file.seek(0)
            while block := file.read(self.record.size * 1024):
                yield from self.record.iter_unpack(block)

    def push(self, entry: Key) -> None:
        heapq.heappush(self.heap, entry)
        if len(self.heap) > self.in_memory:
            folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
            file = tempfile.TemporaryFile(dir=folder)  # noqa: SIM115  closed by its reader
            for e in sorted(self.heap):
                file.write(self.record.pack(*e))
            self.heap = []
            self.spilled += 1
            run = self._read(file)
            heapq.heappush(self.runs, (next(run), self.spilled, run))

    def pop_all(self, key: Key) -> Iterator[Key]:
        """Entries of `key`, which is the least there is, or of which there is none."""
        while self.heap and self.heap[0][: self.size] == key:
            yield heapq.heappop(self.heap)
        while self.runs and self.runs[0][0][: self.size] == key:
            entry, number, run = self.runs[0]
            yield entry
            following = next(run, None)
            if following is None:
                heapq.heappop(self.runs)
            else:
                heapq.heapreplace(self.runs, (following, number, run))


def time_forward(in_memory: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Totals of the subtrees of sorted nodes (shard, level from below, conv_id, depth, parent, own, and what they have got)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = SpillingQueue(in_memory, 6, 3)
        for batch in batches:
            out: list[tuple[int, ...]] = []
            for shard, depth, conv, parent, top, own, children, leaves, saved in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                saved += own
                for entry in queue.pop_all((shard, -depth, conv)):
                    children, leaves, saved = children + entry[3], leaves + entry[4], saved + entry[5]
                leaves = leaves or 1
                if not top:
                    queue.push((shard, 1 - depth, parent, 1, leaves, saved))
                out.append((conv, depth, children, leaves, saved))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["conv_id", "depth", "n_children", "n_leaves", "saved_tokens"])

    return run


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv, pos, digest, chars): the turns of each conversation, numbered from 0, stored."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv"), "turn", F.length(text).cast("long").alias("chars"),
        F.unhex(F.sha2(F.concat_ws(":", F.length(role).cast("string"), role, text), 256)).alias("digest"),
    ).filter("conv IS NOT NULL").withColumn("tie", F.monotonically_increasing_id())
    by = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("tie")]
    sorted_ = turns.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("place", F.monotonically_increasing_id())
    stored = runtime.stage(sorted_.select("conv", "place", "digest", "chars"), "turns")
    part = F.shiftright("place", 33)
    # one row a range and conversation; only ranges that begin within a conversation need more
    begins = stored.groupBy(part.alias("part"), "conv").agg(F.min("place").alias("begin"), F.count(F.lit(1)).alias("n"))
    begins = runtime.stage(begins, "begins")
    edge = begins.groupBy("part").agg(F.min("conv").alias("first"), F.max("conv").alias("last"))
    cut = edge.select(F.explode(F.array("first", "last")).alias("conv")).groupBy("conv").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("conv")
    several = begins.join(cut, "conv", "left_semi")
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    several = several.select(F.col("part").alias("part_"), F.col("conv").alias("conv_"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    starts = begins.join(several, (F.col("part") == F.col("part_")) & (F.col("conv") == F.col("conv_")), "left")
    starts = starts.select("part", "conv", (F.col("begin") - F.coalesce("earlier", F.lit(0))).alias("zero"))
    numbered = stored.withColumn("part", part).join(starts, ["part", "conv"])
    return runtime.stage(numbered.select("conv", (F.col("place") - F.col("zero")).alias("pos"), "digest", "chars"), "numbered")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All conversations (conv, total), and their turns (conv, depth, digest, chars, last) after each
    took the head of its hundred."""
    turns = ordered_turns(conversations)
    heads = turns.filter((F.col("conv") % 100 == 0) & (F.col("pos") < HEADS)).groupBy("conv").agg(
        F.sort_array(F.collect_list(F.struct("pos", "digest", "chars"))).alias("head")
    ).withColumnRenamed("conv", "base")
    own = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % (HEADS + 1)
    known = own.withColumn("h", h).withColumn("base_", F.col("conv") - F.col("conv") % 100).join(heads, F.col("base_") == F.col("base"), "left")
    head = F.slice(F.coalesce("head", F.array().cast("array<struct<pos:bigint,digest:binary,chars:bigint>>")), F.lit(1), F.col("h").cast("int"))
    known = known.select("conv", "n", "h", head.alias("head")).withColumn("taken", F.size("head"))
    known = runtime.stage(known.withColumn("total", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "known")
    first = known.select("conv", "total", F.explode("head").alias("t")).select(
        "conv", (F.col("t.pos") + 1).alias("depth"), "t.digest", "t.chars", "total"
    )
    rest = turns.join(known.select("conv", "h", "taken", "total"), "conv").filter("pos >= h").select(
        "conv", (F.col("taken") + F.col("pos") - F.col("h") + 1).alias("depth"), "digest", "chars", "total"
    )
    all_ = first.unionAll(rest).withColumn("last", F.col("depth") == F.col("total")).drop("total")
    return known.select("conv", "total"), all_


def named_prefixes(turns: DataFrame, seed: int, block: int) -> DataFrame:
    """Turns with the names (a, b) of the prefixes that end in them, (pa, pb) of the ones before, and a check, stored."""
    hashed = turns.select(
        "conv", "depth", "chars", "last", F.floor(F.col("depth") / block).alias("block"),
        *[F.xxhash64(F.lit(3 * seed + i), "depth", "digest").alias(f"h{i}") for i in range(3)],
    )
    running = Window.partitionBy("conv", "block").orderBy("depth")
    inner = hashed.select("*", F.bit_xor("h0").over(running).alias("x0"), F.bit_xor("h1").over(running).alias("x1"))
    sums = hashed.groupBy("conv", "block").agg(F.bit_xor("h0").alias("s0"), F.bit_xor("h1").alias("s1"))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # a conversation shorter than a block has only the first one
    long = hashed.filter(F.col("block") > 0).select("conv").distinct()
    ahead = sums.join(long, "conv", "left_semi").select("conv", "block", F.bit_xor("s0").over(before).alias("o0"), F.bit_xor("s1").over(before).alias("o1"))
    both = inner.join(ahead, ["conv", "block"], "left")
    a = F.col("x0").bitwiseXOR(F.coalesce("o0", F.lit(0).cast("long")))
    b = F.col("x1").bitwiseXOR(F.coalesce("o1", F.lit(0).cast("long")))
    both = both.select("conv", "depth", "chars", "last", "h0", "h1", "h2", a.alias("a"), b.alias("b"))
    return runtime.stage(both.select(
        "conv", "depth", "chars", "last", "a", "b", F.col("a").bitwiseXOR(F.col("h0")).alias("pa"), F.col("b").bitwiseXOR(F.col("h1")).alias("pb"), F.col("h2").alias("check"),
    ), "prefixes")


def _nodes(prefixes: DataFrame) -> DataFrame | None:
    """One row a name; None if a name stands for two prefixes."""
    same = ["depth", "pa", "pb", "check", "chars"]
    nodes = runtime.stage(prefixes.groupBy("a", "b").agg(
        F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.count_if("last").alias("n_ends"),
        *[F.min(c).alias(c) for c in same], *[F.max(c).alias(f"{c}_") for c in same],
    ), "nodes")
    differs = F.lit(False)
    for c in same:
        differs = differs | (F.col(c) != F.col(f"{c}_"))
    clash = nodes.filter(differs | ((F.col("a") == 0) & (F.col("b") == 0)))
    return nodes.drop(*[f"{c}_" for c in same]) if clash.isEmpty() else None


def _ends(prefixes: DataFrame, convs: DataFrame, per_string: int = 4096) -> DataFrame:
    """(a, b, ends_sha256) of the nodes in which conversations end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            done: list[tuple[int, int, str]] = []
            for a, b, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True):
                if node == (a, b):
                    digest.update(b",")
                else:
                    if node is not None:
                        done.append((*node, digest.hexdigest()))
                    node, digest = (a, b), hashlib.sha256()
                digest.update(ids.as_buffer())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["a", "b", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, digest.hexdigest())], names=["a", "b", "ends_sha256"])

    zero = F.lit(0).cast("long")
    ends = prefixes.filter("last").select("a", "b", "conv").unionAll(convs.filter("total = 0").select(zero.alias("a"), zero.alias("b"), "conv"))
    # floor division, so that strings are in the order of their ids, negative ones included
    strings = ends.groupBy("a", "b", F.floor(F.col("conv") / F.lit(float(per_string))).alias("string")).agg(F.sort_array(F.collect_list("conv")).alias("ids"))
    strings = strings.select("a", "b", "string", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))
    return strings.repartition("a", "b").sortWithinPartitions("a", "b", "string").mapInArrow(run, "a long, b long, ends_sha256 string")


def _totals(nodes: DataFrame, prefixes: DataFrame, crowd: int, in_memory: int) -> DataFrame:
    """(conv_id, depth, n_children, n_leaves, saved_tokens) of all nodes (with parent_conv_id, parent_n)."""
    crowded = (F.col("n_convs") > crowd) | (F.col("depth") == 0)
    tail = ~crowded & (F.col("n_convs") == 1) & (F.col("parent_n") == 1)
    # the shard of a conversation is the first node of its path that is not crowded
    heavy = nodes.filter(crowded & (F.col("depth") > 0)).select("a", "b")
    reach = prefixes.join(heavy, ["a", "b"], "left_semi").groupBy("conv").agg(F.max("depth").alias("reach"))
    roots = prefixes.select("conv", "depth", "a", "b").join(reach, "conv", "left").filter(F.col("depth") == F.coalesce("reach", F.lit(0)) + 1)
    roots = roots.select(F.col("conv").alias("conv_id"), F.col("a").alias("ra"), F.col("b").alias("rb"))
    own = (F.col("n_convs") - 1) * F.col("chars")
    zero = F.lit(0).cast("long")
    light = nodes.filter(~crowded & ~tail).join(roots, "conv_id").select(
        F.xxhash64("ra", "rb").alias("shard"), "depth", "conv_id", "parent_conv_id",
        ((F.col("a") == F.col("ra")) & (F.col("b") == F.col("rb"))).alias("top"), own.alias("own"),
        # a tail stands for its nodes: its top has the next one as its child, if it goes on
        F.when((F.col("n_convs") == 1) & (F.col("n_ends") == 0), 1).otherwise(0).cast("long").alias("children"), zero.alias("leaves"), zero.alias("saved"),
    )
    columns = ["shard", "depth", "conv_id", "parent_conv_id", "top", "own", "children", "leaves", "saved"]
    order = ["shard", F.desc("depth"), "conv_id"]
    below = light.repartition("shard").sortWithinPartitions(*order).select(columns).mapInArrow(time_forward(in_memory), _SHARED)
    below = runtime.stage(below, "totals")
    tops = light.filter("top").select("conv_id", "depth", "parent_conv_id")
    sent = below.join(tops, ["conv_id", "depth"]).groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(
        F.count(F.lit(1)).alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")
    )
    got = nodes.filter(crowded).join(sent, ["conv_id", "depth"], "left").select(
        zero.alias("shard"), "depth", "conv_id", "parent_conv_id", (F.col("depth") == 0).alias("top"), own.alias("own"),
        *[F.coalesce(c, zero).alias(c) for c in ("children", "leaves", "saved")],
    )
    above = got.coalesce(1).sortWithinPartitions(*order).select(columns).mapInArrow(time_forward(in_memory), _SHARED)
    tails = nodes.filter(tail).select("conv_id", "depth", (1 - F.col("n_ends")).alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), zero.alias("saved_tokens"))
    return below.unionAll(above).unionAll(tails)


def prefix_trie(conversations: DataFrame, crowd: int = 256, block: int = 1024, in_memory: int = 100_000, attempts: int = 4) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    convs, turns = rebuilt(conversations)
    zero = F.lit(0).cast("long")
    for seed in range(attempts):
        prefixes = named_prefixes(turns, seed, block)
        nodes = _nodes(prefixes)
        if nodes is not None:
            break
    else:
        raise RuntimeError("prefix names clash under every seed")
    n = convs.count()
    root = convs.agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.count_if(F.col("total") == 0).alias("n_ends")).filter("n_convs > 0")
    root = root.select(*[_root_column(c, zero).alias(c) for c in nodes.columns])
    nodes = nodes.unionAll(root)
    parents = nodes.select(F.col("a").alias("qa"), F.col("b").alias("qb"), F.col("conv_id").alias("parent_conv_id"), F.col("n_convs").alias("parent_n"))
    inner = nodes.filter("depth > 0").join(parents, (F.col("pa") == F.col("qa")) & (F.col("pb") == F.col("qb"))).drop("qa", "qb")
    none = F.lit(None).cast("long")
    nodes = runtime.stage(inner.unionAll(nodes.filter("depth = 0").withColumn("parent_conv_id", none).withColumn("parent_n", none)), "tree")
    totals = _totals(nodes, prefixes, max(crowd, n // 4096), in_memory)
    ends = _ends(prefixes, convs)
    return nodes.join(totals, ["conv_id", "depth"]).join(ends, ["a", "b"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"),
    )


def _root_column(name: str, zero: Column) -> Column:
    return F.col(name) if name in ("conv_id", "n_convs", "n_ends") else zero


SQL = """
WITH turns AS (
  SELECT conv_id AS conv, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, ''))) - 1 AS pos,
         sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, '')) AS digest, length(coalesce(text, '')) AS chars
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv, conv - conv % 100 AS base,
         xor(list_reduce(list_transform(string_split(CAST(conv AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
           lambda crc, byte: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)), xor(crc, byte)),
           CAST(4294967295 AS BIGINT)), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv FROM turns)
), parts AS (
  SELECT c.conv, 0 AS part, t.pos, digest, chars FROM convs c JOIN turns t ON t.conv = c.base AND t.pos < h
  UNION ALL SELECT c.conv, 1, t.pos, digest, chars FROM convs c JOIN turns t ON t.conv = c.conv AND t.pos >= h
), paths AS (
  SELECT conv, row_number() OVER w AS depth, string_agg(digest, '') OVER w AS key, chars FROM parts WINDOW w AS (PARTITION BY conv ORDER BY part, pos)
  UNION ALL SELECT conv, 0, '', 0 FROM convs
), ending AS (
  SELECT *, depth = max(depth) OVER (PARTITION BY conv) AS ends FROM paths
), nodes AS (
  SELECT key, min(conv) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, any_value(chars) AS chars,
         sha256(coalesce(string_agg(CAST(conv AS VARCHAR), ',' ORDER BY conv) FILTER (ends), '')) AS ends_sha256
  FROM ending GROUP BY key
), linked AS (
  SELECT n.*, p.conv_id AS parent_conv_id, p.key AS parent_key FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.key = left(n.key, 64 * (n.depth - 1))
), children AS (
  SELECT parent_key AS key, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY ALL
), below AS (
  SELECT up.key, sum((n.n_convs - 1) * n.chars) AS saved_tokens, count_if(c.key IS NULL) AS n_leaves
  FROM linked n LEFT JOIN children c USING (key) JOIN paths up ON up.conv = n.conv_id AND up.depth <= n.depth
  GROUP BY up.key
)
SELECT conv_id, depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM linked JOIN below USING (key) LEFT JOIN children USING (key)
"""
