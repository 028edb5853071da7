"""Balanced label propagation: documents into shards, linked ones together, counts even.

The law is `rows`: shard sizes differ by one row at most. Documents with equal texts are
linked. Links go through their group, never as pairs: a round counts the members of each
group in each shard (one row per group and shard after the map-side half), names the shard
that holds most of them, and lets as many of the others move there as free places and moves
out of it admit: opposite moves of full shards are made in equal numbers. Where the shard is
full, the group may meet in a side with room instead. Documents without links fill what is left.

Defined cases: a null text has no bytes (size 8, checksum 0) and is linked with other null
texts only; rows that repeat a doc_id are rows of their own; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from garimpo import runtime
from garimpo.llm import common


def _by_shard(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def _counts(df: DataFrame, shards: int, column: str = "shard") -> list[int]:
    found = {r[0]: r[1] for r in df.groupBy(column).count().collect()}  # one row a shard
    return [found.get(s, 0) for s in range(shards)]


def circulation(wished: dict[tuple[int, int], int], free: list[int]) -> dict[tuple[int, int], int]:
    """How many of the moves wished from shard to shard can be made at once so that no quota is passed.

    Moves go around in cycles, the shortest first: exchanges of two shards, longer rounds, and
    chains that end in a free place, which is a cycle through one more node.
    """
    outside = len(free)
    room = {e: n for e, n in wished.items() if n > 0} | {(s, outside): n for s, n in enumerate(free) if n > 0}
    after: dict[int, set[int]] = {s: set() for s in range(outside)} | {outside: set(range(outside))}
    for a, b in room:
        after[a].add(b)
    made: dict[tuple[int, int], int] = {}

    def cycle(a: int, b: int, longest: int) -> list[tuple[int, int]] | None:
        came, level = {b: b}, [b]
        for _ in range(longest - 1):
            level = [y for x in level for y in sorted(after[x]) if y not in came and not came.update({y: x})]
            if a in came:
                path, x = [(a, b)], a
                while x != b:
                    path.append((came[x], x))
                    x = came[x]
                return path
        return None

    for longest in (2, 3, outside + 1):
        for a, b in sorted(wished):
            while room.get((a, b)) and (path := cycle(a, b, longest)):
                n = min(room[e] for e in path if e[0] != outside)
                for e in path:
                    if e[0] != outside:
                        room[e] -= n
                        if not room[e]:
                            after[e[0]].discard(e[1])
                        if e[1] != outside:
                            made[e] = made.get(e, 0) + n
    return made


def propagate(linked: DataFrame, quotas: list[int], rounds: int) -> DataFrame:
    """Move the rows of `linked` (group, doc_id, shard, ...) towards their groups' shards.

    Rounds of exchanges, where a group's rows go to the side that holds most of them, take
    turns with rounds where a group whose fullest side is full meets in a side with room.
    """
    spark, shards = linked.sparkSession, len(quotas)
    path = runtime.new_folder(spark, "shards")
    now = runtime.stage_at(linked, path)
    total = now.count()
    blocks = common.blocks_for(total)
    for turn in range(rounds):
        held = _counts(now, shards)
        free = [q - h for q, h in zip(quotas, held, strict=True)]
        exchange = turn % 2 == 0 or not any(free)
        votes = now.groupBy("group", "shard").agg(F.count(F.lit(1)).alias("n"))
        # sides less than two rows apart count as equal: another one wins in another round
        luck = F.pmod(F.xxhash64(F.lit(turn), "group", "shard"), F.lit(1 << 20)) / F.lit(float(1 << 19))
        rank = F.struct((F.col("n") + luck).alias("score"), "shard", "n")
        best = votes.groupBy("group").agg(
            F.max(rank).alias("top"),
            F.max(F.when(F.get(_by_shard(free), F.col("shard")) > 0, rank)).alias("open"),
            F.count(F.lit(1)).alias("sides"),
        ).filter("sides > 1")
        home, side = F.col("top.shard"), F.col("open.shard")
        want = home if exchange else F.when(F.get(_by_shard(free), home) > 0, home).otherwise(F.coalesce(side, home))
        moves = now.join(best.select("group", want.alias("want"), home.alias("home"), F.col("top.n").alias("home_n")), "group").filter("shard != want")
        if exchange:
            wished = {(r[0], r[1]): r[2] for r in moves.groupBy("shard", "want").count().collect()}  # one row a pair of shards
            if not wished:
                break
            made = circulation(wished, free)
            most = F.get(_by_shard([made.get((a, b), 0) for a in range(shards) for b in range(shards)]), F.col("shard") * shards + F.col("want"))
            by = ["shard", "want"]
        else:
            most = F.get(_by_shard(free), F.col("want"))
            moves = moves.filter((F.col("shard") != F.col("home")) | (F.col("home_n") <= most))
            by = ["want"]
        turns = common.numbered(
            moves.select("row", "group", "shard", "want", "home"), "turn", by, F.col("group"), [F.col("group"), F.col("row")], blocks
        )
        if not exchange:  # rows leave the fullest side together or not at all
            last = F.max("turn").over(Window.partitionBy("group", "shard"))
            turns = turns.withColumn("turn", F.when(F.col("shard") == F.col("home"), last).otherwise(F.col("turn")))
        admitted = turns.filter(F.col("turn") < most).select("row", "want")
        new_path = runtime.new_folder(spark, "shards")
        new = runtime.stage_at(
            now.join(admitted, "row", "left").withColumn("shard", F.coalesce("want", "shard")).drop("want"), new_path
        )
        runtime.drop_folder(spark, path)
        now, path = new, new_path
    return now


def balanced_shards(docs: DataFrame, shards: int = 24, rounds: int = 6) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    bytes_ = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    base = docs.select(
        "doc_id", (bytes_ + 8).alias("size"), F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.md5("text"), F.lit("null")).alias("group"),
    )
    # rows without links need no more than their number; the number also names a row
    groups = base.groupBy("group").agg(F.count(F.lit(1)).alias("members"))
    marked = base.join(groups, "group").withColumn("linked", F.col("members") > 1)
    spark = docs.sparkSession
    rows = runtime.stage(marked, "documents")
    counts = {r[0]: r[1] for r in rows.groupBy("linked").count().collect()}
    total = sum(counts.values())
    blocks = common.blocks_for(total)
    order = [F.col("doc_id"), F.col("group")]
    path = runtime.new_folder(spark, "numbered")
    named = runtime.stage_at(common.numbered(rows, "row", ["linked"], F.struct("doc_id", "group"), order, blocks), path)
    quotas = [total // shards + (s < total % shards) for s in range(shards)]
    linked = named.filter("linked").select("row", "doc_id", "size", "text_crc32", "group", (F.col("row") % shards).cast("int").alias("shard"))
    settled = propagate(linked, quotas, rounds) if counts.get(True) else linked
    left = [q - h for q, h in zip(quotas, _counts(settled, shards), strict=True)]
    ends = list(accumulate(left))
    place = sum((F.when(F.col("row") >= e, 1).otherwise(0) for e in ends), F.lit(0)).cast("int")
    single = named.filter(~F.col("linked")).select("doc_id", "size", "text_crc32", "group", place.alias("shard"))
    placed = runtime.stage(settled.select("doc_id", "size", "text_crc32", "group", "shard").unionAll(single), "placed")
    slots = common.numbered(placed, "slot", ["shard"], F.struct("doc_id", "group"), order, blocks)
    return slots.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
