"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that hold them). A flow
then routes words from patterns to source quotas; the r-th copy of a pattern's words costs
2r - 1, so the flow repeats everything evenly before it repeats anything often. Whole
copies go to all documents of a pattern; the rest of its words is taken by documents in a
seeded order, and the last gap is closed by the largest documents that fit it.

Sources and patterns are tables; the driver sees sums over all of them only. A source that
no pattern shares with another needs no flow: its quota goes to its one pattern, as whole
copies and a rest. Patterns that sources connect are solved by the flow, one task for each
connected set.

Rows that agree in doc_id, size, sources and `tell` are interchangeable: they are one weighted
row until the end, and the mix takes so many of them. So the order has no ties, and the
result depends neither on partitions nor on null or repeated doc_ids.

Defined cases: a null text has size 0; a null source is a source of its own, last in the
order; rows that repeat a doc_id are rows of their own, each taken or not by itself; other
columns, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from garimpo import runtime
from garimpo.llm import common

WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded(*columns: Column | str, seed: int = 42) -> Column:
    """What a pattern's rows are ordered by first: a hash of doc_id, size and what tells rows apart."""
    return F.xxhash64(F.lit(seed), *columns)


def targets(sizes: dict[str | None, int], most: float = 3.0, weights: tuple[float, ...] = (1, 2, 3)) -> dict[str | None, float]:
    """Words wanted of each source: shares by weight of all words, no source above `most` times
    its own size; what is cut off is shared anew by weight among the others."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, found, open_ = float(sum(sizes.values())), {}, set(names)
    while open_:
        left = total - sum(found.values())
        whole = sum(weight[s] for s in names if s in open_)
        over = [s for s in names if s in open_ and left * weight[s] / whole > most * sizes[s]]
        if not over:
            found |= {s: left * weight[s] / whole for s in names if s in open_}
            break
        for s in over:
            found[s] = most * sizes[s]
            open_.discard(s)
    return found


def route(patterns: list[tuple[frozenset, int]], quotas: dict[str | None, int], repeats: int) -> dict[tuple[int, str | None], int]:
    """Words each pattern gives to each of its sources: a maximum flow of least cost.

    Shortest augmenting paths with potentials; a pattern's r-th repetition costs 2r - 1.
    """
    sources = list(quotas)
    begin, end = 0, 1
    node_p = {i: 2 + i for i in range(len(patterns))}
    node_s = {s: 2 + len(patterns) + j for j, s in enumerate(sources)}
    graph: list[list[int]] = [[] for _ in range(2 + len(patterns) + len(sources))]
    to: list[int] = []
    room: list[int] = []
    cost: list[int] = []

    def edge(a: int, b: int, capacity: int, price: int) -> int:
        for x, y, c, p in ((a, b, capacity, price), (b, a, 0, -price)):
            graph[x].append(len(to))
            to.append(y)
            room.append(c)
            cost.append(p)
        return len(to) - 2

    given = {}
    for i, (members, size) in enumerate(patterns):
        for r in range(1, repeats + 1):
            edge(begin, node_p[i], size, 2 * r - 1)
        for s in sources:
            if s in members:
                given[i, s] = edge(node_p[i], node_s[s], size * repeats, 0)
    for s in sources:
        edge(node_s[s], end, quotas[s], 0)
    high = [0] * len(graph)
    while True:
        far = [float("inf")] * len(graph)
        far[begin] = 0
        via = [-1] * len(graph)
        queue: list[tuple[float, int]] = [(0, begin)]
        while queue:
            d, x = heapq.heappop(queue)
            if d > far[x]:
                continue
            for e in graph[x]:
                if room[e] and (n := d + cost[e] + high[x] - high[to[e]]) < far[to[e]]:
                    far[to[e]], via[to[e]] = n, e
                    heapq.heappush(queue, (n, to[e]))
        if via[end] < 0:
            break
        high = [h + (f if f < float("inf") else 0) for h, f in zip(high, far, strict=True)]
        path, x = [], end
        while x != begin:
            path.append(via[x])
            x = to[via[x] ^ 1]
        push = min(room[e] for e in path)
        for e in path:
            room[e] -= push
            room[e ^ 1] += push
    return {k: room[e ^ 1] for k, e in given.items()}


def _cumulated(groups: DataFrame, blocks: int, order: list[Column | str]) -> DataFrame:
    """Column `_before`: words of the rows ahead in a pattern's seeded order.

    Blocks are ranges of that order, which is a hash, so they are of like size. They are summed
    first; a window sees one block of one pattern.
    """
    high = F.shiftright("_order", 33) + F.lit(1 << 30)  # 0 to 2^31, in the order of `_order`
    groups = groups.withColumn("_block", F.shiftright(high * F.lit(blocks).cast("long"), 31)).withColumn("_all", F.col("size") * F.col("_n"))
    sums = groups.groupBy("_pattern", "_block").agg(F.sum("_all").alias("_sum"))
    ahead = Window.partitionBy("_pattern").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        F.col("_pattern").alias("_p"), F.col("_block").alias("_b"), F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_start")
    )
    inside = Window.partitionBy("_pattern", "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        groups.withColumn("_inside", F.coalesce(F.sum("_all").over(inside), F.lit(0)))
        .join(starts, (F.col("_pattern") == F.col("_p")) & (F.col("_block") == F.col("_b")))
        .withColumn("_before", F.col("_start") + F.col("_inside"))
        .drop("_p", "_b", "_start", "_inside", "_block", "_all")
    )


def source_targets(sources: DataFrame, total: int, most: int, weights: tuple[float, ...] = (1, 2, 3)) -> DataFrame:
    """`targets` of a table (source, size): (source, size, target, quota), stored.

    Sources are numbered over sorted ranges. All whose size by weight lies below a bound stop
    at `most` times their size; what they leave raises the bound, until no more stop.
    """
    ranged = sources.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    ranged = runtime.stage(ranged.withColumn("place", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("place", 33)
    counts = ranged.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = counts.select(
        F.col("part").alias("part_"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier")
    )  # one row a range
    number = F.col("earlier") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    weight = F.array(*[F.lit(float(w)) for w in weights])[(number % len(weights)).cast("int")]
    weighed = runtime.stage(ranged.join(before, part == F.col("part_")).select("source", "size", weight.alias("weight")), "weights")
    sums = weighed.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n")).first()
    whole, share, stopped = sums.weight or 0.0, 0.0, 0
    left, over = float(total), F.lit(False)
    while stopped < sums.n:
        share = left / whole
        over = F.lit(share) * F.col("weight") > F.col("size") * F.lit(most)
        full = weighed.filter(over).agg(F.sum("size").alias("size"), F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n")).first()
        if full.n == stopped:
            break
        stopped, left, whole = full.n, float(total) - float(most * full.size), sums.weight - full.weight
    target = F.when(over, (F.col("size") * most).cast("double")).otherwise(F.lit(share) * F.col("weight"))
    return weighed.select("source", "size", target.alias("target"))


def _given(patterns: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """(_pattern, words): what each pattern gives, stored. `patterns`: (_pattern, members, size)."""
    held = patterns.select("_pattern", "size", F.size("members").alias("k"), F.explode("members").alias("source_"))
    same = F.col("source_").eqNullSafe(F.col("source"))
    quota = F.bround("target").cast("long")
    linked = held.join(sources.select("source", quota.alias("quota"), F.monotonically_increasing_id().alias("sid")), same).drop("source_")
    linked = runtime.stage(linked, "held")
    shared = linked.filter("k > 1").select("sid").distinct()
    if shared.isEmpty():
        return linked.select("_pattern", F.least("quota", F.col("size") * most).alias("words"))
    tied = runtime.stage(linked.join(shared, "sid", "left_semi"), "tied")
    edges = tied.select((F.col("_pattern") * 2).alias("a"), (F.col("sid") * 2 + 1).alias("b"))
    parts = common.components(edges)
    flows = tied.join(parts, F.col("_pattern") * 2 == F.col("node")).select("root", "_pattern", "size", "sid", "quota")

    def solve(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("_pattern", "size", "sid", "quota")), strict=True))
        members: dict[int, set] = {}
        sizes, quotas = {}, {}
        for p, size, s, quota in rows:
            members.setdefault(p, set()).add(s)
            sizes[p], quotas[s] = size, quota
        names = list(members)
        found = route([(frozenset(members[p]), sizes[p]) for p in names], quotas, most)
        words_ = [sum(found.get((i, s), 0) for s in members[p]) for i, p in enumerate(names)]
        return pa.table({"_pattern": pa.array(names, pa.int64()), "words": pa.array(words_, pa.int64())})

    alone = linked.join(shared, "sid", "left_anti").filter("k = 1").select("_pattern", F.least("quota", F.col("size") * most).alias("words"))
    return runtime.stage(alone.unionAll(flows.groupBy("root").applyInArrow(solve, "_pattern long, words long")), "given")


def mix(
    docs: DataFrame, members: Column, size: Column, most: int = 3, seed: int = 42, gap_rounds: int = 3, tell: tuple[str, ...] = (), per_block: int = 4096,
) -> DataFrame:
    """One row per document: doc_id, size, members, targets, source_sizes, taken (words, repeats counted), copies, seeded.

    `seeded` comes first in the seeded order of a pattern, then doc_id, size and `tell`.
    `members` is an array of sources (nulls stand for the null source); `most` bounds both a
    document's copies and a source's target. `gap_rounds` is how many kinds of documents of a
    pattern may close the gap that the seeded order leaves. Columns `tell` together tell rows
    apart that share a doc_id or have none, and are returned as well.
    """
    key = F.array_sort(F.array_distinct(members), lambda a, b: F.when(a.isNull() & b.isNull(), 0).when(a.isNull(), 1).when(b.isNull(), -1).when(a < b, -1).when(a > b, 1).otherwise(0))
    rows = docs.select("doc_id", size.alias("size"), key.alias("members"), *tell)
    same = ["doc_id", "size", *tell]
    groups = runtime.stage(rows.groupBy("members", *same).agg(F.count(F.lit(1)).alias("_n")), "sizes")
    patterns = groups.groupBy("members").agg(F.sum(F.col("size") * F.col("_n")).alias("size"), F.sum("_n").alias("rows"))
    patterns = runtime.stage(patterns.withColumn("_pattern", F.monotonically_increasing_id()), "patterns")
    sizes = patterns.select(F.explode("members").alias("source"), "size").groupBy("source").agg(F.sum("size").alias("size"))
    whole = patterns.agg(F.sum("size").alias("words"), F.sum("rows").alias("rows"), F.sum(F.col("size") * F.size("members")).alias("held")).first()
    wanted = source_targets(sizes, whole.held or 0, most)
    # words that several sources hold count once in what is shared out
    scale = min(1.0, (whole.words or 0) / max(1, whole.held or 0))
    wanted = runtime.stage(wanted.withColumn("target", F.col("target") * F.lit(scale)), "targets")
    given = _given(patterns, wanted, most)
    shares = patterns.select("_pattern", F.posexplode("members").alias("at", "source_")).join(wanted, F.col("source_").eqNullSafe(F.col("source")))
    shares = shares.groupBy("_pattern").agg(F.sort_array(F.collect_list(F.struct("at", "target", "size"))).alias("of"))
    n = F.col("size")
    plan = patterns.join(given, "_pattern", "left").join(shares, "_pattern", "left").select(  # some rows have no source
        "_pattern", F.col("members").alias("_members"), F.col("of.target").alias("targets"), F.col("of.size").alias("source_sizes"),
        *[F.coalesce(F.when(n > 0, x), F.lit(0)).cast("long").alias(name) for name, x in (("_copies", F.floor(F.col("words") / n)), ("_rest", F.col("words") % n))],
    )
    groups = groups.join(runtime.stage(plan, "plan"), F.col("members").eqNullSafe(F.col("_members"))).drop("_members")
    groups = groups.withColumn("_order", seeded(*same, seed=seed))
    order = ["_order", *same]
    # how many of equal rows the rest takes
    fit = F.when(F.col("size") > 0, F.greatest(F.lit(0), F.least(F.col("_n"), F.floor((F.col("_rest") - F.col("_before")) / F.col("size"))))).otherwise(0)
    groups = runtime.stage(_cumulated(groups, common.blocks_for(whole.rows or 0), order).withColumn("_extra", fit.cast("long")).drop("_before"), "mixed")
    for _ in range(gap_rounds):
        gap = groups.groupBy("_pattern").agg((F.first("_rest") - F.sum(F.col("_extra") * F.col("size"))).alias("_gap"))
        gap = runtime.stage(gap, "gap")  # of known size, so that the rows are not dealt by pattern to join it
        fits = (
            groups.filter((F.col("_extra") < F.col("_n")) & (F.col("size") > 0)).join(gap, "_pattern").filter(F.col("size") <= F.col("_gap"))
            .groupBy("_pattern").agg(F.max(F.struct("size", "_order", *[c for c in same if c != "size"], (F.col("_n") - F.col("_extra")).alias("_free"), "_gap")).alias("_fit"))
        )
        more = F.least(F.col("_fit._free"), F.floor(F.col("_fit._gap") / F.col("_fit.size")))
        pick = runtime.stage(fits.select(F.col("_pattern").alias("_p"), *[F.col(f"_fit.{c}").alias(f"_fit_{c}") for c in same], more.alias("_more")), "picks")
        if pick.isEmpty():
            break
        chosen = F.col("_pattern") == F.col("_p")
        for c in same:
            chosen = chosen & F.col(c).eqNullSafe(F.col(f"_fit_{c}"))
        groups = groups.join(pick, chosen, "left").withColumn("_extra", F.col("_extra") + F.coalesce("_more", F.lit(0))).drop(*pick.columns)
    # one row for each of the equal ones, the first `_extra` with one copy more; very many are dealt out in blocks
    blocks = groups.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(per_block).cast("long"))))
    if not groups.filter(F.col("_n") > per_block).isEmpty():
        blocks = blocks.repartition("_pattern", *same, "_from")
    each = blocks.withColumn("_i", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + per_block, F.col("_n")) - 1)))
    copies = F.col("_copies") + (F.col("_i") < F.col("_extra")).cast("int")
    return each.select(
        "doc_id", "size", "members", "targets", "source_sizes", (F.col("size") * copies).alias("taken"), copies.cast("int").alias("copies"),
        F.col("_order").alias("seeded"), *tell
    )


def mixed_documents(docs: DataFrame, **options: int) -> DataFrame:
    """The query's rows: each document belongs to the one source its row names."""
    found = mix(docs, F.array(F.col("source").cast("string")), words(F.col("text")), **options)
    return found.select(
        "doc_id", "size", F.col("source_sizes")[0].alias("source_size"), F.col("targets")[0].alias("target"), "taken", "copies",
        F.col("members")[0].alias("source"),
    )
