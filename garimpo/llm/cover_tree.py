"""Embedding near-duplicates: exact threshold pairs by dual traversal of cover trees.

Vectors of one label are compared as unit vectors by chord length; cosine >= c means a chord
of at most sqrt(2 - 2c). The tree has two parts. Its upper levels are tables: a node with
more than `leaf_rows` vectors is covered by centres drawn from it (no two closer than the
level's radius, which halves from level to level), each vector goes to its nearest centre,
and a node keeps its true covering radius. A traversal of pairs of nodes, level by level, is
a join; a pair goes on only if its centres are no farther apart than both radii and the
threshold allow. Below, each leaf is a nested cover tree in one task, and two leaves that may
hold a pair are traversed together there: node pairs are pruned by the same bound, and the
last pairs are judged by their cosine in double precision.

A dense leaf (all within the least radius) is cut by a hash into leaves that all meet: that
work is the number of its pairs, but no row is made for a pair.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite components,
and those without a label, link with nothing, nor do vectors of unequal lengths; equal vectors
link with each other; rows that repeat a vec_id are rows of their own; a null vec_id takes part but
names no component, so without any other it gets null; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garimpo import runtime
from garimpo.llm import common, pairing

SLACK = 1e-6  # bounds give this much away, so rounding never prunes a pair


class Tree:
    """Nested levels over the rows of `x`: centre, covering radius, parent and members."""

    def __init__(self, x: np.ndarray, radius: float = 1.0, least: float = 0.06) -> None:
        self.x = x
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # centres, radii, parents
        owner = np.zeros(len(x), np.int64)  # node of each row on the level at hand
        centres = np.zeros(1, np.int64)
        self._add(centres, np.zeros(1, np.int64), owner)
        while radius >= least and len(centres) < len(x):
            centres, parents, owner = self._cover(centres, owner, radius)
            self._add(centres, parents, owner)
            radius /= 2
        if len(centres) < len(x):
            # nodes of a level stay in the order of their parents, so that a <= b holds for children too
            order = np.argsort(owner, kind="stable")
            place = np.empty_like(order)
            place[order] = np.arange(len(x))
            self._add(order, owner[order], place)

    def _add(self, centres: np.ndarray, parents: np.ndarray, owner: np.ndarray) -> None:
        far = np.zeros(len(centres))
        np.maximum.at(far, owner, _chord(self.x, self.x[centres[owner]]))
        self.levels.append((centres, far, parents))

    def _cover(self, centres: np.ndarray, owner: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Children of every node: its centre first, then whatever no child covers yet."""
        found, parents, new = [], [], np.full(len(self.x), -1)
        order = np.argsort(owner, kind="stable")
        borders = np.searchsorted(owner[order], np.arange(len(centres) + 1))
        for node, centre in enumerate(centres.tolist()):
            left = order[borders[node] : borders[node + 1]]
            pick = centre
            while len(left):
                near = 2 - 2 * (self.x[left] @ self.x[pick]) <= radius * radius
                near |= left == pick
                new[left[near]] = len(found)
                found.append(pick)
                parents.append(node)
                left = left[~near]
                pick = int(left[0]) if len(left) else -1
        return np.array(found), np.array(parents), new

    def children(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Children of each node of a level: borders into the (sorted) next level."""
        parents = self.levels[level + 1][2]
        order = np.argsort(parents, kind="stable")
        return np.searchsorted(parents[order], np.arange(len(self.levels[level][0]) + 1)), order


def _chord(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a - b) ** 2).sum(axis=1))


def _expanded(nodes: np.ndarray, tree: Tree, level: int) -> tuple[np.ndarray, np.ndarray]:
    """For each entry of `nodes`: its children on the next level, and the entry they come from."""
    borders, order = tree.children(level)
    counts = borders[nodes + 1] - borders[nodes]
    source = np.repeat(np.arange(len(nodes)), counts)
    inside = np.arange(len(source)) - np.repeat(np.cumsum(counts) - counts, counts)
    return order[borders[nodes][source] + inside], source


def dual(one: Tree, two: Tree, chord: float, part: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that the bounds leave, in parts; with `one is two`, each once."""
    stack = [(0, 0, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        la, lb, a, b = stack.pop()
        if len(a) > part:
            half = len(a) // 2
            stack += [(la, lb, a[:half], b[:half]), (la, lb, a[half:], b[half:])]
            continue
        ca, ra, _ = one.levels[la]
        cb, rb, _ = two.levels[lb]
        if len(a) >= len(ca) * len(cb) and len(ca) * len(cb) > 1:  # all meet all: one product
            gap = np.sqrt(np.maximum(0, 2 - 2 * (one.x[ca] @ two.x[cb].T)))[a, b]
        else:
            gap = np.concatenate([_chord(one.x[ca[a[i : i + 8192]]], two.x[cb[b[i : i + 8192]]]) for i in range(0, len(a), 8192)])
        near = gap <= ra[a] + rb[b] + chord + SLACK
        if one is two and la == lb:
            near &= a <= b
        a, b = a[near], b[near]
        if not len(a):
            continue
        enda, endb = la + 1 == len(one.levels), lb + 1 == len(two.levels)
        if enda and endb:
            yield ca[a], cb[b]
            continue
        # the children of both, in parts small enough to hold
        for i in range(0, len(a), 4096):
            x, y = a[i : i + 4096], b[i : i + 4096]
            na, nb = la, lb
            if not enda:
                x, source = _expanded(x, one, la)
                y, na = y[source], la + 1
            if not endb:
                y, source = _expanded(y, two, lb)
                x, nb = x[source], lb + 1
            stack.append((na, nb, x, y))


def _vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = pa.chunked_array([column]) if isinstance(column, pa.Array) else column
    values = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in flat.chunks])
    return values.reshape(len(column), -1)


def _assigned(rows: DataFrame) -> DataFrame:
    """Each row of (node, rep, unit, centres) with its nearest centre's number and distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, node = _vectors(batch.column(2)), batch.column(0).to_numpy()
            best, far = np.zeros(len(x), np.int64), np.zeros(len(x))
            for n in np.unique(node):
                at = np.flatnonzero(node == n)
                centres = np.array(batch.column(3)[int(at[0])].as_py())
                product = x[at] @ centres.T
                best[at] = product.argmax(axis=1)
                far[at] = _chord(x[at], centres[best[at]])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(best), pa.array(far)], names=["node", "rep", "best", "far"])

    return rows.select("node", "rep", "unit", "centres").mapInArrow(run, "node long, rep long, best long, far double")


def _separated(candidates: DataFrame, radius: float, fan: int) -> DataFrame:
    """(node, centres): of each node's candidates, those no two of which are closer than `radius`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for row in batch.column(1):
                x = np.array([c["unit"] for c in row.as_py()])  # `fan` on average, drawn by a hash
                found = [0]
                for i in range(1, len(x)):
                    if len(found) < fan and (2 - 2 * (x[found] @ x[i]) > radius * radius).all():
                        found.append(i)
                kept.append(x[found].tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.list_(pa.list_(pa.float64())))], names=["node", "centres"])

    lists = candidates.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("lot", "rep", "unit"))).alias("all"))
    return lists.mapInArrow(run, "node long, centres array<array<double>>")


def leaves(vectors: DataFrame, leaf_rows: int, fan: int, depth: int) -> tuple[DataFrame, list[DataFrame]]:
    """Upper levels of the trees of (tree, rep, unit): rows with their leaf, and the tables of nodes.

    Node tables: (node, parent, tree, centre, radius).
    """
    spark = vectors.sparkSession
    rows = runtime.stage(vectors.withColumn("node", F.col("tree")), "level")
    top = rows.groupBy("tree").agg(F.count(F.lit(1)).alias("n"), F.min_by("unit", "rep").alias("centre"))
    # every chord is at most 2
    levels = [runtime.stage(top.select(F.col("tree").alias("node"), F.lit(None).cast("long").alias("parent"), "tree", "centre", F.lit(2.0).alias("radius"), "n"), "nodes")]
    radius = 1.0
    for _ in range(depth):
        wide = levels[-1].filter(F.col("n") > leaf_rows).select("node", "n")
        if wide.isEmpty():
            break
        lot = F.xxhash64(F.lit(len(levels)), "rep")
        at = rows.join(wide, "node").withColumn("lot", F.pmod(lot, F.lit(1 << 40)))
        wanted = F.least(F.lit(fan), F.ceil(2 * F.col("n") / leaf_rows))  # no more children than it takes
        drawn = at.filter(F.col("lot") < wanted * float(1 << 40) / F.col("n")).select("node", "lot", "rep", "unit")
        centres = runtime.stage(_separated(drawn, radius, fan), "centres")
        near = runtime.stage(_assigned(at.join(centres, "node")), "assigned")
        child = F.xxhash64(F.lit(len(levels)), "node", "best")
        nodes = near.groupBy("node", "best").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"))
        nodes = nodes.join(centres, "node").select(child.alias("node_"), F.col("node").alias("parent"), F.get("centres", F.col("best").cast("int")).alias("centre"), "radius", "n").withColumnRenamed("node_", "node")
        narrow = levels[-1].join(nodes.select(F.col("parent").alias("node")).distinct(), "node", "left_anti")
        kept = narrow.select("node", F.col("node").alias("parent"), "tree", "centre", "radius", "n")
        trees = levels[-1].select(F.col("node").alias("parent"), "tree")
        split = nodes.join(trees, "parent").select("node", "parent", "tree", "centre", "radius", "n")
        levels.append(runtime.stage(split.unionAll(kept), "nodes"))
        rows = runtime.stage(
            rows.join(near.select(F.col("rep"), child.alias("child")), "rep", "left")
            .withColumn("node", F.coalesce("child", "node")).drop("child"), "level"
        )
        radius /= 2
    return rows, levels


def node_pairs(levels: list[DataFrame], chord: float) -> DataFrame:
    """(a, b, tree): pairs of leaves, a <= b, that the bounds of every level leave."""
    distance = F.sqrt(F.aggregate(F.zip_with("ca", "cb", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))
    pairs = levels[0].select(F.col("node").alias("a"), F.col("node").alias("b"), "tree")
    for level in levels[1:]:
        kids = [level.select(F.col("parent").alias(p), F.col("node").alias(f"n{p}"), F.col("centre").alias(f"c{p}"), F.col("radius").alias(f"r{p}")) for p in "ab"]
        both = pairs.join(kids[0], "a").join(kids[1], "b")
        near = both.filter((F.col("a") != F.col("b")) | (F.col("na") <= F.col("nb"))).filter(
            (F.col("na") == F.col("nb")) | (distance <= F.col("ra") + F.col("rb") + F.lit(chord + SLACK))
        )
        pairs = runtime.stage(near.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"), "tree"), "pairs")
    return pairs


def near_pairs(vectors: DataFrame, cosine: float = 0.98, leaf_rows: int = 1024, fan: int = 32, depth: int = 12) -> DataFrame:
    """One row per vector of (vec_id, embedding, label): vec_id, n_links, component_id, kept."""
    chord = float(np.sqrt(2 - 2 * cosine))
    values = F.col("embedding").cast("array<double>")
    squares = F.aggregate(values, F.lit(0.0), lambda s, v: s + v * v)
    size = F.sqrt(squares)
    sound = F.col("label").isNotNull() & (size > 0) & (size < F.lit(float("inf"))) & ~F.exists(values, lambda v: v.isNull() | F.isnan(v))
    marked = vectors.select("vec_id", F.col("label").cast("string").alias("label"), values.alias("values"), F.coalesce(sound, F.lit(False)).alias("sound"))
    # scaled copies are one vector too, as far as the division shows; the others are found as pairs
    unit = F.when(F.col("sound"), F.transform("values", lambda v: v / F.sqrt(F.aggregate("values", F.lit(0.0), lambda s, x: s + x * x))))
    rows = marked.select("vec_id", unit.alias("unit"), "label")
    key = F.when(F.col("unit").isNotNull(), F.md5(F.concat_ws("|", "label", F.array_join(F.transform("unit", lambda v: F.hex(F.when(v == 0, F.lit(0.0)).otherwise(v).cast("string"))), ","))))
    named = runtime.stage(rows.withColumn("key", key), "vectors")
    classes = named.filter("key IS NOT NULL").groupBy("key").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("unit").alias("unit")
    )
    classes = classes.withColumn("tree", F.xxhash64("label", F.size("unit"))).withColumnRenamed("rep", "name")
    classes = runtime.stage(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    placed, levels = leaves(classes.select("tree", "rep", "unit", "copies"), leaf_rows, fan, depth)
    pairs = node_pairs(levels, chord)
    # a leaf still too large is cut by a hash; its parts meet each other and all that the leaf meets
    cuts = levels[-1].select("node", F.ceil(F.col("n") / leaf_rows).cast("int").alias("cuts"))
    tasks_ = (
        pairs.join(cuts.select(F.col("node").alias("a"), F.col("cuts").alias("ka")), "a")
        .join(cuts.select(F.col("node").alias("b"), F.col("cuts").alias("kb")), "b")
    )
    sides = tasks_.select("a", "b", F.col("a").alias("node"), "ka", "kb").unionAll(
        tasks_.filter("a != b").select("a", "b", F.col("b").alias("node"), "ka", "kb")
    )
    cut = placed.join(cuts, "node").withColumn("cut", F.pmod(F.xxhash64(F.lit("cut"), "rep"), F.col("cuts")).cast("int")).drop("cuts")
    me = F.col("cut")
    own = F.transform(F.sequence(F.lit(0), F.col("ka") - 1), lambda o: F.struct(F.least(o, me).alias("i"), F.greatest(o, me).alias("j")))
    first = F.transform(F.sequence(F.lit(0), F.col("kb") - 1), lambda o: F.struct(me.alias("i"), o.alias("j")))
    second = F.transform(F.sequence(F.lit(0), F.col("ka") - 1), lambda o: F.struct(o.alias("i"), me.alias("j")))
    meet = F.when(F.col("a") == F.col("b"), own).when(F.col("node") == F.col("a"), first).otherwise(second)
    met = cut.join(sides, "node").withColumn("m", F.explode(meet)).select(
        "a", "b", F.col("m.i").alias("i"), F.col("m.j").alias("j"), "node", "cut", "rep", "copies", "unit"
    )

    def compare(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        ids, copies, node, part = (table.column(c).to_numpy().astype(np.int64) for c in ("rep", "copies", "node", "cut"))
        a, b, i, j = (table.column(c)[0].as_py() for c in "abij")
        x = _vectors(table.column("unit"))
        counts = np.zeros(len(ids), np.int64)
        left = np.flatnonzero((node == a) & (part == i))
        right = left if (a, i) == (b, j) else np.flatnonzero((node == b) & (part == j))
        ends: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
        if len(left) and len(right):
            one = Tree(x[left])
            two = one if left is right else Tree(x[right])
            for p, q in dual(one, two, chord):
                if left is right:
                    p, q = np.minimum(p, q)[p != q], np.maximum(p, q)[p != q]
                p, q = left[p], right[q]
                good = np.concatenate([(x[p[k : k + 8192]] * x[q[k : k + 8192]]).sum(axis=1) for k in range(0, len(p), 8192)] or [np.empty(0)]) >= cosine
                ends[0].append(p[good])
                ends[1].append(q[good])
        one_, two_ = (np.concatenate([*e, np.empty(0, np.int64)]) for e in ends)
        np.add.at(counts, one_, copies[two_])
        np.add.at(counts, two_, copies[one_])
        return ids, counts, one_, two_

    found = runtime.stage(pairing.compared(met, ["a", "b", "i", "j"], compare), "links")
    counts = found.filter("b IS NULL").groupBy("a").agg(F.sum("n").alias("linked")).withColumnRenamed("a", "rep")
    roots = runtime.stage(common.components(found.filter("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "rep"), "roots")
    names = classes.join(roots, "rep").groupBy("root").agg(F.min("name").alias("least"))
    known = classes.select("key", "rep", "name", "copies").join(counts, "rep", "left").join(roots.join(names, "root"), "rep", "left")
    component = F.coalesce("least", "name", "vec_id")
    return named.select("vec_id", "key").join(known, "key", "left").select(
        "vec_id", (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("linked", F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


SQL = """
WITH RECURSIVE sound AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
linked AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
),
reached AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT r.a, l.b FROM reached r JOIN linked l ON r.b = l.a
)
SELECT vec_id, (SELECT count(*) FROM linked l WHERE l.a = vec_id) AS n_links, min(b) AS component_id, vec_id = min(b) AS kept
FROM embeddings JOIN reached ON vec_id = a GROUP BY vec_id
"""
