"""Exact, near and string duplicates against brute force, with odd cases and other paths."""

import hashlib
from itertools import combinations

import numpy as np
import pytest

from garimpo.llm import cover_tree, exact_dedup, ngram_join, suffix_dedup


def _exact(rows):
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(text or "", []).append(doc_id)
    out = []
    for text, ids in groups.items():
        named = [i for i in ids if i is not None]
        keep = max(named) if named else None
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return out


def _key(row):
    return tuple((v is None, v) if not isinstance(v, list) else (False, str(v)) for v in row)


@pytest.mark.parametrize("name", ["docs", "repeated", "empty"])
@pytest.mark.parametrize("chunks", [{}, {"bits": 3, "least": 4, "most": 40}])
def test_exact_groups(request, name, chunks):
    df = request.getfixturevalue(name)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    found = [tuple(r) for r in exact_dedup.exact_groups(df, **chunks).collect()]
    assert sorted(found, key=_key) == sorted(_exact(rows), key=_key)


def test_clashing_chunk_names_lead_to_another_key(docs, monkeypatch):
    """Names of one byte clash; the operator must see it and not answer."""
    real = exact_dedup.hashlib.blake2b
    named = exact_dedup._named

    def short(docs_, key, *options, **more):
        frame = named(docs_, key, *options, **more)
        if not more.get("recipes") and key == b"chunk-0":
            from pyspark.sql import functions as F

            return frame.withColumn("name", F.substring("name", 1, 1))
        return frame

    monkeypatch.setattr(exact_dedup, "_named", short)
    assert exact_dedup.recipes(docs, bits=3, least=4, most=40).count() == docs.count()
    assert exact_dedup.hashlib.blake2b is real


def _removed(rows, length):
    """Rows in order of doc_id; equal rows are one document."""
    seen, out = set(), {}
    for doc_id, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest())):
        raw = (text or "").encode()
        covered = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            window = raw[i : i + length]
            if window in seen:
                covered[i : i + length] = b"\1" * length
            seen.add(window)
        kept = bytes(b for b, c in zip(raw, covered, strict=True) if not c)
        spans = sum(1 for i, c in enumerate(covered) if c and (not i or not covered[i - 1]))
        out[doc_id, text or ""] = (len(raw), sum(covered), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("name", "options"), [
    ("docs", {}), ("docs", {"hot_runs": 1}), ("docs", {"most": 7, "slice_bytes": 1000}), ("repeated", {}), ("empty", {}),
])
def test_repeated_spans(request, name, options):
    df = request.getfixturevalue(name)
    rows = [(r.doc_id, r.text or "") for r in df.collect()]
    wanted = _removed(rows, 100)
    found = suffix_dedup.repeated_spans(df, **options).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted((tuple(r) for r in found), key=_key) == sorted(((i, *wanted[i, t]) for i, t in rows), key=_key)


def _shingles(text):
    words = (text or "").encode().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def _linked(rows):
    sets = [_shingles(t) for _, t in rows]
    links = [0] * len(rows)
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        shared = len(sets[a] & sets[b])
        if sets[a] and 5 * shared >= 4 * (len(sets[a]) + len(sets[b]) - shared):
            links[a] += 1
            links[b] += 1
            root[top(b)] = top(a)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[top(i)] = min(doc_id, least.get(top(i), doc_id))
    return [(doc_id, least.get(top(i)), links[i], len(sets[i])) for i, (doc_id, _) in enumerate(rows)]


@pytest.mark.parametrize(("name", "options"), [("docs", {}), ("docs", {"block_rows": 3}), ("repeated", {}), ("empty", {})])
def test_near_duplicates(request, name, options):
    df = request.getfixturevalue(name)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    found = ngram_join.near_duplicates(df, **options)
    assert [c for c in found.columns if c == "kept"]
    got = [(r.doc_id, r.class_id, r.n_links, r.n_shingles) for r in found.collect()]
    assert sorted(got, key=_key) == sorted(_linked(rows), key=_key)


def test_near_copies_without_doc_id_keep_their_links(spark, docs):
    words = [f"word{i}" for i in range(61)]
    near = " ".join([*words[:-1], "other"])
    alone = [f"lone{i} " * 3 + " ".join(f"w{j}" for j in range(40 + i)) for i in range(2)]
    rows = [(1, " ".join(words)), (None, near), (None, near), (None, near + " "), (None, alone[0]), (None, alone[1]), (None, None), (9, near + " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = ngram_join.near_duplicates(df).collect()
    got = [(r.doc_id, r.class_id, r.n_links, r.n_shingles) for r in found]
    assert sorted(got, key=_key) == sorted(_linked(rows), key=_key)
    assert sorted(((r.doc_id, r.n_links, r.kept) for r in found if r.class_id == 1), key=str) == [(1, 4, True), (9, 4, False), *[(None, 4, False)] * 3]
    assert all(r.kept for r in found if r.class_id is None)
    half = docs.selectExpr("CASE WHEN doc_id % 2 = 0 THEN doc_id END AS doc_id", "text")
    got = [(r.doc_id, r.class_id, r.n_links, r.n_shingles) for r in ngram_join.near_duplicates(half).collect()]
    assert sorted(got, key=_key) == sorted(_linked([tuple(r) for r in half.collect()]), key=_key)


def test_pruning_bounds_keep_similar_pairs():
    least = ngram_join.least_matches(0.8, 1e-7)
    assert len(least) == 8 and sorted(least) == least
    assert 30 < least[-1] < 0.8 * 128 - 20  # far below what a pair at the threshold matches


def _vectors(seed=3):
    rng = np.random.default_rng(seed)
    rows, number = [], 0
    for label in (1, 2):
        centres = rng.normal(size=(12, 16))
        for c in centres:
            for _ in range(rng.integers(1, 9)):
                rows.append((number, (c + rng.normal(size=16) * 0.06).tolist(), label))
                number += 1
    for _ in range(40):  # one dense cluster
        rows.append((number, (np.ones(16) + rng.normal(size=16) * 0.02).tolist(), 2))
        number += 1
    rows += [(number + i, rows[0][1], 1) for i in range(5)]
    number += 5
    rows += [(number, [2 * x for x in rows[0][1]], 1), (number + 1, None, 1), (number + 2, [0.0] * 16, 1), (number + 3, [float("nan")] + [1.0] * 15, 1), (number + 4, [None] + [1.0] * 15, 2)]
    rows += [(number + 5, rows[0][1], None), (number + 6, [float("inf")] + [1.0] * 15, 1), (number + 7, [1.0, 2.0], 1), (number + 8, [2.0, 4.1], 1), (number + 9, [], 2)]
    return rows


def _near(rows, cosine):
    links = [0] * len(rows)
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    def unit(v):
        if not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        return np.array(v) / np.linalg.norm(v)

    units = [unit(v) for _, v, _ in rows]
    for a, b in combinations(range(len(rows)), 2):
        if rows[a][2] is None or rows[a][2] != rows[b][2] or units[a] is None or units[b] is None or len(units[a]) != len(units[b]):
            continue
        if units[a] @ units[b] >= cosine:
            links[a] += 1
            links[b] += 1
            root[top(b)] = top(a)
    least = {}
    for i, (vec_id, _, _) in enumerate(rows):
        if vec_id is not None:
            least[top(i)] = min(vec_id, least.get(top(i), vec_id))
    return [(vec_id, links[i], least.get(top(i))) for i, (vec_id, _, _) in enumerate(rows)]


@pytest.mark.parametrize("options", [{}, {"leaf_rows": 5, "fan": 4}, {"leaf_rows": 8, "fan": 3, "depth": 1}])
def test_near_pairs(spark, options):
    rows = _vectors()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, node int, unit string")
    found = [(r.vec_id, r.n_links, r.component_id) for r in cover_tree.near_pairs(df, **options).collect()]
    assert sorted(found) == sorted(_near(rows, 0.98))


def test_near_pairs_of_repeated_and_no_rows(spark):
    kind = "vec_id long, embedding array<float>, label int"
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (None, [0.0, 1.0], 1), (2, [0.01, 1.0], 1), (None, [1.0, 1.0], 1)]
    found = [(r.vec_id, r.n_links, r.component_id) for r in cover_tree.near_pairs(spark.createDataFrame(rows, kind)).collect()]
    assert sorted(found, key=_key) == sorted(_near(rows, 0.98), key=_key)
    assert cover_tree.near_pairs(spark.createDataFrame([], kind)).count() == 0


def test_tree_is_nested_and_covers():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5))
    x /= np.linalg.norm(x, axis=1)[:, None]
    tree = cover_tree.Tree(x)
    for level in range(len(tree.levels) - 1):
        assert set(tree.levels[level][0]) <= set(tree.levels[level + 1][0])
    pairs = {tuple(sorted((int(a), int(b)))) for p, q in cover_tree.dual(tree, tree, 0.4) for a, b in zip(p, q, strict=True)}
    gap = np.linalg.norm(x[:, None] - x[None], axis=2)
    assert {(i, j) for i, j in combinations(range(200), 2) if gap[i, j] <= 0.4} <= pairs
