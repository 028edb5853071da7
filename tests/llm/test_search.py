"""Ranked search against brute force over all documents, with ties, repeats and odd cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from garimpo.llm import treap_search


def _terms(text):
    lower = (text or "").translate(str.maketrans(treap_search.UPPER, treap_search.LOWER))
    return re.findall(treap_search.TERM, lower)


def _wanted(rows, items, k=10):
    docs = [(i, Counter(_terms(t))) for i, t in rows]
    docs = [(i, c) for i, c in docs if c]
    n_docs, total = len(docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(_terms(text))
    for item, terms in asked.items():
        scored = []
        for i, c in docs:
            m = 100 - 90 + (90 * c.total() * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                scored.append((-score, i is None, i))
        scored.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(scored[:k])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def items(spark, corpus):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice([t for _, t, *_ in corpus if t]).split()[2:14])) for i in range(15)]
    rows += [(20, None), (21, ""), (22, "zzz-unknown"), (3, "one Two THREE"), (None, "äöü Ha 34"), (None, "漢字 12"), (23, "ab"), (24, corpus[9][1]), (25, "x" * 700)]
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "item_id long, text string, term string, block int")


@pytest.mark.parametrize(("name", "options"), [
    ("docs", {}), ("docs", {"span": 4, "trees_per_task": 3}), ("docs", {"span": 7, "block_pairs": 40}), ("docs", {"k": 2, "span": 3}),
    ("repeated", {}), ("repeated", {"span": 2}), ("empty", {}),
])
def test_ranked(request, items, name, options):
    df = request.getfixturevalue(name)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    wanted = _wanted(rows, [(r.item_id, r.text) for r in items.collect()], options.get("k", 10))
    found = [tuple(r) for r in treap_search.ranked(df, items, **options).collect()]
    assert sorted(found, key=str) == wanted


def test_no_items(docs, items):
    assert treap_search.ranked(docs, items.limit(0)).count() == 0


def test_tree_keeps_every_cell_and_bounds_each_quarter():
    rng = np.random.default_rng(1)
    cells = np.unique(rng.integers(0, 1 << 12, 900))
    rows, cols, impacts = cells >> 6, cells & 63, rng.integers(1, 10**10, len(cells))
    tree = treap_search.opened(6, *treap_search.build(rows, cols, impacts, 6))
    for item in ([3], [1, 5, 40], list(range(64))):
        scores, names = treap_search.search(tree, np.array(item), np.arange(64), (np.empty(0, np.int64), np.empty(0, np.int64)), 64)
        sums = {c: sum(int(v) for r, x, v in zip(rows, cols, impacts, strict=True) if x == c and r in item) for c in range(64)}
        assert sorted(zip(scores.tolist(), names.tolist(), strict=True)) == sorted((s, c) for c, s in sums.items() if s)


def test_search_opens_few_ranges(monkeypatch):
    """One document stands out: the ranges without it are not opened down to their documents."""
    cols = np.arange(4096)
    tree = treap_search.opened(12, *treap_search.build(np.zeros(4096, np.int64), cols, np.where(cols == 1234, 10**6, 1 + cols % 7), 12))
    opened = []
    real = np.left_shift
    monkeypatch.setattr(treap_search.np, "left_shift", lambda a, b: opened.append(b.size) or real(a, b))
    scores, names = treap_search.search(tree, np.array([0]), cols, (np.empty(0, np.int64), np.empty(0, np.int64)), 1, wide=1)
    assert (scores.tolist(), names.tolist()) == ([10**6], [1234])
    assert len(opened) == 24
