"""Repeated passages of words against brute force, with hot phrases and odd cases."""

import hashlib
import random

import pytest

from garimpo.llm import phrase_automata


def _wanted(rows, width):
    """Rows in order of doc_id; equal rows are one document."""
    seen, out = set(), {}
    for doc_id, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest())):
        words = text.encode().split()
        covered = [False] * len(words)
        for i in range(len(words) - width + 1):
            window = tuple(words[i : i + width])
            if window in seen:
                covered[i : i + width] = [True] * width
            seen.add(window)
        kept = b" ".join(w for w, c in zip(words, covered, strict=True) if not c)
        out[doc_id, text] = (len(words), sum(covered), hashlib.sha256(kept).hexdigest())
    return out


@pytest.fixture(scope="module")
def phrases(spark):
    """Windows that overlap in part, one phrase in many surroundings, text that repeats itself."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]

    def prose(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    common, long = prose(8), prose(300)
    texts = [prose(rng.randint(0, 9)) + common + prose(rng.randint(0, 30)) for _ in range(60)]
    texts += [long[a : a + rng.randint(15, 90)] + prose(5) for a in rng.choices(range(250), k=40)]
    texts += [prose(3) * 40, prose(7) * 30, ["a"] * 500, long, long, prose(19), prose(20), long[:20], long[1:20]]
    rows = [(i * 7 % 997, (" " if i % 3 else "\t\n ").join(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.mark.parametrize(("name", "options"), [
    ("docs", {}), ("docs", {"hot_runs": 1, "shard_words": 50}), ("docs", {"most": 3, "slice_bytes": 500}),
    ("repeated", {}), ("empty", {}), ("phrases", {}), ("phrases", {"hot_runs": 5, "shard_words": 100}),
    ("phrases", {"hot_runs": 1_000, "shard_words": 1, "slice_bytes": 1}),
])
def test_removed_passages(request, name, options):
    df = request.getfixturevalue(name)
    rows = [(r.doc_id, r.text or "") for r in df.collect()]
    wanted = _wanted(rows, 20)
    found = phrase_automata.removed_passages(df, **options).collect()
    key = str
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found), key=key) == sorted(((i, *wanted[i, t]) for i, t in rows), key=key)
    assert all(sum(b - a for a, b in r.spans) == r.n_removed for r in found)
    if name == "phrases":
        assert sum(r.n_removed for r in found) > 500


def test_kept_text_is_what_the_digest_says(phrases):
    full = phrase_automata.without_repeats(phrases).collect()
    sums = {r.doc_id: r.kept_sha256 for r in phrase_automata.removed_passages(phrases).collect()}
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == sums[r.doc_id] for r in full)
    assert any(r.kept_text == "" and r.n_words for r in full)
