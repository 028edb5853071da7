"""Prefix trie against brute force, with crowded nodes, spilled messages and odd cases."""

import hashlib
import random
import zlib

import pytest

from garimpo.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, a string, shard string, conv long"


def _digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}:{text}".encode()).digest()


def _wanted(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, _digest(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts, key=lambda t: t[:3])] for c, ts in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:h] + turns[h:]
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for key in members:
        if key:
            kids.setdefault(key[:-1], []).append(key)

    def below(key):
        stack, leaves, saved = [key], 0, 0
        while stack:
            k = stack.pop()
            leaves += not kids.get(k)
            saved += (len(members[k]) - 1) * (len(k[-1][1]) if k else 0)
            stack += kids.get(k, [])
        return leaves, saved

    out = []
    for key, ids in members.items():
        ends = ",".join(str(c) for c in sorted(ids) if len(rebuilt[c]) == len(key))
        parent = min(members[key[:-1]]) if key else None
        out.append((min(ids), len(key), parent, len(ids), len(kids.get(key, [])), *below(key), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def _rows(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(4)
    rows = []
    for c in range(400):
        texts = [rng.choice(["hello", "a", "äé漢", ""]) for _ in range(rng.randint(0, 9))]
        rows += [(c, i, "user" if i % 2 else "assistant", t) for i, t in enumerate(texts)]
    rows += [(c, i, "user", f"turn {i}") for c in (500, 501, 502, 612, 613, 699) for i in range(7)]
    rows += [(700 + c, i, "system", "the same") for c in range(60) for i in range(4)]
    rows += [(2000, i, "user", f"long {i}") for i in range(900)] + [(2001, i, "user", f"long {i}") for i in range(850)]
    return rows


ODD = [
    (None, 0, "user", "lost"), (1, None, None, None), (1, None, "user", None), (1, 2, None, "x"), (1, 2, "user", "x"), (1, 2, "user", "x"), (1, -5, "user", "y"),
    (-3, 0, "user", "n"), (-103, 1, "user", "m"), (-103, 0, "user", "z"), (0, 0, "user", "base"), (0, 1, "user", "base 2"), (7, 0, "ab", "c"), (9, 0, "a", "bc"),
    (8, 0, "user", "x" * 100_000), (12345, 0, "user", "alone"), (12399, 3, None, ""),
]


@pytest.mark.parametrize("options", [{}, {"crowd": 3, "in_memory": 2, "block": 7}, {"crowd": 10**6, "in_memory": 1}, {"crowd": 40, "block": 100}])
def test_prefix_trie(spark, talks, options):
    found = prefix_trie.prefix_trie(_rows(spark, talks), **options)
    assert sorted((tuple(r) for r in found.collect()), key=str) == _wanted(talks)


@pytest.mark.parametrize("rows", [ODD, ODD * 3, []])
def test_odd_rows(spark, rows):
    found = prefix_trie.prefix_trie(_rows(spark, rows) if rows else spark.createDataFrame([], SCHEMA), crowd=1)
    assert sorted((tuple(r) for r in found.collect()), key=str) == _wanted(rows)


def test_one_conversation_over_many_ranges(spark, monkeypatch):
    rows = [(5, i, "user", str(i % 3)) for i in range(3000)] + [(6, 1, "user", "b")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = prefix_trie.ordered_turns(_rows(spark, rows)).filter("conv = 5").select("pos", "digest").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((r.pos, bytes(r.digest)) for r in turns) == [(i, _digest("user", str(i % 3))) for i in range(3000)]


def test_clashing_names_lead_to_another_seed(spark, talks, monkeypatch):
    real, seeds = prefix_trie.named_prefixes, []

    def short(turns, seed, block):
        seeds.append(seed)
        frame = real(turns, seed, block)
        return frame.withColumn("a", frame.a % 2).withColumn("b", frame.b % 2) if not seed else frame

    monkeypatch.setattr(prefix_trie, "named_prefixes", short)
    assert sorted((tuple(r) for r in prefix_trie.prefix_trie(_rows(spark, talks[:900])).collect()), key=str) == _wanted(talks[:900])
    assert seeds == [0, 1]


def test_queue_spills_and_keeps_order():
    rng = random.Random(2)
    queue = prefix_trie.SpillingQueue(5, 3, 1)
    entries = [(rng.randrange(20), rng.randrange(9), i) for i in range(200)]
    for e in entries:
        queue.push(e)
    assert queue.spilled > 20
    for k in range(20):
        assert sorted(queue.pop_all((k,))) == sorted(e for e in entries if e[0] == k)
        if k < 19:
            queue.push((k + 1, 0, 1000 + k))
            entries.append((k + 1, 0, 1000 + k))
