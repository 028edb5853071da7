"""Language, mixing, sharding and packing: odd cases and what each promises."""

import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from garimpo.llm import language, mixing, packing, sharding


def _rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def tongues(spark):
    words = {"aa": ["balan", "korim", "stelo", "vento"], "bb": ["wyqx", "zukk", "pffr", "hjlm"]}
    rows = []
    for i in range(300):
        lang = "aa" if i % 3 else "bb"
        rows.append((i, " ".join(words[lang][(i * k + k) % 4] for k in range(1, 12 + i % 7)), lang))
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 !?", "bb"), (1003, "balan " * 5000, None), (1004, "zukk hjlm pffr wyqx zukk", "bb"), (5, "korim stelo", "aa"), (None, "vento balan", "aa")]
    return spark.createDataFrame([(*r, "x", 0.5) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")


def test_languages(tongues):
    found = _rows(language.predicted_languages(tongues))
    assert len(found) == tongues.count()
    known = {(r["doc_id"], r["text"]): r["lang"] for r in _rows(tongues)}
    by_id = defaultdict(list)
    for r in found:
        by_id[r["doc_id"]].append(r)
        assert 0 <= r["score"] <= 1
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    for odd in (1000, 1001, 1002):
        assert (by_id[odd][0]["lang_pred"], by_id[odd][0]["rejected"]) == ("und", True)
    assert by_id[1003][0]["lang_pred"] == "aa" and by_id[1004][0]["lang_pred"] == "bb" and len(by_id[5]) == 2
    plain = [(r["lang_pred"], lang) for (i, _), lang in known.items() for r in by_id[i][:1] if i is not None and i < 300 and r["held_out"]]
    assert len(plain) > 20 and sum(a == b for a, b in plain) >= 0.95 * len(plain)


def test_languages_without_training_rows(spark, tongues, empty):
    none = tongues.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in _rows(language.predicted_languages(none))} == {"und"}
    assert language.predicted_languages(empty).count() == 0


def test_languages_in_several_passes_are_those_of_one(tongues):
    parts = tongues.filter("lang IS NOT NULL").withColumn("lang", F.concat("lang", F.pmod(F.col("doc_id"), F.lit(20)).cast("string")))
    rows = parts.unionByName(tongues.filter("lang IS NULL")).withColumn("held", F.lit(1))
    train = language.training_rows(rows)
    one, many = (language.dictionaries(train, per_pass=n) for n in (1000, 6))
    assert one.select("pass").distinct().count() == 1 and many.select("pass").distinct().count() > 3 and many.count() == one.count() > 30
    told = lambda df: sorted((str(r["doc_id"]), r["lang_pred"], r["score"], r["rejected"]) for r in _rows(df))
    assert told(language.classify(rows, one)) == told(language.classify(rows, many))
    kept = language.accepted(rows, many)
    assert kept.columns == rows.columns
    assert sorted(map(str, _rows(kept))) == sorted(map(str, _rows(language.accepted(rows, one))))


def test_equal_sizes_go_to_the_language_with_more_rows(spark):
    rows = [(i, "stelo vento balan", "bb" if i < 60 else "aa") for i in range(100)]
    found = _rows(language.predicted_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert {r["lang_pred"] for r in found} == {"bb"} and {r["score"] for r in found} == {0.0}


def test_one_id_for_most_rows_gives_a_bounded_sample(spark):
    rows = spark.range(20_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("stelo vento "), F.col("id").cast("string")).alias("text"), F.lit("aa").alias("lang"))
    made = language.dictionaries(rows, sample_docs=50).collect()
    assert 20 < made[0]["content"].count("stelo") < 100 and made[0]["n"] == 20_000


def test_held_out_languages_of_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in df.select("doc_id", "lang").collect()}
    found = [r for r in _rows(language.predicted_languages(df)) if r["held_out"]]
    assert sum(lang[r["doc_id"]] == r["lang_pred"] for r in found) >= 0.97 * len(found)


def test_targets_stop_at_the_bound_and_share_the_rest():
    sizes = {"a": 10, "b": 100, "c": 1000, None: 5}
    found = mixing.targets(sizes)
    assert sum(found.values()) == pytest.approx(1115)
    assert found[None] == 15 and found["a"] == 30 and found["b"] == 300 and found["c"] == pytest.approx(770)
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0}


def _cost(flow_of_pattern, size):
    whole, rest = divmod(flow_of_pattern, size)
    return sum((2 * r + 1) * size for r in range(whole)) + (2 * whole + 1) * rest


def test_flow_is_largest_and_cheapest_for_overlapping_sources():
    patterns = [(frozenset("a"), 10), (frozenset("ab"), 20), (frozenset("b"), 5)]
    best = None
    for x in range(0, 61):  # words of the shared pattern for a; the rest follows
        a, b = min(30, max(0, 40 - x)), None
        if a + x > 40:
            continue
        for y in range(0, 61 - x):
            b = min(15, max(0, 30 - y))
            if y + b > 30:
                continue
            key = (-(a + x + y + b), _cost(a, 10) + _cost(x + y, 20) + _cost(b, 5))
            best = min(best or key, key)
    flow = mixing.route(patterns, {"a": 40, "b": 30}, 3)
    total = [sum(n for (i, _), n in flow.items() if i == p) for p in range(3)]
    assert (-sum(total), sum(_cost(t, s) for t, (_, s) in zip(total, patterns, strict=True))) == best
    assert flow[0, "a"] + flow[1, "a"] == 40 and flow[1, "b"] + flow[2, "b"] == 30


@pytest.mark.parametrize("name", ["docs", "repeated", "empty"])
def test_mixing(request, name):
    df = request.getfixturevalue(name)
    rows = _rows(df)
    found = _rows(mixing.mixed_documents(df))
    size = {(r["doc_id"], r["text"]): len((r["text"] or "").encode().split()) for r in rows}
    assert Counter((r["doc_id"], r["size"], r["source"]) for r in found) == Counter((r["doc_id"], size[r["doc_id"], r["text"]], r["source"]) for r in rows)
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += size[r["doc_id"], r["text"]]
    wanted = mixing.targets(dict(sizes)) if rows else {}
    taken, largest = Counter(), Counter()
    for r in found:
        assert r["taken"] % r["size"] == 0 if r["size"] else r["taken"] == 0
        assert r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(wanted[r["source"]])
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - wanted[s]) <= largest[s] + 1
    assert sorted(map(str, _rows(mixing.mixed_documents(df)))) == sorted(map(str, found))


@pytest.mark.parametrize("rows", [
    # half without doc_id; seven ids for all; one row for all
    [(None if i % 2 else i, "w " * (1 + i * i % 150), "abc"[i % 3]) for i in range(1500)],
    [(i % 7, "w " * (1 + i * i % 90), "ab"[i % 2]) for i in range(1500)],
    [(5, "w w w", "a")] * 900 + [(6, "w " * 40, "b"), (None, "w " * 9, None)],
])
def test_mixing_of_null_and_repeated_ids(spark, rows):
    df = spark.createDataFrame([(i, t, s, 1, "x", 2, 3) for i, t, s in rows], "doc_id long, text string, source string, `_n` int, `_order` string, `_extra` int, `_pattern` int")
    found = [sorted(map(str, _rows(mixing.mixed_documents(df.repartition(n), per_block=100)))) for n in (2, 5)]
    assert found[0] == found[1] and len(found[0]) == len(rows)
    taken, largest, sizes = Counter(), Counter(), Counter()
    for r in _rows(mixing.mixed_documents(df)):
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        sizes[r["source"]] += r["size"]
        assert r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"])
    wanted = mixing.targets(dict(sizes))
    assert all(abs(taken[s] - wanted[s]) <= largest[s] for s in sizes)


def test_copies_fall_in_the_seeded_order(spark):
    sized = spark.range(9000).select(F.col("id").alias("doc_id"), (F.col("id") % 40 + 1).alias("size"), (F.col("id") % 3).cast("string").alias("source"))
    by_source = defaultdict(list)
    for r in _rows(mixing.mix(sized, F.array("source"), F.col("size"))):
        by_source[r["members"][0]].append((r["seeded"], r["doc_id"], r["copies"]))
    for rows in by_source.values():  # over several blocks: but for the kinds that close the gap, more copies come first
        copies = [c for _, _, c in sorted(rows)]
        border = copies.index(min(copies))
        assert len(set(copies)) <= 2 and sum(c > min(copies) for c in copies[border:]) <= 3


def test_targets_of_a_table_are_those_of_the_rule(spark):
    import random

    rng = random.Random(6)
    for n in (0, 1, 7, 500):
        sizes = {f"s{i}" if i else None: int(10 ** rng.uniform(0, 5)) for i in range(n)}
        df = spark.createDataFrame(list(sizes.items()), "source string, size long").repartition(3)
        found = {r.source: r.target for r in mixing.source_targets(df, sum(sizes.values()), 3).collect()}
        assert found == pytest.approx(mixing.targets(sizes))


def test_many_sources(spark):
    df = spark.range(6000).selectExpr("id AS doc_id", "repeat('w ', 1 + id % 13) AS text", "concat('s', id % 2000) AS source")
    taken, wanted, largest = Counter(), {}, Counter()
    for r in mixing.mixed_documents(df).collect():
        taken[r.source] += r.taken
        wanted[r.source] = r.target
        largest[r.source] = max(largest[r.source], r.size)
    assert len(wanted) == 2000 and all(abs(taken[s] - wanted[s]) <= largest[s] for s in wanted)


def test_separate_overlaps_are_solved_apart(spark):
    rows = [(i, "w " * (1 + i % 9), [f"{i % 40}a", f"{i % 40}b"] if i % 3 else [f"{i % 40}a"]) for i in range(800)]
    df = spark.createDataFrame([*rows, (900, "w " * 50, ["alone"]), (901, "w w", [])], "doc_id long, text string, sources array<string>")
    found = _rows(mixing.mix(df, F.col("sources"), mixing.words(F.col("text"))))
    assert len(found) == 802 and {r["copies"] for r in found} <= {0, 1, 2, 3} and [r["taken"] for r in found if r["doc_id"] == 901] == [0]


def test_mixing_of_overlapping_sources(spark):
    rows = [(i, "w " * (1 + i % 9), (["a"], ["a", "b"], ["b"], ["b", "a", "a"])[i % 4]) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sources array<string>")
    found = _rows(mixing.mix(df, F.col("sources"), mixing.words(F.col("text"))))
    assert len(found) == 400 and {tuple(r["members"]) for r in found} == {("a",), ("a", "b"), ("b",)}
    total = sum(r["size"] for r in found)
    assert abs(sum(r["taken"] for r in found) - total) <= 30


@pytest.mark.parametrize(("name", "shards"), [("docs", 24), ("docs", 5), ("repeated", 3), ("empty", 4)])
def test_shards(request, name, shards):
    df = request.getfixturevalue(name)
    rows = _rows(df)
    found = _rows(sharding.balanced_shards(df, shards))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == Counter(
        (r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in rows
    )
    counts = Counter(r["shard"] for r in found)
    if rows:
        sizes = [counts.get(s, 0) for s in range(shards)]
        assert max(sizes) - min(sizes) <= 1 and set(counts) <= set(range(shards))
    for s in counts:
        assert sorted(r["slot"] for r in found if r["shard"] == s) == list(range(counts[s]))
    assert {r["law"] for r in found} <= {"rows"} and {r["grown_shard"] for r in found} <= {None}


def test_linked_documents_move_together_as_far_as_quotas_go(spark):
    rows = [(i, f"group {i % 20}" if i < 200 else "giant" if i < 400 else f"single {i}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["shard"] for r in _rows(sharding.balanced_shards(df, 6, rounds=12))}
    assert sorted(Counter(found.values()).values()) == [100] * 6
    places = defaultdict(Counter)
    for i, text in rows:
        places[text][found[i]] += 1
    assert sum(len(places[f"group {g}"]) == 1 for g in range(20)) >= 17
    assert sum(n for _, n in places["giant"].most_common(2)) >= 150  # two shards hold 200 at most


def test_pairs_meet_where_every_shard_is_full(spark):
    rows = [(i, f"pair {i % 600}") for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["shard"] for r in _rows(sharding.balanced_shards(df, 8))}
    assert sorted(Counter(found.values()).values()) == [150] * 8
    assert sum(found[i] != found[i + 600] for i in range(600)) <= 12


def test_rows_leave_a_full_shard_for_a_side_with_room(spark):
    rows = [("two", 0), ("two", 1), ("whole", 0), ("whole", 0), ("three", 0), ("three", 0), ("three", 1)]
    df = spark.createDataFrame([(i, g, s) for i, (g, s) in enumerate(rows)], "row long, group string, shard int")
    found = defaultdict(Counter)
    for r in sharding.propagate(df, [5, 9], 6).collect():
        found[r["group"]][r["shard"]] += 1
    assert all(len(c) == 1 for c in found.values()) and sum(c[0] for c in found.values()) <= 5


def test_moves_between_shards_respect_quotas():
    wished = {(0, 1): 5, (1, 0): 3, (1, 2): 4, (2, 0): 1, (3, 1): 2}
    assert sharding.circulation(wished, [0, 0, 0, 0]) == {(0, 1): 4, (1, 0): 3, (1, 2): 1, (2, 0): 1}
    made = sharding.circulation(wished, [0, 0, 2, 0])
    net = Counter()
    for (a, b), n in made.items():
        assert 0 < n <= wished[a, b]
        net[b] += n
        net[a] -= n
    assert max(net[s] - [0, 0, 2, 0][s] for s in range(4)) <= 0 and made[1, 2] == 3


@pytest.mark.parametrize(("name", "options"), [("docs", {"capacity": 200}), ("docs", {"capacity": 64, "per_group": 10}), ("repeated", {"capacity": 50}), ("empty", {})])
def test_bins(request, name, options):
    df = request.getfixturevalue(name)
    rows = _rows(df)
    found = _rows(packing.packed_documents(df, **options))
    capacity = options.get("capacity", 2048)
    words = Counter()
    for r in rows:
        words[r["doc_id"]] += len((r["text"] or "").encode().split())
    packed = Counter()
    bins = defaultdict(list)
    for r in found:
        packed[r["doc_id"]] += r["size"]
        bins[r["bin_id"]].append(r)
    assert set(packed) == {r["doc_id"] for r in rows} and all(packed[d] == words[d] for d in packed)
    for pieces in bins.values():
        assert sum(p["size"] for p in pieces) <= capacity
        ends = 0
        for p in sorted(pieces, key=lambda p: (p["bin_offset"], p["size"])):
            assert p["bin_offset"] == ends
            ends += p["size"]
        for what in ("source", "cluster"):
            held = [p[what] for p in pieces if p[what] is not None]
            assert len(held) == len(set(held))


def test_equal_rows_spread_over_packing_groups(spark):
    rows = spark.range(6000).select(F.when(F.col("id") < 5000, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("same old words").alias("text"), F.lit(None).cast("string").alias("source"))
    found = packing.packed_documents(rows, per_group=500)
    sizes = [r["count"] for r in found.groupBy("pack_group").count().collect()]
    assert sum(sizes) == 6000 and len(sizes) == 12 and max(sizes) < 700
    again = packing.packed_documents(rows.repartition(5, "doc_id"), per_group=500)
    assert sorted(map(str, found.collect())) == sorted(map(str, again.collect()))


def test_best_fit_takes_the_tightest_compatible_bin():
    import random

    rng = random.Random(1)
    capacity = 50
    bins = packing.Bins(capacity)
    plain = []  # residual, sources, clusters
    for _ in range(1500):
        size, source, cluster = rng.randint(0, capacity), 1 << rng.randrange(6) if rng.random() < 0.9 else 0, 1 << rng.randrange(40) if rng.random() < 0.3 else 0
        fits = [b[0] for b in plain if b[0] >= size and not b[1] & source and not b[2] & cluster]
        b, offset = bins.place(size, source, cluster, capacity)
        if fits:
            assert b < len(plain) and plain[b][0] == min(fits) and not plain[b][1] & source and not plain[b][2] & cluster
            assert offset == capacity - plain[b][0]
            plain[b] = [plain[b][0] - size, plain[b][1] | source, plain[b][2] | cluster]
        else:
            assert b == len(plain) and offset == 0
            plain.append([capacity - size, source, cluster])
    assert Fraction(sum(capacity - p[0] for p in plain), capacity * len(plain)) > Fraction(1, 2)
