"""Removal of repeated byte strings by distributed prefix doubling.

Wanted: every byte that lies in a string of `length` bytes which also starts earlier. Ranking
every position of the corpus in every doubling round moves some hundred bytes for each byte
of text, so positions are ranked where a repeat can show:

1. Anchors. A position is an anchor if the hash of its first 32 bytes is the least in some
   stretch of `length`: each window (string of `length` bytes) has one, chosen by its content
   alone, so equal windows have the same anchor string at the same place. Consecutive windows
   with one anchor string form a run; the run's text is all their bytes.
2. First ranks. Runs are ranked by their anchor string (32 bytes): one that no other run
   shares is unique and drops out. Ties are ranked on by their whole text: a run whose text
   also starts earlier is repeated as a whole; the earliest run of each text goes on, if
   another text has its anchor, or if its own text has the anchor twice.
3. Doubling. Every window start in those runs is a position, ranked by its anchor string and
   its first 32 bytes; ranks are paired with those of the next 32, then 36 bytes, sorted and
   ranked anew, to 64 and 100 bytes. Unique positions drop out after each round, and at
   `length` a position whose string starts earlier is repeated. Spark sorts the runs by
   anchor; a task ranks the positions of the runs it holds. An anchor with more than
   `hot_runs` runs is no single task: its positions become rows, and Spark pairs, groups and
   ranks them by the same rounds.

A run is named by its anchor's and its text's 64-bit hashes together, a position by those of
its three parts. Copies within one slice of a batch go no further than step 2's map side, so a
passage with a third of all rows reaches no task as a third of all rows. Texts travel
compressed, twice: to the runs that step 3 needs, and to the final cut.

Defined cases: a null text is empty; texts under `length` bytes lose nothing; a repeated
doc_id: its rows are taken one after the other in the order of their texts, equal rows being
one document whose result is repeated; a null doc_id comes before all others; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garimpo import runtime
from garimpo.llm import shingles

GRAM = 32
INNER = 1 << 15
_LOWEST = -(1 << 63)
_BASE = int(shingles._random("run", 1)[0]) | 1


def _grams(data: np.ndarray) -> np.ndarray:
    """64-bit name of the 32 bytes that begin at each position."""
    n = len(data) - GRAM + 1
    words = np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1))
    words = np.ascontiguousarray(words).view(np.uint64).ravel()
    out = words[:n] * shingles._PLACE[0]
    for i in (1, 2, 3):
        out ^= out >> np.uint64(29)
        out += words[8 * i : 8 * i + n]
        out *= shingles._PLACE[i]
    return out ^ (out >> np.uint64(32))


def _least(values: np.ndarray, span: int) -> np.ndarray:
    """Minimum of each `span` neighbours, by doubling."""
    width = 1
    while width * 2 <= span:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    rest = span - width
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


_POWERS: dict[tuple[int, int], np.ndarray] = {}


def _power(bits: int, base: int) -> np.ndarray:
    if (bits, base) not in _POWERS:
        if len(_POWERS) > 7:
            _POWERS.clear()
        out = np.full(1 << bits, base, np.uint64)
        out[0] = 1
        _POWERS[bits, base] = np.multiply.accumulate(out)
    return _POWERS[bits, base]


def _names(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit names of stretches of at least 8 bytes, from running sums over mixed 8-byte words."""
    words = np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1))
    words = shingles.mixed(np.ascontiguousarray(words).view(np.uint64).ravel())
    bits = max(10, int(len(data)).bit_length())
    words *= _power(bits, _BASE)[: len(words)]
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words, out=sums[1:])
    stretch = (sums[ends - 7] - sums[begins]) * _power(bits, pow(_BASE, -1, 1 << 64))[begins]
    return shingles.mixed(stretch + (ends - begins).astype(np.uint64) * shingles._PLACE[10])


def _runs(data: np.ndarray, length: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of windows, anchor name, text name of each run of a text, and whether its
    anchor string may come twice in it (only then can a run repeat within itself)."""
    span = length - GRAM + 1
    grams = _grams(data)
    anchor = _least(grams, span)
    starts = np.concatenate([[0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1])
    counts = np.diff(np.concatenate([starts, [len(anchor)]]))
    if counts.max() > most:  # a text that repeats itself: cut anywhere, as any cut is right
        pieces = -(-counts // most)
        inside = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        whole = np.repeat(counts, pieces)
        starts = np.repeat(starts, pieces) + inside * most
        counts = np.minimum(most, whole - inside * most)
    # the least of some window: where the greatest minimum of the windows around is the value itself
    around = np.concatenate([np.zeros(span - 1, np.uint64), anchor, np.zeros(span - 1, np.uint64)])
    chosen = np.flatnonzero(grams == ~_least(~around, span))
    twice = np.concatenate([[0], np.cumsum(grams[chosen[1:]] == grams[chosen[:-1]]), [0]])
    first = np.searchsorted(chosen, starts)
    last = np.searchsorted(chosen, starts + counts + span - 1) - 1
    inner = twice[np.maximum(last, first)] > twice[first]
    return starts, counts, anchor[starts], _names(data, starts, starts + counts + length - 1), inner


def _runs_of(docs: DataFrame, length: int, most: int, slice_bytes: int) -> DataFrame:
    """(doc, at, anchor, name) of all runs of (doc, bytes); `at` packs start, INNER and number of windows.

    `anchor` is null for a run whose text starts earlier within its slice of a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = sorted((d, i) for i, d in enumerate(batch.column(0).to_pylist()))
            found, total = [], 0
            for doc, i in order:
                data = np.frombuffer(batch.column(1)[i].as_buffer(), np.uint8)
                if len(data) >= length:
                    starts, counts, anchor, name, inner = _runs(data, length, most)
                    found.append((np.full(len(starts), doc, np.int64), starts << 16 | inner * INNER | counts, anchor, name))
                    total += len(data)
                if total >= slice_bytes:
                    yield _first_of_slice(found)
                    found, total = [], 0
            if found:
                yield _first_of_slice(found)

    return docs.select("doc", "bytes").mapInArrow(run, "doc long, at long, anchor long, name long")


def _first_of_slice(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    doc, at, anchor, name = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((name, anchor))  # stable: the earliest of equal names comes first
    again = np.zeros(len(doc), bool)
    again[order[1:]] = (name[order[1:]] == name[order[:-1]]) & (anchor[order[1:]] == anchor[order[:-1]])
    return pa.RecordBatch.from_arrays(
        [pa.array(doc), pa.array(at), pa.array(anchor.view(np.int64), mask=again), pa.array(name.view(np.int64))],
        names=["doc", "at", "anchor", "name"],
    )


def _ranked(runs: DataFrame) -> DataFrame:
    """(doc, at, anchor): runs repeated as a whole, and with their anchor those that need ranks by position.

    Ranks come from one sort by anchor, text and position; a task keeps one row of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_anchor, last_name, waiting = None, None, None  # waiting: the only text of its anchor so far
        for batch in batches:
            if not batch.num_rows:
                continue
            doc, at, name = (batch.column(i).to_numpy() for i in (0, 1, 3))
            plain = batch.column(2).is_null().to_numpy(zero_copy_only=False)
            anchor = batch.column(2).fill_null(0).to_numpy()
            new_anchor = np.ones(len(doc), bool)
            new_anchor[1:] = (anchor[1:] != anchor[:-1]) | (plain[1:] != plain[:-1])
            new_anchor[0] = plain[0] or anchor[0] != last_anchor
            new_name = new_anchor.copy()
            new_name[1:] |= name[1:] != name[:-1]
            new_name[0] |= name[0] != last_name
            first = new_name & ~plain
            # an anchor's texts, counted from its begin on; what came before this batch counts once
            group = np.cumsum(new_anchor)
            texts = np.bincount(group[first], minlength=group[-1] + 1)
            if group[0] == 0:
                texts[0] += 1 if waiting is not None else 2
            several = texts[group] > 1
            open_ = first & (several | ((at & INNER) > 0))
            at = at & ~INNER
            if waiting is not None and (group[0] == 1 or texts[0] > 1):
                if group[0] == 0:
                    yield _verdicts(*(np.array([x]) for x in waiting), np.array([True]))
                waiting = None
            elif group[-1]:
                waiting = None
            ends = first & ~open_ & (group == group[-1])
            if ends.any():
                i = int(np.flatnonzero(ends)[0])
                waiting = (doc[i], at[i], anchor[i])
            last_anchor, last_name = (None, None) if plain[-1] else (anchor[-1], name[-1])
            said = ~first | open_
            yield _verdicts(doc[said], at[said], anchor[said], open_[said])

    part = F.coalesce("anchor", "name")  # copies found on the map side only pass through
    dealt = runs.withColumn("part", part).repartition("part").select("doc", "at", "anchor", "name")
    return dealt.sortWithinPartitions("anchor", "name", "doc", "at").mapInArrow(run, "doc long, at long, anchor long")


def _verdicts(doc: np.ndarray, at: np.ndarray, anchor: np.ndarray, open_: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(at), pa.array(anchor, mask=~open_)], names=["doc", "at", "anchor"])


def _with_text(docs: DataFrame, open_: DataFrame, length: int) -> DataFrame:
    """(anchor, doc, at, bytes): open runs with their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text = zstandard.decompress(batch.column(1)[i].as_py())
                runs = batch.column(2)[i].values
                at = runs.field("at")
                parts = [text[x >> 16 : (x >> 16) + (x & 0xFFFF) + length - 1] for x in at.to_pylist()]
                doc = np.full(len(at), batch.column(0)[i].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([runs.field("anchor"), pa.array(doc), at, pa.array(parts, pa.binary())], names=["anchor", "doc", "at", "bytes"])

    wanted = open_.groupBy("doc").agg(F.collect_list(F.struct("at", "anchor")).alias("runs"))
    return _packed(docs).join(wanted, "doc").select("doc", "packed", "runs").mapInArrow(run, "anchor long, doc long, at long, bytes binary")


def _positions(batch: pa.RecordBatch | pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Window starts of runs (anchor, doc, at, bytes): number of the run, position, names of the three parts."""
    at = batch.column(2).to_numpy()
    counts = at & 0xFFFF
    texts = b"".join(batch.column(3).to_pylist())
    data = np.frombuffer(texts, np.uint8)
    sizes = counts + length - 1
    begins = np.cumsum(sizes) - sizes
    run = np.repeat(np.arange(len(at)), counts)
    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    here = begins[run] + inside
    names = [_names(data, here + a, here + b) for a, b in ((0, GRAM), (GRAM, 2 * GRAM), (2 * GRAM, length))]
    return run, (at[run] >> 16) + inside, names


def _doubled_here(runs: DataFrame, length: int, chunk: int) -> DataFrame:
    """(doc, at) of the repeated windows of open runs, ranked in the tasks that hold whole anchors."""

    def rounds(held: pa.Table) -> Iterator[pa.RecordBatch]:
        run, pos, names = _positions(held, length)
        doc = held.column(1).to_numpy()
        live = np.arange(len(run))  # rows come in order of document and position
        rank = held.column(0).to_numpy().view(np.uint64)[run]
        for name in names:
            order = live[np.lexsort((live, name[live], rank[live]))]
            new = np.ones(len(order), bool)
            new[1:] = (name[order[1:]] != name[order[:-1]]) | (rank[order[1:]] != rank[order[:-1]])
            begin = np.flatnonzero(new)
            count = np.diff(np.concatenate([begin, [len(order)]]))
            rank = rank.copy()
            rank[order] = np.repeat(order[begin], count).astype(np.uint64)  # the earliest position of the string
            live = np.sort(order[np.repeat(count, count) > 1])
            if not len(live):
                return
        again = live[rank[live] != live.astype(np.uint64)]
        yield pa.RecordBatch.from_arrays([pa.array(doc[run[again]]), pa.array(pos[again] << 16 | 1)], names=["doc", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= chunk:  # what is before the last anchor is whole
                table = pa.Table.from_batches(held).combine_chunks()
                anchor = table.column(0).to_numpy()
                end = int(np.flatnonzero(anchor != anchor[-1])[-1]) + 1 if anchor[0] != anchor[-1] else 0
                if end:
                    yield from rounds(table.slice(0, end))
                held, rows = table.slice(end).to_batches(), table.num_rows - end
        if rows:
            yield from rounds(pa.Table.from_batches(held).combine_chunks())

    return runs.repartition("anchor").sortWithinPartitions("anchor", "doc", "at").mapInArrow(run, "doc long, at long")


def _doubled(runs: DataFrame, length: int) -> DataFrame:
    """(doc, at) of the repeated windows of open runs, ranked by Spark, a row for each position.

    A rank is the earliest position of a string. Each round pairs the rank so far with the
    name of the next part and drops what is unique; equal pairs meet in an aggregation whose
    map side combines them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                number, pos, names = _positions(part, length)
                doc = part.column(1).to_numpy()[number]
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(pos), *(pa.array(n.view(np.int64)) for n in names)], names=["doc", "pos", "name0", "name1", "name2"])

    here = F.struct("doc", "pos")
    now = runs.mapInArrow(run, "doc long, pos long, name0 long, name1 long, name2 long")
    now = runtime.stage(now.withColumn("rank", F.struct(F.col("name0").alias("doc"), F.lit(0).cast("long").alias("pos"))).drop("name0"), "positions")
    for part in ("name1", "name2"):
        ranks = now.groupBy("rank", part).agg(F.min(here).alias("new"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
        now = runtime.stage(now.join(ranks, ["rank", part]).drop("rank", part).withColumnRenamed("new", "rank"), "ranks")
    return now.filter(here != F.col("rank")).select("doc", F.shiftleft("pos", 16).bitwiseOR(F.lit(1)).alias("at"))


def _packed(docs: DataFrame) -> DataFrame:
    """(doc, packed): compressed texts, as they travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            packed = [tool.compress(v.as_buffer()) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["doc", "packed"])

    return docs.select("doc", "bytes").mapInArrow(run, "doc long, packed binary")


def _cut(docs: DataFrame, marks: DataFrame, length: int) -> DataFrame:
    """Documents without the bytes of their marked windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for i in range(batch.num_rows):
                text = zstandard.decompress(batch.column(1)[i].as_py()) if batch.column(1)[i].as_py() else b""
                spans = removed(len(text), batch.column(2)[i].values, length)
                digest, at = hashlib.sha256(), 0
                for a, b in spans:
                    digest.update(text[at:a])
                    at = b
                digest.update(text[at:])
                for column, value in zip(rows, (batch.column(0)[i].as_py(), len(text), sum(b - a for a, b in spans), spans, digest.hexdigest()), strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=["doc", "n_bytes", "n_removed", "spans", "kept_sha256"])

    return _packed(docs).join(marks, "doc", "left").select("doc", "packed", "at").mapInArrow(
        run, "doc long, n_bytes long, n_removed long, spans array<array<bigint>>, kept_sha256 string"
    )


def removed(size: int, marks: pa.Array | None, length: int) -> list[list[int]]:
    """Maximal stretches that the marked windows cover; a mark packs start and number of windows."""
    if marks is None or not len(marks):
        return []
    at = np.sort(marks.to_numpy())
    begins, ends = at >> 16, (at >> 16) + (at & 0xFFFF) + length - 1
    reach = np.maximum.accumulate(ends)
    new = np.flatnonzero(np.concatenate([[True], begins[1:] > reach[:-1]]))
    return np.stack([begins[new], np.concatenate([reach[new[1:] - 1], reach[-1:]])], axis=1).tolist()


def repeated_spans(docs: DataFrame, length: int = 100, most: int = 256, slice_bytes: int = 1 << 23, hot_runs: int = 20_000, chunk: int = 5_000) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans [begin, end)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    source = docs.select("doc_id", text.cast("binary").alias("bytes"), F.coalesce("doc_id", F.lit(_LOWEST)).alias("doc"))
    twice = source.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    named = None
    if not twice.isEmpty():  # number the documents anew, in their order
        key = docs.select(F.col("doc_id").alias("id"), F.md5(text).alias("sum"))
        named = runtime.stage(
            key.groupBy("id", "sum").agg(F.count(F.lit(1)).alias("rows")).repartitionByRange("id", "sum").sortWithinPartitions("id", "sum")
            .withColumn("doc", F.monotonically_increasing_id()), "named"
        )
        found = docs.select("doc_id", text.alias("text"), F.md5(text).alias("sum")).dropDuplicates(["doc_id", "sum"])
        source = runtime.stage(
            found.join(named.withColumnRenamed("sum", "sum_"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("sum") == F.col("sum_")))
            .select("doc_id", F.col("text").cast("binary").alias("bytes"), "doc"), "texts"
        )
    ranked = runtime.stage(_ranked(_runs_of(source, length, most, slice_bytes)), "ranked")
    open_ = ranked.filter("anchor IS NOT NULL")
    texts = runtime.stage(_with_text(source, open_, length), "open")
    hot = open_.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot_runs).select("anchor")
    marks = ranked.filter("anchor IS NULL").select("doc", "at")
    if hot.isEmpty():
        marks = marks.unionAll(_doubled_here(texts, length, chunk))
    else:
        hot = runtime.stage(hot, "hot")
        marks = marks.unionAll(_doubled_here(texts.join(hot, "anchor", "left_anti"), length, chunk))
        marks = marks.unionAll(_doubled(texts.join(hot, "anchor", "left_semi"), length))
    cut = _cut(source, marks.groupBy("doc").agg(F.collect_list("at").alias("at")), length)
    if named is not None:
        ids = named.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).select("doc", F.col("id").alias("doc_id"))
        cut = cut.join(ids, "doc")
    else:
        cut = cut.withColumn("doc_id", F.when(F.col("doc") != _LOWEST, F.col("doc")))
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256", "spans")
