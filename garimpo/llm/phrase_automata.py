"""Removal of repeated passages of words, located by sharded Aho-Corasick automata.

Wanted: every word that lies in a window of `width` words which also starts earlier.

1. Phrases. The hash of each `PHRASE` words names a phrase, and the least phrase of a window is
   its anchor, chosen by its content alone: equal windows have one anchor at one place.
   Consecutive windows with one anchor form a run, `most` windows at most. A phrase that
   anchors one run only is no repeated phrase, and its windows drop out.
2. Confirmation. The runs of a repeated phrase meet, sorted by their text's name: of equal runs
   the earliest goes on for all of them, as each later one repeats it whole. Only those that
   go on, if their phrase has two texts or stands twice in one, travel with their words.
3. Automata. Phrases are dealt to shards by their hash. A shard takes whole phrases until it
   holds `shard_words` words, confirms the windows that recur in it, compiles them to one
   automaton (keys are sequences of word numbers) and streams the passages of all documents
   through it in the order of the corpus: the first occurrence of a window stays, each later
   one is removed. Equal windows share their anchor, so no occurrence lies in another shard.
   A phrase with more than `hot_runs` texts is no single shard: its windows are dealt
   one by one, by their own hash, and go through the same automata.

A run is named by the 64-bit hashes of its phrase and of its text together; what the automata
say is exact, as they compare the words themselves.

Defined cases: a null text has no words; texts of fewer than `width` words lose nothing; a
repeated doc_id: its rows are taken one after the other in the order of the MD5 sums of their
texts, equal rows being one document whose result is repeated; a null doc_id comes before all
others; other columns, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garimpo import runtime
from garimpo.llm import shingles

PHRASE = 8
_INNER = 1 << 15
_LOWEST = -(1 << 63)
_RUN = "doc long, at long, anchor long, name long"
_JUDGED = "doc long, at long, anchor long"
_PIECE = "anchor long, doc long, at long, words binary"


def _columns(names: str, *values: np.ndarray | pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in values], names=names.split())


def _extreme(values: np.ndarray, span: int, pick: np.ufunc) -> np.ndarray:
    """`pick` over each `span` neighbours, by doubling."""
    width = 1
    while 2 * width <= span:
        values = pick(values[:-width], values[width:])
        width *= 2
    rest = span - width
    return pick(values[: len(values) - rest], values[rest:]) if rest else values


def _runs(texts: list[bytes], width: int, most: int) -> tuple[np.ndarray, ...] | None:
    """Text number, packed place, anchor and name of all runs of a slice of texts.

    A place packs the first window's number, _INNER if the anchor may stand twice in the run
    (only then a run can repeat within itself), and the number of windows.
    """
    data = np.frombuffer(b" ".join(texts), np.uint8)
    words, begins = shingles._word_hashes(data)
    if len(words) < width:
        return None
    span = width - PHRASE + 1
    phrases = np.zeros(len(words) - PHRASE + 1, np.uint64)
    for i in range(PHRASE):
        phrases += words[i : i + len(phrases)] * shingles._PLACE[i]
    phrases = shingles.mixed(phrases)
    anchor = _extreme(phrases, span, np.minimum)
    border = np.searchsorted(begins, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    text_of = np.repeat(np.arange(len(texts)), np.diff(border))
    window = np.flatnonzero(text_of[: len(anchor)] == text_of[width - 1 :])  # those inside one text
    if not len(window):
        return None
    new = np.ones(len(window), bool)
    new[1:] = (np.diff(window) > 1) | (anchor[window[1:]] != anchor[window[:-1]]) | (text_of[window[1:]] != text_of[window[:-1]])
    first = np.flatnonzero(new)
    inside = np.arange(len(window)) - np.repeat(first, np.diff([*first, len(window)]))
    first = np.flatnonzero(inside % most == 0)
    starts, counts = window[first], np.diff([*first, len(window)])
    # a phrase is an anchor somewhere if the greatest anchor of the windows around it is the phrase
    edge = np.zeros(span - 1, np.uint64)
    chosen = np.flatnonzero(phrases == _extreme(np.concatenate([edge, anchor, edge]), span, np.maximum))
    twice = np.concatenate([[0], np.cumsum(phrases[chosen[1:]] == phrases[chosen[:-1]]), [0]])
    low, high = np.searchsorted(chosen, starts), np.searchsorted(chosen, starts + counts + span - 1) - 1
    inner = twice[np.maximum(low, high)] > twice[low]
    bits = max(10, len(words).bit_length())
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * shingles._powers(bits, False)[: len(words)], out=sums[1:])
    length = counts + width - 1
    name = shingles.mixed((sums[starts + length] - sums[starts]) * shingles._powers(bits, True)[starts] + length.astype(np.uint64))
    return text_of[starts], (starts - border[text_of[starts]]) << 16 | inner * _INNER | counts, anchor[starts], name


def _found_runs(docs: DataFrame, width: int, most: int, slice_bytes: int) -> DataFrame:
    """Runs of (doc, bytes). `anchor` is null for a run whose text starts earlier in its slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = np.argsort(batch.column(0).to_numpy(), kind="stable")
            sizes = np.cumsum([len(batch.column(1)[i].as_buffer()) for i in order.tolist()])
            for piece in np.split(order, np.flatnonzero(np.diff(sizes // slice_bytes)) + 1):
                found = _runs([batch.column(1)[i].as_py() for i in piece.tolist()], width, most)
                if found is None:
                    continue
                text, at, anchor, name = found
                doc = batch.column(0).to_numpy()[piece][text]
                by = np.lexsort((name, anchor))  # stable: the earliest of equal runs comes first
                again = np.zeros(len(by), bool)
                again[by[1:]] = (name[by[1:]] == name[by[:-1]]) & (anchor[by[1:]] == anchor[by[:-1]])
                yield _columns("doc at anchor name", doc, at, pa.array(anchor.view(np.int64), mask=again), name.view(np.int64))

    return docs.select("doc", "bytes").mapInArrow(run, _RUN)


def _judged(runs: DataFrame) -> DataFrame:
    """Runs repeated whole (anchor null), and the earliest of each text of a repeated phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # anchor and name of the row before
        waiting: tuple | None = None  # the latest first of a text: doc, at, anchor, whether it goes on
        for batch in batches:
            if not batch.num_rows:
                continue
            doc, at, name = (batch.column(i).to_numpy() for i in (0, 1, 3))
            passed = batch.column(2).is_null().to_numpy(zero_copy_only=False)
            yield _columns("doc at anchor", doc[passed], at[passed] & ~_INNER, pa.nulls(int(passed.sum()), pa.int64()))
            doc, at, name, anchor = doc[~passed], at[~passed], name[~passed], batch.column(2).drop_null().to_numpy()
            if not len(doc):
                continue
            new = np.ones(len(doc), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (name[1:] != name[:-1])
            new[0] = last != (anchor[0], name[0])
            last = (anchor[-1], name[-1])
            yield _columns("doc at anchor", doc[~new], at[~new] & ~_INNER, pa.nulls(int((~new).sum()), pa.int64()))
            doc, at, anchor = doc[new], at[new], anchor[new]
            goes_on = (at & _INNER) > 0
            if waiting:
                doc, at, anchor = np.append(waiting[0], doc), np.append(waiting[1], at), np.append(waiting[2], anchor)
                goes_on = np.append(waiting[3], goes_on)
            if len(doc):
                same = anchor[1:] == anchor[:-1]
                goes_on[1:] |= same
                goes_on[:-1] |= same
                waiting = (doc[-1], at[-1], anchor[-1], goes_on[-1])
                told = np.flatnonzero(goes_on[:-1])
                yield _columns("doc at anchor", doc[told], at[told] & ~_INNER, anchor[told])
        if waiting and waiting[3]:
            yield _columns("doc at anchor", np.array([waiting[0]]), np.array([waiting[1] & ~_INNER]), np.array([waiting[2]]))

    part = F.coalesce("anchor", "name")  # copies found on the map side only pass through
    dealt = runs.withColumn("part", part).repartition("part").select("doc", "at", "anchor", "name")
    return dealt.sortWithinPartitions("anchor", "name", "doc", "at").mapInArrow(run, _JUDGED)


def _packed(docs: DataFrame) -> DataFrame:
    """(doc, packed): compressed texts, as they travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            yield _columns("doc packed", batch.column(0), pa.array([tool.compress(v.as_buffer()) for v in batch.column(1)], pa.binary()))

    return docs.select("doc", "bytes").mapInArrow(run, "doc long, packed binary")


def _unpacked(value: pa.Scalar) -> bytes:
    return zstandard.decompress(value.as_py()) if value.as_py() else b""


def _pieces(docs: DataFrame, runs: DataFrame, width: int) -> DataFrame:
    """The runs of a repeated phrase with their words, one space between them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words = _unpacked(batch.column(1)[i]).split()
                runs = batch.column(2)[i].values
                at = runs.field("at")
                parts = [b" ".join(words[x >> 16 : (x >> 16) + (x & 0xFFFF) + width - 1]) for x in at.to_pylist()]
                doc = np.full(len(at), batch.column(0)[i].as_py(), np.int64)
                yield _columns("anchor doc at words", runs.field("anchor"), doc, at, pa.array(parts, pa.binary()))

    wanted = runs.groupBy("doc").agg(F.collect_list(F.struct("at", "anchor")).alias("runs"))
    return _packed(docs).join(wanted, "doc").select("doc", "packed", "runs").mapInArrow(run, _PIECE)


def _single_windows(pieces: DataFrame, width: int) -> DataFrame:
    """Each window of the pieces as a piece of its own, dealt by its own hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(batch.num_rows):
                doc, at = batch.column(1)[a].as_py(), batch.column(2)[a].as_py()
                words = batch.column(3)[a].as_py().split()
                parts = [b" ".join(words[i : i + width]) for i in range(at & 0xFFFF)]
                hashes, _ = shingles._word_hashes(np.frombuffer(batch.column(3)[a].as_py(), np.uint8))
                key = _fingerprints(hashes, width).view(np.int64)
                places = ((at >> 16) + np.arange(len(parts))) << 16 | 1
                yield _columns("anchor doc at words", key, np.full(len(parts), doc, np.int64), places, pa.array(parts, pa.binary()))

    return pieces.mapInArrow(run, _PIECE)


def _fingerprints(numbers: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros(max(0, len(numbers) - width + 1), np.uint64)
    for i in range(width):
        out += numbers[i : i + len(out)] * shingles._PLACE[i]
    return shingles.mixed(out)


def _later_windows(pieces: list[bytes], counts: np.ndarray, width: int) -> list[tuple[int, int]]:
    """(piece, window in it) of all windows that also stand earlier in the pieces, which are in
    the order of the corpus: one automaton of the windows that recur, and one pass through it."""
    split = [p.split() for p in pieces]
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for words in split for w in words], np.uint64)
    ends = np.cumsum(counts + width - 1)
    starts = ends - counts - width + 1
    spread = shingles.mixed(ids + np.uint64(1))
    place = np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    names = _fingerprints(spread, width)[place]
    _, first, times = np.unique(names, return_index=True, return_counts=True)
    recurring = place[first[times > 1]]
    if not len(recurring):
        return []
    ids = ids.astype(np.int64)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for k, at in enumerate(recurring.tolist()):
        automaton.add_word(tuple(ids[at : at + width].tolist()), k)
    automaton.make_automaton()
    seen = bytearray(len(recurring))
    out = []
    for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        for end, k in automaton.iter(tuple(ids[a:b].tolist())):
            if seen[k]:
                out.append((i, end - width + 1))
            seen[k] = 1
    return out


def _located(pieces: DataFrame, width: int, shard_words: int) -> DataFrame:
    """(doc, at) of the windows that also start earlier."""

    def shard(held: pa.Table) -> Iterator[pa.RecordBatch]:
        at = held.column(2).to_numpy()
        found = _later_windows(held.column(3).to_pylist(), at & 0xFFFF, width)
        if found:
            piece, inside = np.array(found, np.int64).T
            yield _columns("doc at", held.column(1).to_numpy()[piece], ((at[piece] >> 16) + inside) << 16 | 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                anchor = part.column(0).to_numpy()
                if size >= shard_words and held:
                    # whole phrases only: what goes on with the last one still belongs to this shard
                    last = held[-1].column(0)[-1].as_py()
                    border = int(np.searchsorted(anchor != last, True))
                    held.append(part.slice(0, border))
                    if border < len(anchor):
                        yield from shard(pa.Table.from_batches([h for h in held if h.num_rows]))
                        held, size, part = [], 0, part.slice(border)
                    else:
                        continue
                if part.num_rows:
                    held.append(part)
                    size += int((part.column(2).to_numpy() & 0xFFFF).sum()) + part.num_rows * (width - 1)
        if held:
            yield from shard(pa.Table.from_batches([h for h in held if h.num_rows]))

    return pieces.repartition("anchor").sortWithinPartitions("anchor", "doc", "at").mapInArrow(run, "doc long, at long")


def removed_words(n_words: int, marks: np.ndarray, width: int) -> list[list[int]]:
    """Maximal stretches [begin, end) of words that marked windows cover."""
    if not len(marks):
        return []
    marks = np.sort(marks)
    begins, reach = marks >> 16, np.maximum.accumulate((marks >> 16) + (marks & 0xFFFF) + width - 1)
    new = np.flatnonzero(np.concatenate([[True], begins[1:] > reach[:-1]]))
    return np.stack([begins[new], np.concatenate([reach[new[1:] - 1], reach[-1:]])], axis=1).tolist()


def _cut(docs: DataFrame, marks: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [])
            for i in range(batch.num_rows):
                words = _unpacked(batch.column(1)[i]).split()
                marked = batch.column(2)[i].values
                spans = removed_words(len(words), marked.to_numpy() if marked is not None else np.empty(0, np.int64), width)
                kept, at = [], 0
                for a, b in spans:
                    kept += words[at:a]
                    at = b
                for column, value in zip(rows, (len(words), sum(b - a for a, b in spans), spans, b" ".join(kept + words[at:])), strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.binary()]
            made = [pa.array(c, k) for c, k in zip(rows, kinds, strict=True)]
            yield _columns("doc n_words n_removed spans kept_text", batch.column(0), *made[:3], made[3].cast(pa.string()))

    return _packed(docs).join(marks, "doc", "left").select("doc", "packed", "at").mapInArrow(
        run, "doc long, n_words long, n_removed long, spans array<array<bigint>>, kept_text string"
    )


def without_repeats(
    docs: DataFrame, width: int = 20, most: int = 64, slice_bytes: int = 1 << 22, hot_runs: int = 5_000, shard_words: int = 200_000
) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, spans [begin, end) of words, kept_text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    source = docs.select("doc_id", text.cast("binary").alias("bytes"), F.coalesce("doc_id", F.lit(_LOWEST)).alias("doc"))
    named = None
    if not source.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        # number the documents anew, in their order
        key = docs.select(F.col("doc_id").alias("id"), F.md5(text).alias("sum"))
        named = runtime.stage(
            key.groupBy("id", "sum").agg(F.count(F.lit(1)).alias("rows")).repartitionByRange("id", "sum")
            .sortWithinPartitions("id", "sum").withColumn("doc", F.monotonically_increasing_id()), "named"
        )
        once = docs.select("doc_id", text.alias("text"), F.md5(text).alias("md5")).dropDuplicates(["doc_id", "md5"])
        source = runtime.stage(
            once.join(named, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("md5") == F.col("sum")))
            .select("doc_id", F.col("text").cast("binary").alias("bytes"), "doc"), "texts"
        )
    judged = runtime.stage(_judged(_found_runs(source, width, most, slice_bytes)), "judged")
    open_ = judged.filter("anchor IS NOT NULL")
    pieces = runtime.stage(_pieces(source, open_, width), "pieces")
    marks = judged.filter("anchor IS NULL").select("doc", "at")
    hot = runtime.stage(open_.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot_runs).select("anchor"), "hot")
    if not hot.isEmpty():
        single = _single_windows(pieces.join(hot, "anchor", "left_semi").select(*pieces.columns), width)
        pieces = pieces.join(hot, "anchor", "left_anti").select(*pieces.columns).unionAll(single)
    marks = marks.unionAll(_located(pieces, width, shard_words))
    cut = _cut(source, marks.groupBy("doc").agg(F.collect_list("at").alias("at")), width)
    if named is not None:
        ids = named.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).select("doc", F.col("id").alias("doc_id"))
        cut = cut.join(ids, "doc")
    else:
        cut = cut.withColumn("doc_id", F.when(F.col("doc") != _LOWEST, F.col("doc")))
    return cut.select("doc_id", "n_words", "n_removed", "spans", "kept_text")


def removed_passages(docs: DataFrame, **options: int) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, spans of `without_repeats`."""
    found = without_repeats(docs, **options)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"), "spans")


SQL = r"""
WITH word AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents)
), passage AS (
  SELECT doc_id, pos, word, string_agg(word, ' ') OVER w AS words, count(*) OVER w AS n
  FROM word WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)
), judged AS (
  SELECT doc_id, pos, word, n = 20 AND row_number() OVER (PARTITION BY words, n ORDER BY doc_id, pos) > 1 AS again FROM passage
), covered AS (
  SELECT doc_id, pos, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone
  FROM judged
), counted AS (
  SELECT doc_id, count(*) AS n_words, count_if(gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept,
         list(pos - 1 ORDER BY pos) FILTER (gone) AS places
  FROM covered GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256,
       list_transform(
         list_filter(coalesce(places, []), lambda p: NOT list_contains(places, p - 1)),
         lambda p: [p, list_min(list_filter(places, lambda q: q >= p AND NOT list_contains(places, q + 1))) + 1]
       ) AS spans
FROM documents LEFT JOIN counted USING (doc_id)
"""
