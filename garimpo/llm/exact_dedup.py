"""Exact deduplication by content-defined chunk recipes.

A text is cut where a hash of the last eight bytes says so, so equal passages give equal
chunks. A chunk is named by a 128-bit hash, and one pass over the chunk contents, each
content moved once whatever the number of its copies, verifies that no name stands for two
contents; else all chunks are named anew under another key. From then on documents are
compared by their ordered lists of names alone.

Defined cases: a null text equals the empty text; rows that repeat a doc_id are rows of
their own with the same verdict; a null doc_id loses against any other; other columns,
whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garimpo import runtime

_RECIPE = "doc_id long, text_sha256 string, chunks array<binary>"
_CHUNK = "name binary, content binary"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _texts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a batch, and where each begins and ends."""
    texts = batch.column(batch.schema.get_field_index("text")).cast(pa.large_binary())
    texts = pc.fill_null(texts, b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return data, offsets


def _cuts(data: np.ndarray, bits: int) -> np.ndarray:
    """Ends of possible chunks: where the hash of the eight bytes before is below a bound."""
    if len(data) < 8:
        return np.empty(0, np.int64)
    words = np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1))
    words = np.ascontiguousarray(words).view(np.uint64).ravel()
    return np.flatnonzero((words * _MIX) >> np.uint64(64 - bits) == 0) + 8


def _chunks(data: np.ndarray, offsets: np.ndarray, bits: int, least: int, most: int) -> Iterator[list[int]]:
    """Per text: the borders of its chunks, its begin and end included."""
    found = np.concatenate([_cuts(part, bits) + at for at, part in _slices(data)]) if len(data) else np.empty(0, np.int64)
    first = np.searchsorted(found, offsets[:-1] + 8)
    last = np.searchsorted(found, offsets[1:])
    for begin, end, i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), first.tolist(), last.tolist(), strict=True):
        borders = [begin]
        for cut in found[i:j].tolist():
            while cut - borders[-1] > most:
                borders.append(borders[-1] + most)
            if cut - borders[-1] >= least:
                borders.append(cut)
        while end - borders[-1] > most:
            borders.append(borders[-1] + most)
        if end > borders[-1]:
            borders.append(end)
        yield borders


def _slices(data: np.ndarray, size: int = 1 << 22) -> Iterator[tuple[int, np.ndarray]]:
    """Overlapping slices, so that the words of a large batch never exist at once."""
    for at in range(0, len(data), size):
        yield at, data[at : at + size + 7]


def _named(docs: DataFrame, key: bytes, bits: int, least: int, most: int, recipes: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _texts(batch)
            view = memoryview(data)
            names: list[list[bytes]] = []
            sums: list[str] = []
            contents: list[bytes] = []
            for borders in _chunks(data, offsets, bits, least, most):
                parts = [view[a:b] for a, b in zip(borders, borders[1:], strict=False)]
                names.append([hashlib.blake2b(p, digest_size=16, key=key).digest() for p in parts])
                if recipes:
                    sums.append(hashlib.sha256(view[borders[0] : borders[-1]]).hexdigest())
                else:
                    contents.extend(map(bytes, parts))
            if recipes:
                ids = batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(sums, pa.string()), pa.array(names, pa.list_(pa.binary()))],
                    names=["doc_id", "text_sha256", "chunks"],
                )
            else:
                # copies inside the batch go no further
                once = list(set(zip((n for ns in names for n in ns), contents, strict=True)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n for n, _ in once], pa.binary()), pa.array([c for _, c in once], pa.binary())],
                    names=["name", "content"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, _RECIPE if recipes else _CHUNK)


def recipes(docs: DataFrame, bits: int = 10, least: int = 256, most: int = 16384, attempts: int = 4) -> DataFrame:
    """(doc_id, text_sha256, chunks): ordered verified chunk names of every row, stored.

    Chunks hold 2^bits bytes on average, `least` to `most` each.
    """
    spark = docs.sparkSession
    for attempt in range(attempts):
        key = b"chunk-%d" % attempt
        contents = _named(docs, key, bits, least, most, recipes=False).groupBy("name", "content").agg(F.count(F.lit(1)).alias("n"))
        clash = contents.groupBy("name").agg(F.count(F.lit(1)).alias("contents")).filter("contents > 1")
        if clash.isEmpty():
            return runtime.stage(_named(docs, key, bits, least, most, recipes=True), "recipes")
    raise RuntimeError("chunk names clash under every key")


def exact_groups(docs: DataFrame, **chunking: int) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of documents with equal recipes the one with the largest doc_id stays.
    """
    named = recipes(docs, **chunking)
    groups = (
        named.groupBy("chunks").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1")
    )
    # stored, so that only the join stands in its stage, and Spark can split a hot group
    groups = runtime.stage(groups, "groups")
    found = named.join(groups, "chunks", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256",
    )


SQL = """
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
