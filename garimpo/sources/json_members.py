"""Members of large JSON objects, read by many tasks.

Spark's text reader cuts a file into byte ranges and hands out the texts between closing
braces. Whether such a text begins inside a string, and how deep, only the text before
it tells. So ranges are read twice: first each tells what it does to either start
(outside or inside a string), which the driver chains, a few numbers for each range of a
file that has several; then each range cuts its texts where depth is back at the object's
members. A member over the border of ranges comes in parts, put together by their key.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

# a string, the group being its closing quote if it has one
_STRING = re.compile(rb'"[^"\\]*+(?:\\.[^"\\]*+)*+("?)', re.DOTALL)
_STRING_END = re.compile(rb'[^"\\]*+(?:\\.[^"\\]*+)*+"', re.DOTALL)
_WHERE = "file string, start long, size long, length long"
_SUMMARY = _WHERE + ", bytes long, blank boolean, in0 boolean, delta0 long, least0 long, in1 boolean, delta1 long, least1 long"
_PIECE = "file string, origin long, place long, whole boolean, opens boolean, closes boolean, sound boolean, part binary"
_NEVER = 1 << 60
_RUN = 1 << 16  # bytes of members read as one text
_BLANKS = " \t\n\r"
_SCHEMA = pa.schema([
    ("file", pa.string()), ("origin", pa.int64()), ("place", pa.int64()), ("whole", pa.bool_()),
    ("opens", pa.bool_()), ("closes", pa.bool_()), ("sound", pa.bool_()), ("part", pa.binary()),
])


def walk(text: bytes, inside: bool) -> tuple[bool, int]:
    """Is the end inside a string, and by how much the brackets of the text open more than they close."""
    if inside:
        end = _STRING_END.match(text)
        if end is None:
            return True, 0
        text = text[end.end():]
    bare, strings = _STRING.subn(rb"\1", text)
    return strings != bare.count(b'"'), bare.count(b"{") + bare.count(b"[") - bare.count(b"]")


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[bytes]]]:
    """Texts of each byte range of a task, in their order."""
    held = next(parts := _parts(batches), None)

    def of(where: tuple) -> Iterator[bytes]:
        nonlocal held
        while held is not None and held[0] == where:
            yield from held[1]
            held = next(parts, None)

    while held is not None:
        where = held[0]
        texts = of(where)
        yield where, texts
        for _ in texts:
            pass


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[bytes]]]:
    """Texts of one range in one batch; where they come from is read once, not for each text."""
    for batch in batches:
        texts = batch.column(0).cast(pa.large_binary())
        ends = sorted({end for i in (1, 2) for end in pc.run_end_encode(batch.column(i)).run_ends.to_pylist()})
        for start, end in zip([0, *ends], ends):
            yield tuple(batch.column(i)[start].as_py() for i in range(1, 5)), (text.as_py() for text in texts.slice(start, end - start))


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for where, texts in _ranges(batches):
        inside, delta, least, size, text = [False, True], [0, 0], [_NEVER, _NEVER], 0, b""
        for text in texts:
            size += len(text) + 1
            for s in (0, 1):
                inside[s], more = walk(text, inside[s])
                delta[s] += more - (not inside[s])
                if not inside[s]:
                    least[s] = min(least[s], delta[s])
        row = (*where, size, not text.strip(), inside[0], delta[0], least[0], inside[1], delta[1], least[1])
        names = [part.split()[0] for part in _SUMMARY.split(", ")]
        yield pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True))])


def _chained(found: list) -> dict[tuple[str, int], tuple]:
    """For each range of a file: (inside a string, depth, origin of its first text, last of the file, closing brace missing)."""
    starts: dict[tuple[str, int], tuple] = {}
    state, file = (False, 0, 0), None
    total = 0
    for i, r in enumerate(found):
        if r.file != file:
            file, state, total = r.file, (False, 0, r.start), 0
        inside, depth, origin = state
        last = i + 1 == len(found) or found[i + 1].file != file
        total += r.bytes
        starts[file, r.start] = (inside, depth, origin, last, last and _unclosed(total, r.size, r.blank))
        end, delta, least = (r.in1, r.delta1, r.least1) if inside else (r.in0, r.delta0, r.least0)
        state = (end, depth + delta, r.start if depth + least <= 1 else origin)
    return starts


def _unclosed(read: int, size: int, blank: bool) -> bool:
    """Does the file end without the brace that each text is read with? Packed files do if their end is blank."""
    return read - 1 == size if read in (size, size + 1) else blank


def _cutter(starts: dict[tuple[str, int], tuple]):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, start, size, _), texts in _ranges(batches):
            alone = (file, start) not in starts
            inside, depth, origin, last, unclosed = starts.get((file, start), (False, 0, start, True, False))
            first = start == 0  # nothing of the object lies before
            over, sound = depth == 0 and not first, True
            whole, ready, held, rows, weight, size_ready, read = first, [], [], [], 0, 0, 0
            text = next(texts, None)
            while text is not None:
                after = next(texts, None)
                read += len(text) + 1
                if alone and after is None:
                    unclosed = _unclosed(read, size, not text.strip())
                brace = not (last and after is None and unclosed)
                if over or not brace:  # blanks may follow the object, and nothing else
                    sound = sound and over and not brace and not text.strip()
                else:
                    inside, more = walk(text, inside)
                    depth += more - (not inside)
                    held.append(text + b"}")
                    weight += len(text)
                    if not inside and depth <= 1:
                        over = depth <= 0
                        ready += held
                        size_ready += sum(map(len, held))
                        if over or not whole or size_ready >= _RUN:
                            rows.append((file, origin, start, whole, first, over, depth >= 0, b"".join(ready)))
                            first, ready, size_ready = False, [], 0
                        origin, whole, held = start, True, []
                if weight > 1 << 22:
                    yield _batch(rows)
                    rows, weight = [], 0
                text = after
            if ready:
                rows.append((file, start, start, True, first, False, True, b"".join(ready)))
                first = False
            if last and not (sound and over) or not sound:
                rows.append((file, start, start, True, False, False, False, b""))
            elif held:
                rows.append((file, origin, start, False, first, False, True, b"".join(held)))
            yield _batch(rows)

    return cut


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(_SCHEMA)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)


def members(spark: SparkSession, path: str, kind: str = "map<string,variant>") -> DataFrame:
    """Columns ``file``, ``members`` (map of a run of members) and ``sound``, one row per run of each file.

    A file with a row that is not ``sound`` is no JSON object; one without any text has no row.
    A member that is an object ends a run once it has `_RUN` bytes, so a run is as large as that and one member.
    """
    meta = {"file": "file_path", "start": "file_block_start", "size": "file_size", "length": "file_block_length"}
    texts = spark.read.option("lineSep", "}").text(path).select(
        "value", *[F.col(f"_metadata.{field}").alias(name) for name, field in meta.items()]
    )
    several = texts.filter("length < size").mapInArrow(_summaries, _SUMMARY).collect()
    starts = _chained(sorted(several, key=lambda r: (r.file, r.start)))

    def pieces(of: DataFrame) -> DataFrame:
        return of.mapInArrow(_cutter(starts), _PIECE).withColumn("part", F.col("part").cast("string"))

    ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", "part"))), lambda p: p["part"])
    # a file of one range has no member over a border, and is not cut a second time for it
    over_borders = pieces(texts.filter("length < size")).filter("not whole").groupBy("file", "origin").agg(
        F.bool_or("opens").alias("opens"), F.bool_or("closes").alias("closes"),
        F.bool_and("sound").alias("sound"), F.array_join(ordered, "").alias("part"),
    )
    columns = ["file", "opens", "closes", "sound", F.ltrim(F.col("part"), F.lit(_BLANKS)).alias("part")]
    runs = pieces(texts).filter("whole").select(*columns).unionByName(over_borders.select(*columns))
    # `{` or a comma first, then at least one member, or the end of the object alone
    lead, rest = F.substr("part", F.lit(1), F.lit(1)), F.substr("part", F.lit(2))
    blank = F.btrim(rest, F.lit(_BLANKS)) == "}"
    shaped = F.when(F.col("opens"), lead == "{").otherwise(((lead == ",") & ~(F.col("closes") & blank)) | (F.col("closes") & (lead == "}") & (rest == "")))
    body = F.when(lead == "}", F.lit("{}")).otherwise(F.concat(F.lit("{"), rest, F.when(F.col("closes"), F.lit("")).otherwise(F.lit("}"))))
    read = F.from_json(F.when(F.col("sound") & shaped, body), kind)
    return runs.select("file", read.alias("members")).withColumn("sound", F.col("members").isNotNull())
