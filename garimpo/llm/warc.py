"""WARC archives written and read by Spark, and their capture index merged by loser trees.

Pages become WARC/1.1 records in gzip files of the shared folder, written and committed by
Spark's text writer. Of records with equal payloads the one with the largest page_id is a
response; the others are revisits that refer to it and hold no payload. Reading parses the
files record by record; a task holds one record at a time, and each payload is checked
against its digest.

The index: captures of one archive file, sorted by URL key and time in that file's task, are a
run. Runs are cut into blocks at the borders of key ranges. A range's task gets its blocks in
the order of their first keys and merges them with a loser tree; a block is opened when the
merge reaches its first key, so at most one block of each run is in memory. Ranges are cut by
key, time and page_id together: a URL with most captures spreads over ranges.

Defined cases: a null html is an empty payload; a null url has no target and an empty key; a
null page_id is written without number, read back as null and referred to by nothing; rows
that repeat a page_id with equal payload are all responses if the largest page_id is theirs;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from garimpo import runtime
from garimpo.llm import common

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_EPOCH = 1577836800  # the pages have no time of their own: 2020-01-01 and a second for each page_id
_END = "\r\n\r\n"
_ENTRY = [
    ("url_key", pa.string()), ("captured", pa.int64()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
]
_ENTRY_DDL = "url_key string, captured long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32(hexadecimal: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hexadecimal: five digits are four letters."""
    letters = []
    for i in range(8):
        part = F.conv(F.substring(hexadecimal, 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.substr(F.lit(_ALPHABET), F.shiftright(part, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(value): the text of one WARC record for each page, without its closing blank lines."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("payload")
    ).withColumn("size", F.octet_length("payload").cast("long")).withColumn("key", F.sha2(F.col("payload").cast("binary"), 256))
    groups = runtime.stage(
        rows.filter(F.col("size") >= least_bytes).groupBy("key").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"),
        "payloads",
    )
    rows = rows.join(groups, "key", "left").withColumn("revisit", F.coalesce(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False)))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(_END))
    block = F.concat(http, F.when(F.col("revisit"), F.lit("")).otherwise(F.col("payload")))

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    number = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    time = F.date_format(F.timestamp_seconds(F.lit(_EPOCH) + F.coalesce("page_id", F.lit(0)) % 100_000_000_000), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    url = F.regexp_replace("url", "[\\x00-\\x20\\x7F]", "%20")
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), number, F.lit(">"))),
        line("WARC-Date", time),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.sha1(F.col("payload").cast("binary"))))),
        line("WARC-Payload-Length", F.col("size").cast("string")),
        F.when(F.col("revisit"), F.concat(
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">"))),
        )).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return rows.select(F.concat(head, block).alias("value"))


def write(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    records(pages, least_bytes).write.option("lineSep", _END).option("compression", "gzip").text(path)


def url_key(url: str | None) -> str:
    """Sort key of a URL: host from its top-level name down, then port, path and query in lower case."""
    if url is None:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return url.lower()
    host = re.sub(r"^www\d*\.", "", host)
    usual = {"http": 80, "https": 443}.get(parts.scheme.lower())
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port != usual else "") + ")" + (parts.path or "/")
    return (key + (f"?{parts.query}" if parts.query else "")).lower()


class Parser:
    """WARC records of one file from its lines, in order."""

    def __init__(self, file: str) -> None:
        self.file, self.head, self.block, self.missing = file, [], [], 0

    def feed(self, line: bytes) -> dict | None:
        if self.missing:
            # a line without its line feed; the block's last bytes may be only part of a line
            line += b"\n"
            self.block.append(line[: self.missing])
            self.missing -= len(self.block[-1])
            return None if self.missing else self._done()
        line = line.rstrip(b"\r")
        if line:
            self.head.append(line.decode())
        elif self.head:
            self.fields = {n.strip().lower(): v.strip() for n, _, v in (x.partition(":") for x in self.head[1:])}
            if not self.head[0].startswith("WARC/"):
                raise ValueError(f"no WARC record in {self.file}: {self.head[0][:80]}")
            self.head, self.missing = [], int(self.fields["content-length"])
            return None if self.missing else self._done()
        return None

    def _done(self) -> dict:
        block, self.block, fields = b"".join(self.block), [], self.fields
        _, _, payload = block.partition(b"\r\n\r\n")
        digest = fields["warc-payload-digest"].removeprefix("sha1:")
        kind = fields["warc-type"]
        if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"payload of {fields['warc-record-id']} in {self.file} does not match its digest")
        number = [n[len("<urn:page:") : -1] if (n := fields.get(k, "")) else "" for k in ("warc-record-id", "warc-refers-to")]
        page, first = (int(n) if n else None for n in number)
        return {
            "url_key": url_key(fields.get("warc-target-uri")), "captured": _EPOCH + (page or 0) % 100_000_000_000, "page_id": page,
            "payload_bytes": len(payload) if kind == "response" else int(fields["warc-payload-length"]),
            "payload_digest": digest, "record_type": kind, "refers_to": first,
        }


def captures(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives, with `run`, the file it is from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser, names = None, [n for n, _ in _ENTRY]
        for batch in batches:
            files = batch.column(1).to_pylist()
            found, runs = [], []
            for line, file in zip(batch.column(0).cast(pa.large_binary()), files, strict=True):
                if parser is None or parser.file != file:
                    parser = Parser(file)
                entry = parser.feed(line.as_py())
                if entry is not None:
                    found.append(entry)
                    runs.append(file)
            columns = [pa.array([e[n] for e in found], k) for n, k in _ENTRY]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(runs, pa.string())], names=[*names, "run"])

    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_name").alias("file"))
    return lines.mapInArrow(run, _ENTRY_DDL + ", run string")


class LoserTree:
    """Tournament with one leaf a run: inner nodes keep the loser, the root the winner.

    A leaf holds what is open of its run and, past that, `following`, the key at which the
    run goes on, so that it keeps its place while its next block is not there yet.
    """

    def __init__(self) -> None:
        self.leaf: dict[str, int] = {}
        self.open: list[list[tuple]] = []
        self.at: list[int] = []
        self.following: list[tuple | None] = []
        self.tree: list[int] = [-1]  # at 0 the winner
        self.leaves = 1
        self.key: list[tuple | None] = [None]  # of each leaf: its key and, for ties, its number

    def _read(self, s: int) -> None:
        entries, i = self.open[s], self.at[s]
        key = entries[i][:3] if i < len(entries) else self.following[s]
        self.key[s] = None if key is None else (*key, s)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.key[a], self.key[b]
        return y is None or (x is not None and x < y)

    def _play(self, s: int) -> None:
        """Replay the matches of a winner whose key has grown."""
        tree, beats = self.tree, self._beats
        node = (s + self.leaves) // 2
        while node:
            if beats(tree[node], s):
                tree[node], s = s, tree[node]
            node //= 2
        tree[0] = s

    def _build(self, leaves: int) -> None:
        self.leaves, self.tree = leaves, [-1] * leaves
        self.key += [None] * (leaves - len(self.key))
        for s in range(len(self.open)):
            self._read(s)
        winners = [*[-1] * leaves, *range(leaves)]
        for node in range(leaves - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.tree[node] = (a, b) if self._beats(a, b) else (b, a)
        self.tree[0] = winners[1]

    def _below(self, s: int, node: int) -> bool:
        place = s + self.leaves
        return place >> (place.bit_length() - node.bit_length()) == node

    def _enter(self, s: int) -> None:
        """Let a leaf that was empty play on from the match it lost."""
        if self.tree[0] == s:
            return
        node = (s + self.leaves) // 2
        while self.tree[node] != s:
            node //= 2
        while node:
            above = node // 2  # where the winner of that match lost, or the root
            while above and not self._below(self.tree[above], node):
                above //= 2
            if not self._beats(s, self.tree[above]):
                return
            self.tree[node], self.tree[above] = self.tree[above], s
            node = above

    def load(self, run: str, entries: list[tuple], following: tuple | None) -> None:
        """The next block of a run: its first key is the one the leaf stands at, or the leaf is new."""
        s = self.leaf.setdefault(run, len(self.open))
        if s < len(self.open):
            self.open[s], self.at[s], self.following[s] = self.open[s][self.at[s] :] + entries, 0, following
            self._read(s)
            return
        self.open.append(entries)
        self.at.append(0)
        self.following.append(following)
        if s >= self.leaves or s == 0:
            self._build(2 * self.leaves)
        else:
            self._read(s)
            self._enter(s)

    def peek(self) -> tuple | None:
        key = self.key[self.tree[0]] if self.open else None
        return None if key is None else key[:3]

    def waits(self) -> bool:
        """Is the winner's next entry in a block that is still to come?"""
        s = self.tree[0]
        return self.at[s] == len(self.open[s])

    def pop(self) -> tuple:
        s = self.tree[0]
        found = self.open[s][self.at[s]]
        self.at[s] += 1
        self._read(s)
        self._play(s)
        return found


def merged(blocks: Iterator[tuple[str, list[tuple], tuple | None]]) -> Iterator[tuple]:
    """Merge of the sorted blocks (run, entries, key of the run's next block), which come by their first keys."""
    tree = LoserTree()
    for run, entries, following in blocks:
        while (first := tree.peek()) is not None and first <= entries[0][:3] and not tree.waits():
            yield tree.pop()
        tree.load(run, entries, following)
    while tree.peek() is not None:
        yield tree.pop()


def _order(entry: dict) -> tuple:
    page = entry["page_id"]
    return entry["url_key"], entry["captured"], -(1 << 63) if page is None else page


def merged_index(found: DataFrame, block_rows: int = 2048, range_rows: int = 1 << 18, sample_rows: int = 10_000) -> DataFrame:
    """The captures with `range` and `place`: ordered by them, they are the histories of all URLs.

    Range borders come from a sample of about `sample_rows` captures; they decide how even
    the ranges are, not what is in them.
    """
    found = runtime.stage(found, "captures")
    total = found.count()
    ranges = common.blocks_for(total, range_rows)
    borders: list[tuple] = []
    if ranges > 1:
        lot = F.pmod(F.xxhash64("page_id", "url_key"), F.lit(1 << 30)) < int(min(1.0, sample_rows / total) * (1 << 30))
        keys = sorted(_order(r.asDict()) for r in found.filter(lot).select("url_key", "captured", "page_id").collect())
        borders = [keys[i * len(keys) // ranges] for i in range(1, ranges)] if keys else []
    names = [n for n, _ in _ENTRY]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        last = None
        for batch in batches:
            for entry in batch.to_pylist():
                here = (entry.pop("run"), bisect_right(borders, _order(entry)))
                if held and (here != last or len(held) >= block_rows):
                    yield _block(last, held, _order(entry) if here == last else None)
                    held = []
                last = here
                held.append(entry)
        if held:
            yield _block(last, held, None)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {"range": None, "next": None}

        def blocks(source: Iterator[dict]) -> Iterator[tuple[str, list[tuple], tuple | None]]:
            for row in source:
                if row["range"] != state["range"]:
                    state["next"] = row
                    return
                following = None if row["nk"] is None else (row["nk"], row["nt"], row["np"])
                yield row["run"], [(*_order(e), tuple(e[n] for n in names)) for e in row["entries"]], following

        def rows() -> Iterator[dict]:
            for batch in batches:
                for i in range(batch.num_rows):
                    yield batch.slice(i, 1).to_pylist()[0]

        source = rows()
        state["next"] = next(source, None)
        while state["next"] is not None:
            row, state["next"] = state["next"], None
            state["range"] = row["range"]
            out: list[tuple] = []
            place = 0

            for entry in merged(blocks(chain([row], source))):
                out.append(entry[3])
                if len(out) == 8192:
                    yield _placed(out, state["range"], place)
                    place, out = place + len(out), []
            if out:
                yield _placed(out, state["range"], place)

    def _placed(out: list[tuple], number: int, place: int) -> pa.RecordBatch:
        columns = [pa.array(c, k) for c, (_, k) in zip(zip(*out, strict=True), _ENTRY, strict=True)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([number] * len(out), pa.int32()), pa.array(range(place, place + len(out)), pa.int64())], names=[*names, "range", "place"])

    def _block(where: tuple, held: list[dict], following: tuple | None) -> pa.RecordBatch:
        keys = zip([*_order(held[0]), *(following or (None, None, None))], [pa.string(), pa.int64(), pa.int64()] * 2, strict=True)
        arrays = [
            pa.array([where[1]], pa.int32()), pa.array([where[0]], pa.string()), *[pa.array([v], kind) for v, kind in keys],
            pa.array([held], pa.list_(pa.struct(_ENTRY))),
        ]
        return pa.RecordBatch.from_arrays(arrays, names=["range", "run", "k", "t", "p", "nk", "nt", "np", "entries"])

    runs = found.sortWithinPartitions("run", "url_key", "captured", "page_id")
    blocks_ = runs.mapInArrow(cut, f"range int, run string, k string, t long, p long, nk string, nt long, np long, entries array<struct<{_ENTRY_DDL.replace(' ', ':').replace(',:', ',')}>>")
    dealt = blocks_.repartitionById(ranges, "range").sortWithinPartitions("range", "k", "t", "p")
    return dealt.mapInArrow(merge, _ENTRY_DDL + ", range int, place long")


def archived(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write the archives, read them back, merge their index: one row per page, in its order."""
    spark = pages.sparkSession
    path = runtime.new_folder(spark, "warc")
    write(pages, path, least_bytes)
    return merged_index(captures(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_DIGITS = "list_transform(range(8), lambda i: ('0x' || substr(sha1(p), 5 * i + 1, 5))::INTEGER)"
SQL = f"""
WITH pages_ AS (SELECT page_id, coalesce(html, '') AS p FROM pages),
grouped AS (
  SELECT page_id, p, max(page_id) OVER (PARTITION BY p) AS first, count(*) OVER (PARTITION BY p) AS n FROM pages_
)
SELECT page_id, octet_length(encode(p)) AS payload_bytes,
  array_to_string(list_transform(flatten(list_transform({_DIGITS}, lambda v: [v >> 15 & 31, v >> 10 & 31, v >> 5 & 31, v & 31])),
    lambda c: substr('{_ALPHABET}', c::INTEGER + 1, 1)), '') AS payload_digest,
  CASE WHEN n > 1 AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n > 1 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM grouped
"""
