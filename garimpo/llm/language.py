"""Language identification by compression with per-language zstandard dictionaries.

A language is a raw-content dictionary: passages of labelled documents. A text is encoded
in lower case, block by block, with every dictionary; the language whose dictionary makes it
smallest wins. Matches of four bytes count, found by a lazy search: short ones tell languages
apart that share an alphabet. A text of up to `short` bytes is encoded behind a carrier that
ends every dictionary, as a block too small to gain anything would be stored as it is, and
with matches of three bytes.
The score is the share of bytes saved against the second best; a margin below `min_margin`
marks the text as rejected.

Fitting takes a bounded sample: about `sample_docs` documents a language, `sample_chars`
characters of each, `dictionary_bytes` in all. The counts that set the sampling rate cover
all documents. Prediction reads every byte of every text and nothing but the text.

Dictionaries are a table. Languages are dealt to passes of about `per_pass`; a pass sends its
dictionaries alone to the tasks and carries the two smallest sizes a text has had so far. Up
to `per_pass` languages are one pass; with more, the rows are stored between passes.

Defined cases: a null text or one without a letter is `und` with score 0 and rejected; equal
sizes go to the language with more training documents, then to the first by name; rows that
repeat a doc_id are rows of their own; without training rows everything is `und`; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garimpo import runtime
from garimpo.llm import common

LETTER = regex.compile(r"\p{L}")
SEARCH = {"window_log": 17, "chain_log": 16, "hash_log": 16, "search_log": 3, "min_match": 4, "target_length": 16, "strategy": zstandard.STRATEGY_LAZY2}
FINE = SEARCH | {"min_match": 3, "strategy": zstandard.STRATEGY_BTLAZY2}
# of the dictionaries tried so far: the smallest size, its language with its training rows, and the size next to it
HELD = pa.struct([("size", pa.int64()), ("n", pa.int64()), ("lang", pa.string()), ("second", pa.int64())])
CARRIER = hashlib.sha512(b"carrier").hexdigest().encode() * 2


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds == 0


def dictionaries(
    train: DataFrame, sample_docs: int = 400, sample_chars: int = 1000, dictionary_bytes: int = 1 << 16, per_pass: int = 64
) -> DataFrame:
    """(lang, n, content, pass), stored: a row a language, with its number of training rows."""
    counts = runtime.stage(train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    passes = common.blocks_for(counts.count(), per_pass)
    span = float(1 << 63)
    rate = F.lit(float(sample_docs)) / F.col("n")
    bound = F.when(F.col("n") > sample_docs, (rate * span * 2 - span).cast("long") - 1).otherwise(F.lit((1 << 63) - 1))
    # texts that share a doc_id are drawn one by one, equal rows count once
    rows = train.select("lang", F.xxhash64("doc_id", "text").alias("o"), F.substring("text", 1, sample_chars).alias("t"))
    rows = rows.join(counts, "lang").filter(F.col("o") <= bound).groupBy("lang", "o").agg(F.first("t").alias("t"))
    # a group is the sample of a language: about sample_docs x sample_chars characters
    parts = F.transform(F.array_sort(F.collect_list(F.struct("o", "t"))), lambda x: x["t"])
    texts = rows.groupBy("lang").agg(F.array_join(parts, "\n").alias("joined"))
    content = F.coalesce(F.substring("joined", -dictionary_bytes, dictionary_bytes), F.lit(""))
    turn = F.pmod(F.xxhash64("lang"), F.lit(passes))
    return runtime.stage(counts.join(texts, "lang", "left").select("lang", "n", content.alias("content"), turn.alias("pass")), "dictionaries")


def _loaded(dicts: DataFrame, turn: int, dictionary_bytes: int = 1 << 16) -> list[tuple[str, int, bytes]]:
    """The dictionaries of one pass: about `per_pass` of at most `dictionary_bytes`."""
    return [(r["lang"], r["n"], r["content"].lower().encode()[-dictionary_bytes:]) for r in dicts.filter(F.col("pass") == turn).collect()]


def _encoder(content: bytes, search: dict[str, int]) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters(**search, write_content_size=0, write_checksum=0, write_dict_id=0)
    data.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=data, compression_params=how)


def _tools(dicts: list[tuple[str, int, bytes]]) -> list[tuple]:
    return [(lang, n, _encoder(content + CARRIER, SEARCH), _encoder(content + CARRIER, FINE)) for lang, n, content in dicts]


def _tried(text: str, held: dict | None, tools: list[tuple], block: int, short: int) -> dict | None:
    """`held` after the dictionaries of `tools`; equal sizes go to the language with more rows, then by name."""
    raw = text.lower().encode()
    sizes = []
    if held is not None:
        sizes.append((held["size"], -held["n"], held["lang"]))
        if held["second"] is not None:
            sizes.append((held["second"], 1, ""))  # of this one only the size counts
    for lang, n, coarse, fine in tools:
        if len(raw) <= short:
            size = len(fine.compress(CARRIER + raw))
        else:
            size = sum(len(coarse.compress(raw[a : a + block])) for a in range(0, len(raw), block))
        sizes.append((size, -n, lang))
    if not sizes:
        return None
    sizes.sort()
    (size, n, lang), rest = sizes[0], sizes[1:2]
    return {"size": size, "n": -n, "lang": lang, "second": rest[0][0] if rest else None}


def _after(batch: pa.RecordBatch, text: int, held: int | None, tools: list[tuple], block: int, short: int) -> list[dict | None]:
    before = batch.column(held).to_pylist() if held is not None else [None] * batch.num_rows
    values = (t.as_py() for t in batch.column(text))
    return [None if v is None or not LETTER.search(v) else _tried(v, h, tools, block, short) for v, h in zip(values, before, strict=True)]


def _verdict(held: dict | None, min_margin: float) -> tuple[str, float, bool]:
    if held is None:
        return "und", 0.0, True
    score = 1.0 if held["second"] is None else (held["second"] - held["size"]) / held["second"]
    return held["lang"], score, score < min_margin


def _but_last(docs: DataFrame, dicts: DataFrame, block: int, short: int) -> tuple[DataFrame, int | None, list[tuple[str, int, bytes]]]:
    """`docs` after all passes but the last, the place of the column they leave behind, and the
    dictionaries of the last. With one pass, `docs` as they are."""
    spark, text = docs.sparkSession, docs.columns.index("text")
    turns = sorted(r["pass"] for r in dicts.select("pass").distinct().collect())
    at, path, name = None, None, "held"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    for turn in turns[:-1]:
        shared = spark.sparkContext.broadcast(_loaded(dicts, turn))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, at=at) -> Iterator[pa.RecordBatch]:
            tools = _tools(shared.value)
            for batch in batches:
                held = pa.array(_after(batch, text, at, tools, block, short), HELD)
                columns = batch.columns if at is None else batch.columns[:-1]
                names = batch.schema.names if at is None else batch.schema.names[:-1]
                yield pa.RecordBatch.from_arrays([*columns, held], names=[*names, name])

        if at is None:
            schema = docs.select("*", F.lit(None).cast("struct<size:bigint,n:bigint,lang:string,second:bigint>").alias(name)).schema
        before, path = path, runtime.new_folder(spark, "held")
        docs = runtime.stage_at(docs.mapInArrow(run, schema), path)
        if before:
            runtime.drop_folder(spark, before)
        shared.unpersist()
        at = len(docs.columns) - 1
    return docs, at, _loaded(dicts, turns[-1]) if turns else []


def classify(docs: DataFrame, dicts: DataFrame, block: int = 2048, short: int = 512, min_margin: float = 0.002) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row of `docs` (doc_id, text)."""
    rows, at, last = _but_last(docs.select("doc_id", "text"), dicts, block, short)
    shared = docs.sparkSession.sparkContext.broadcast(last)  # bounded: one pass

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = _tools(shared.value)
        for batch in batches:
            found = [_verdict(h, min_margin) for h in _after(batch, 1, at, tools, block, short)]
            langs, scores, refused = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(refused, pa.bool_())],
                names=["doc_id", "lang_pred", "score", "rejected"],
            )

    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, dicts: DataFrame, block: int = 2048, short: int = 512, min_margin: float = 0.002) -> DataFrame:
    """The rows of `docs`, all columns, whose text is clearly in one language; no row is moved."""
    schema, text = docs.schema, docs.columns.index("text")
    rows, at, last = _but_last(docs, dicts, block, short)
    shared = docs.sparkSession.sparkContext.broadcast(last)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = _tools(shared.value)
        for batch in batches:
            found = [_verdict(h, min_margin) for h in _after(batch, text, at, tools, block, short)]
            kept = batch.filter(pa.array([not refused for _, _, refused in found], pa.bool_()))
            yield kept if at is None else kept.select(list(range(at)))

    return rows.mapInArrow(run, schema)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())


def predicted_languages(docs: DataFrame, **options: float) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, rejected."""
    found = classify(docs, dictionaries(training_rows(docs)), **options)
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
