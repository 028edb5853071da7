"""The corpus queries, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from garimpo.llm import cover_tree, exact_dedup, language, mixing, ngram_join, packing, phrase_automata, prefix_trie, sharding, suffix_dedup, treap_search, warc, wrappers
from garimpo.llm.common import read_table

Query = Callable[[SparkSession, str], DataFrame]


def _over(table: str, operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(read_table(spark, sf_dir, table))


QUERIES: dict[str, Query] = {
    "op1_suffix_dedup": _over("documents", suffix_dedup.repeated_spans),
    "op2_cover_tree": _over("embeddings", cover_tree.near_pairs),
    "op3_exact_dedup": _over("documents", exact_dedup.exact_groups),
    "op4_language_id": _over("documents", language.predicted_languages),
    "op5_warc": _over("pages", warc.archived),
    "op6_sharding": _over("documents", sharding.balanced_shards),
    "op7_ngram_join": _over("documents", ngram_join.near_duplicates),
    "op8_mixing": _over("documents", mixing.mixed_documents),
    "op9_html_wrappers": _over("pages", wrappers.main_texts),
    "op10_packing": _over("documents", packing.packed_documents),
    "op11_prefix_trie": _over("conversations", prefix_trie.prefix_trie),
    "op12_phrase_automata": _over("documents", phrase_automata.removed_passages),
    "op13_k2_treap": lambda spark, sf_dir: treap_search.ranked(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")),
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {
    "op2_cover_tree": cover_tree.SQL,
    "op3_exact_dedup": exact_dedup.SQL,
    "op5_warc": warc.SQL,
    "op7_ngram_join": ngram_join.SQL,
    "op11_prefix_trie": prefix_trie.SQL,
    "op12_phrase_automata": phrase_automata.SQL,
    "op13_k2_treap": treap_search.SQL,
}
