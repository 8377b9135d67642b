"""One query per operator over the given tables, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pairflow.llm import (align, byte_bpe, decontaminate, html_text, lattice_lm, licenses, parity_join, prefix_trie, secrets,
                          token_counts, toxicity, url_filter, vector_graph)
from pairflow.llm.oracle import ORACLE  # noqa: F401

# The rules of the url filter's query: action, host, path.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/")]
# Hosts that are blocked where no rule fits.
URL_BLOCKLIST = [f"{name}.example.{end}" for end in ("com", "net", "org")
                 for name in ("ads-track", "free-bets", "cheap-pills", "spam-farm", "casino-win", "adult-x")]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_decontamination(spark, d):
    return decontaminate.search(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query
def op2_toxicity(spark, d):
    docs = table(spark, d, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, d, "labels")))


@query
def op3_ngram_jaccard_join(spark, d):
    return parity_join.join(table(spark, d, "documents"))


@query
def op4_byte_bpe(spark, d):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.digests(table(spark, d, "documents"), path, public_tokenizers.PATTERN)


@query
def op5_url_filter(spark, d):
    return url_filter.judge(table(spark, d, "pages"), URL_RULES, URL_BLOCKLIST)


@query
def op6_license_scan(spark, d):
    return licenses.scan(table(spark, d, "documents"))


@query
def op7_secret_scan(spark, d):
    return secrets.scan(table(spark, d, "documents"))


@query
def op8_vector_graph(spark, d):
    return vector_graph.search(table(spark, d, "embeddings"))


@query
def op9_token_counts(spark, d):
    return token_counts.counts(table(spark, d, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op10_html_text(spark, d):
    return html_text.extract(table(spark, d, "pages"))


@query
def op11_prefix_trie(spark, d):
    return prefix_trie.build(table(spark, d, "conversations"))


@query
def op12_lattice_lm(spark, d):
    return lattice_lm.score(table(spark, d, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op13_token_alignment(spark, d):
    paths = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return align.align(table(spark, d, "documents"), *paths)
