"""Benchmark decontamination: MinHash containment search of short items in long documents.

An item's sketch holds the k smallest of its n shingle hashes in a random order (bottom-k MinHash), with
k = n - ceil(t n) + 1. A document that contains a share t of the item lacks at most k - 1 of its shingles, so it
has at least one of the k: the search misses nothing at any document length, where comparing MinHash
signatures of both sides would lose short items in long texts. Items are partitioned by size: a class (powers
of two) has its own k and its own largest sketch hash, and document shingles above the largest of all are not
looked up. The lookup is a Bloom filter of the sketches, of bounded size; what passes meets the sketches in a
join, and candidate pairs are verified by exact containment of the shingles' text.

Results for odd input: items without words (null or blank text) match nothing; an item of 1 to 4 words has its
whole sequence as one shingle and matches only documents that are that sequence; repeated documents get a row
each, repeated item rows count once; a null id stays null. Only the named columns are read.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairflow.llm import bloom, keys, textkit
from pairflow.llm.parity_join import node_key
from pairflow.workspace import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_ITEM = "item_id long, item_text string, item_key long, size_class int, sketch array<long>"
_HIT = "doc_id long, text string, doc_key long, found array<long>"


def sketch_length(n: int, percent: int) -> int:
    """k such that containing percent of n shingles means containing one of any k."""
    return n - -(-n * percent // 100) + 1


def _order(hashes: np.ndarray) -> np.ndarray:
    return textkit.mix(hashes ^ np.uint64(0x9FB21C651E98DF25))


def _sketches(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = []
            for item, text, shingles in zip(ids, texts, textkit.shingle_sets(textkit.text_bytes(batch.column(1)))):
                n = len(shingles)
                if n:
                    sketch = np.sort(_order(shingles))[:sketch_length(n, percent)]
                    rows.append((item, text, node_key(shingles), n.bit_length(), sketch.view(np.int64)))
            columns = list(zip(*rows)) or [[]] * 5
            types = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)],
                names=["item_id", "item_text", "item_key", "size_class", "sketch"])
    return run


def _lookups(held, highest: int):
    """Documents with shingles that the filter may hold, and those shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, keys, found = [], [], []
            for i, shingles in enumerate(textkit.shingle_sets(textkit.text_bytes(batch.column(1)))):
                order = _order(shingles)
                order = order[order <= np.uint64(highest)]
                order = order[bloom.contains(held.value, order)]
                if len(order):
                    keep.append(i)
                    keys.append(node_key(shingles))
                    found.append(order.view(np.int64))
            rows = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1).cast(pa.string()), pa.array(keys, pa.int64()),
                 pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "text", "doc_key", "found"])
    return run


def text_shingles(text: bytes) -> set[bytes]:
    words = _WORD.findall(text.lower())  # bytes.lower() changes A-Z only
    w = textkit.WIDTH
    return {b" ".join(words[i:i + w]) for i in range(max(1, len(words) - w + 1))} if words else set()


def _contained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        last, have, sizes, shared = None, set(), [], []
        for item, text in zip(textkit.text_bytes(batch.column(2)), textkit.text_bytes(batch.column(3))):
            if text is not last:
                last, have = text, text_shingles(text)
            wanted = text_shingles(item)
            sizes.append(len(wanted))
            shared.append(len(wanted & have))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(shared, pa.int64())],
            names=["doc_key", "item_key", "n_item", "n_shared"])


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           item_id_col: str = "item_id", item_text_col: str = "text", percent: int = 80) -> DataFrame:
    """doc_id, item_id, n_item, n_shared, containment of every document row and item with
    100 * n_shared >= percent * n_item, counted in distinct five-word shingles."""
    spark = docs.sparkSession
    sketched = materialize(
        items.select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("t"))
        .distinct().mapInArrow(_sketches(percent), _ITEM), "items")
    sketch_keys = sketched.select("item_key", "size_class", F.explode("sketch").alias("found"))
    # Unsigned comparison: shift the sign bit, as Spark has signed longs only.
    top = sketched.select(F.max(F.expr("element_at(sketch, -1) ^ (-9223372036854775807L - 1)"))).first()[0]
    if top is None:
        return spark.createDataFrame([], "doc_id long, item_id long, n_item long, n_shared long, containment double")
    highest = (top ^ -2**63) % 2**64
    n_keys = sketch_keys.count()
    held = spark.sparkContext.broadcast(bloom.build(sketch_keys, "found", bloom.bits_for(n_keys, 64)))
    hits = materialize(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        .mapInArrow(_lookups(held, highest), _HIT), "hits")
    pairs = (hits.select("doc_key", F.explode("found").alias("found")).distinct()
             .join(sketch_keys.select("item_key", "found").distinct(), "found").select("doc_key", "item_key").distinct())
    checked = (pairs.join(hits.select("doc_key", "text").dropDuplicates(["doc_key"]), "doc_key")
               .join(sketched.select("item_key", "item_text").dropDuplicates(["item_key"]), "item_key")
               .select("doc_key", "item_key", "item_text", "text")
               .mapInArrow(_contained, "doc_key long, item_key long, n_item long, n_shared long")
               .filter(100 * F.col("n_shared") >= percent * F.col("n_item")))
    named = checked.join(sketched.select("item_key", "item_id"), "item_key")
    return (hits.select("doc_id", "doc_key").join(named, "doc_key")
            .select("doc_id", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment")))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without the rows whose id has a text that contains an item (rows with a null id share one id)."""
    return keys.without(docs, search(docs, items, id_col=id_col, **options).select("doc_id"), id_col)
