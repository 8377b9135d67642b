"""URL filters by Bloom filter cascades.

A cascade holds a list of keys within a known universe, the distinct keys of the whole corpus. Its first filter
encodes the listed keys; the second the universe's keys that the first passes wrongly; the third the listed keys
that the second passes, and so on until a level has no false positives. The level at which a key stops tells
on which side it is, and for every key of the universe that answer is exact, though no list is joined or kept.
Every level has hash functions of its own, so that keys keep parting.

A url's keys are the suffixes of its host joined to the starts of its path that have the length of a rule's
path. One cascade holds the rules' keys, a second one the hosts of a blocklist, which decides where no rule
fits. The list side and the false positives shrink by the filters' error rate from level to level; filters are
built by aggregates, and each is bounded (see bloom.py).

Results for odd input: a null url or one without "://" has empty host and path, fits no rule and is allowed;
repeated rows get a row each; a null id stays null; only the two named columns are read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairflow.llm import bloom
from pairflow.workspace import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_LEVELS = 12
BITS_PER_KEY = 12


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column) -> Column:
    """The host and its parent domains, longest first; none for an empty host."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(suffixes)


def rule_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Host suffix + path start for every length a rule's path has; longest first, of equal length the longer host."""
    starts = [F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]
    keys = F.flatten(F.transform(host_suffixes(host), lambda h: F.array(*[
        F.struct((-F.length(h) - F.length(s)).alias("order"), (-F.length(h)).alias("host"), F.concat(h, s).alias("key")) for s in starts])))
    return F.transform(F.array_sort(F.filter(keys, lambda x: x["key"].isNotNull())), lambda x: x["key"])


def _level_hash(key: Column, level: int) -> Column:
    return F.xxhash64(F.lit(level), key)


class Cascade:
    """Levels of filter words; a key is listed if the first level that lacks it is an even one (from 0: odd count)."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels

    def listed(self, hashes: np.ndarray) -> np.ndarray:
        """hashes: keys x levels, unsigned. Mask of the listed keys."""
        open_ = np.arange(len(hashes))
        out = np.zeros(len(hashes), dtype=bool)
        for i, words in enumerate(self.levels):
            passed = bloom.contains(words, hashes[open_, i])
            out[open_[~passed]] = i % 2 == 1
            open_ = open_[passed]
        out[open_] = len(self.levels) % 2 == 1
        return out


def build(universe: DataFrame, listed: DataFrame, key: str = "key") -> Cascade:
    """The cascade of the listed keys within the universe (both distinct, one string column).

    Listed keys outside the universe are never asked for and are left out of every level but the first.
    """
    spark = universe.sparkSession
    levels: list[np.ndarray] = []
    inside = materialize(listed.select(key), "listed")
    outside = materialize(universe.select(key).join(inside, key, "left_anti"), "outside")
    encode, other = inside, outside
    for level in range(MAX_LEVELS):
        hashed = encode.select(_level_hash(F.col(key), level).alias("h"))
        words = bloom.build(hashed, "h", bloom.bits_for(encode.count(), BITS_PER_KEY))
        levels.append(words)
        held = spark.sparkContext.broadcast(words)
        passing = materialize(
            other.select(key, _level_hash(F.col(key), level).alias("h")).mapInArrow(_passing(held), "key string"), "passing")
        passing = passing.withColumnRenamed("key", key)
        if passing.isEmpty():
            return Cascade(levels)
        encode, other = passing, encode
    raise RuntimeError(f"keys still collide after {MAX_LEVELS} levels")


def _passing(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = bloom.contains(held.value, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep))], names=["key"])
    return run


def _first_listed(held, source: str, target: str):
    """Index of the first listed key of each row, -1 if none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cascade = Cascade(held.value)
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index(source))
            counts = keys.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = keys.flatten().flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, len(cascade.levels))
            hit = cascade.listed(flat)
            rows = np.repeat(np.arange(len(counts)), counts)
            place = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
            first = np.full(len(counts), -1, dtype=np.int32)
            own, at = np.unique(rows[hit], return_index=True)
            first[own] = place[hit][at]
            columns = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != source]
            names = [n for n in batch.schema.names if n != source]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(first)], names=[*names, target])
    return run


def _with_first(df: DataFrame, keys: str, cascade: Cascade, target: str) -> DataFrame:
    """df plus the index of the first of its keys that the cascade lists."""
    spark = df.sparkSession
    held = spark.sparkContext.broadcast(cascade.levels)
    hashed = df.withColumn("_h", F.transform(keys, lambda k: F.array(*[_level_hash(k, i) for i in range(len(cascade.levels))])))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return hashed.mapInArrow(_first_listed(held, "_h", target), f"{kept}, `{target}` int")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], blocklist: list[str], id_col: str = "page_id",
          url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict of every row.

    rules: (allow or block, host, path); the longest fitting rule wins (host and path together; of equal length the longer host).
    blocklist: hosts that are blocked, with their subdomains, where no rule fits; what is on neither is allowed.
    """
    spark = pages.sparkSession
    if not rules or not blocklist:
        raise ValueError("give rules and a blocklist")
    actions = {f"{host}{path}": action for action, host, path in rules}
    lengths = sorted({len(path) for _, _, path in rules})
    url = pages[url_col].cast("string")
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumns({"rule_keys": rule_keys(F.col("host"), F.col("path"), lengths), "hosts": host_suffixes(F.col("host"))})
    listed = lambda keys: spark.createDataFrame([(k,) for k in sorted(set(keys))], "key string")
    universe = lambda c: rows.select(F.explode(c).alias("key")).distinct()  # noqa: E731  copies combine before the shuffle
    by_rule = build(universe("rule_keys"), listed(actions))
    by_host = build(universe("hosts"), listed(blocklist))
    marked = _with_first(_with_first(rows, "rule_keys", by_rule, "_rule"), "hosts", by_host, "_blocked")
    rule = F.when(F.col("_rule") >= 0, F.get("rule_keys", F.col("_rule")))
    action = F.create_map(*[F.lit(x) for pair in actions.items() for x in pair])
    return marked.select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(F.element_at(action, rule), F.when(F.col("_blocked") >= 0, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))


def count_levels(spark: SparkSession, universe: list[str], listed: list[str]) -> int:
    """Levels of the cascade over two small lists."""
    table = lambda keys: spark.createDataFrame([(k,) for k in keys], "key string")
    return len(build(table(universe), table(listed)).levels)
