"""Exact "first n of a group in hash order" without sending a large group to one task.

A window over (group) would sort a group that holds a third of the table in a single task. Two
exact replacements:

* a small literal n: row_number with a literal bound, which Spark turns into a per-task group limit
  before the shuffle, so at most n rows per group leave each task;
* any other quota: find the digest at which the quota is reached (counts per digest bucket, then
  ranks inside the one bucket that holds the boundary) and compare every row with it in a map-only
  pass.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairflow.functions.ordering import digest_bucket, shuffle_key
from pairflow.workspace import broadcast_if_small, materialize

# Above this Spark no longer plans the group limit (spark.sql.optimizer.windowGroupLimitThreshold).
GROUP_LIMIT = 1000
DIGEST_DIGITS = 4  # 65536 buckets per group


def first_n(df: DataFrame, keys: list[str], n: int, id_col: str = "pairID", seed: int = 42,
            rank: str = "_rn") -> DataFrame:
    """Rows 1..n of each group in hash order, with their rank, for a literal n <= GROUP_LIMIT."""
    keyed = df.withColumn("_k", shuffle_key(id_col, seed))
    window = W.partitionBy(*keys).orderBy("_k", id_col)
    return keyed.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n).drop("_k")


def group_sizes(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def boundaries(rows: DataFrame, keys: list[str], quotas: Callable[[DataFrame], DataFrame],
               id_col: str = "pairID", digits: int = DIGEST_DIGITS) -> DataFrame:
    """Per group: quota and the (digest, id) of its quota-th row, null for a quota of 0.

    rows is a stored table with its digests in _k, of which only keys, ids and digests are read. quotas maps a table
    (keys, n) to (keys, n, quota); a quota beyond n takes the whole group.
    """
    keyed = rows.select(*keys, F.col(id_col).alias("_id"), "_k", digest_bucket(F.col("_k"), digits).alias("_b"))
    histogram = keyed.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_nb"))
    quota = quotas(histogram.groupBy(*keys).agg(F.sum("_nb").alias("n")))
    quota = quota.withColumn("quota", F.least(F.col("quota"), F.col("n")))
    running = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, W.currentRow)
    # Null-safe keys: a group whose key is null is still a group.
    edge = (_null_safe_join(histogram, quota, keys)
            .withColumn("_upto", F.sum("_nb").over(running))
            .where((F.col("_upto") >= F.col("quota")) & (F.col("_upto") - F.col("_nb") < F.col("quota")))
            .select(*keys, "_b", (F.col("quota") - F.col("_upto") + F.col("_nb")).alias("_take")))
    edge = broadcast_if_small(edge)
    inside = _null_safe_join(keyed, edge, keys + ["_b"])
    ranked = inside.withColumn(
        "_rn", F.row_number().over(W.partitionBy(*keys, "_b").orderBy("_k", "_id")))
    cut = ranked.where(F.col("_rn") == F.col("_take")).select(
        *keys, F.struct("_k", "_id").alias("_cut"))
    return _null_safe_join(quota, cut, keys, "left")


def with_first_flag(df: DataFrame, keys: list[str], quotas: Callable[[DataFrame], DataFrame],
                    flag: str, id_col: str = "pairID", seed: int = 42) -> DataFrame:
    """Mark exactly quota rows of each group, the first in hash order.

    The rows are written once with their digests, so what produced df (a scan, the shuffle that drops duplicates) runs
    once; boundaries come from a few narrow columns of that table, and the wide rows are read once more and never
    shuffled while the groups are few enough to broadcast.
    """
    rows = materialize(df.withColumn("_k", shuffle_key(id_col, seed)), "rows")
    limits = broadcast_if_small(boundaries(rows, keys, quotas, id_col).drop("n"))
    joined = _null_safe_join(rows, limits, keys, "left")
    own = F.struct(F.col("_k"), F.col(id_col).alias("_id"))
    taken = F.coalesce(own <= F.col("_cut"), F.lit(False)) & (F.col("quota") > 0)
    return joined.withColumn(flag, taken).select(*df.columns, flag)


def with_group_rank(df: DataFrame, keys: list[str], output: str, id_col: str = "pairID", seed: int = 42,
                    digits: int = DIGEST_DIGITS) -> DataFrame:
    """Exact row_number() over (partition by keys order by digest), computed bucket by bucket."""
    keyed = df.withColumn("_k", shuffle_key(id_col, seed))
    keyed = keyed.withColumn("_b", digest_bucket(F.col("_k"), digits))
    histogram = keyed.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_nb"))
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = histogram.select(*keys, "_b", F.coalesce(F.sum("_nb").over(before), F.lit(0)).alias("_base"))
    joined = _null_safe_join(keyed, offsets, keys + ["_b"])
    inside = W.partitionBy(*keys, "_b").orderBy("_k", id_col)
    return joined.withColumn(output, F.col("_base") + F.row_number().over(inside)).select(*df.columns, output)


def _null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond: Column = F.lit(True)
    for k in keys:
        cond &= F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])
