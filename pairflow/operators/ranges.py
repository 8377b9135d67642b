"""Scans in order without a task that sees the whole order.

Rows are written in ranges of their own order; the range bounds come from a sample of the data, so ranges hold equal
shares of the distinct rows whatever the values look like. What a scan carries from one range to the next is one row
per range, scanned on its own, and each range is then scanned with what is carried into it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairflow.workspace import broadcast_if_small, materialize


def ranged(df: DataFrame, *order: str, name: str = "ranges") -> DataFrame:
    """df, stored, with _range: numbers of ranges that ascend with the order. Rows must be distinct in it, or few
    equal: equal rows share a range."""
    return materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), name)


def carried_in(parts: DataFrame, keys: list[str], **carried: Column) -> DataFrame:
    """(keys, _range, ...): for each range of a group, aggregates over all earlier ranges of that group.

    parts has one row per group and range; without keys that is one short row per range of the whole table.
    """
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    return parts.select(*keys, "_range", *[c.over(before).alias(n) for n, c in carried.items()])


def inside(keys: list[str], order: str, upto: int = W.currentRow) -> W:
    """Window over one range of a group, from its first row."""
    return W.partitionBy(*keys, "_range").orderBy(order).rowsBetween(W.unboundedPreceding, upto)


def rising_steps(points: DataFrame, x: str, y: str) -> DataFrame:
    """The points (one y for each x) whose y is above the y of every smaller x: the steps of the running maximum.

    Each range keeps the points that rise above its own earlier ones; only these, as a rule few, are stored and
    compared with the highest y of the ranges below.
    """
    # Not ranged(): the points themselves need not be stored, only the steps inside the ranges.
    cut = points.select(x, y).repartitionByRange(x).withColumn("_range", F.spark_partition_id())
    local = cut.withColumn("_below", F.max(y).over(inside([], x, -1)))
    local = materialize(local.where(F.col("_below").isNull() | (F.col(y) > F.col("_below"))).drop("_below"), "steps")
    floors = carried_in(local.groupBy("_range").agg(F.max(y).alias("_top")), [], _floor=F.max("_top"))
    met = local.join(broadcast_if_small(floors), "_range")
    return met.where(F.col("_floor").isNull() | (F.col(y) > F.col("_floor"))).select(x, y)
