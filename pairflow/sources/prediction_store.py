"""Predictions stored for joins: one folder per strategy, bucketed and sorted by pair id inside.

Reading some strategies prunes the other folders; grouping or joining by pair id needs no shuffle on this side,
whatever strategies are read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairflow.workspace import scratch_path


def write(predictions: DataFrame, buckets: int | None = None, path: str | None = None, table: str | None = None) -> str:
    """Store (pairID, strategy, ...) and return the table's name; buckets: by default the session's shuffle partitions."""
    spark = predictions.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = table or f"predictions_{uuid.uuid4().hex}"
    (predictions.repartition(buckets, "pairID").write.mode("overwrite").partitionBy("strategy")
     .bucketBy(buckets, "pairID").sortBy("pairID").option("path", path or scratch_path(spark, table))
     .format("parquet").saveAsTable(table))
    return table


def read(spark: SparkSession, table: str, *strategies: str) -> DataFrame:
    """The stored predictions of some strategies, or of all."""
    stored = spark.table(table)
    return stored.where(F.col("strategy").isin(*strategies)) if strategies else stored
