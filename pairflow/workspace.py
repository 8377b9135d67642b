"""Shared folder, stored intermediate tables and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
# Rows a side may have before it is no longer broadcast (a few MB for the dimension-like tables here).
BROADCAST_ROWS = 20_000


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the cluster.

    Only a local session may fall back to a temporary folder; anything else must name one.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="pairflow-")
    spark.sparkContext.setCheckpointDir(folder)
    spark.conf.set(CHECKPOINT_CONF, folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, below a folder of this run that can be removed with it."""
    return f"{shared_dir(spark)}/pairflow/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df to the shared folder once and continue from there: short lineage, true sizes, pruning."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._stored_at = path
    return stored


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that materialize() wrote and that nothing reads again."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only after the (materialised) side was counted; a plain side otherwise.

    Without the hint the join stays a shuffle join, which AQE splits on skewed keys.
    """
    small = materialize(df, "small")
    return F.broadcast(small) if small.count() <= max_rows else small


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition by keys if the input has fewer partitions than the cluster has cores.

    A 100 TB scan has far more splits than cores and passes through without a shuffle.
    """
    return repartition_as(df, df, *keys)


def repartition_as(df: DataFrame, sized: DataFrame, *keys: str) -> DataFrame:
    """As spread, judging by the partitions of `sized`: for a stream, a batch read of its source."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if sized.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)


def literal_table(spark: SparkSession, rows: list[tuple], columns: dict[str, str]) -> DataFrame:
    """A small constant table (columns: name -> type)."""
    if len(rows) > 20:  # as an expression it would outgrow one generated method
        return spark.createDataFrame(rows, ", ".join(f"`{c}` {t}" for c, t in columns.items()))
    structs = [
        F.struct(*[F.lit(v).cast(t).alias(c) for v, (c, t) in zip(row, columns.items())])
        for row in rows
    ]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*structs)))
