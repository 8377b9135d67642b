"""Running statistics over streams of pairs and predictions, with the batch functions."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairflow.functions import text as X
from pairflow.functions.features import with_features
from pairflow.operators import cost, routing
from pairflow.functions.lookup import lookup
from pairflow.workspace import scratch_path


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def features_and_route(pairs: DataFrame, **thresholds) -> DataFrame:
    """Stateless: features, then the rule route."""
    return routing.route_by_rule(with_features(pairs), **thresholds)


def routing_totals(routed: DataFrame, estimates: dict[str, int], default: int, baseline: str = "cot") -> DataFrame:
    """Running count, tokens spent and saved per strategy."""
    rows = routed
    if "estimated_tokens" not in routed.columns:
        rows = routed.withColumn("estimated_tokens", lookup("routed_strategy", estimates, default, "int"))
    return routing.routing_counters(rows, baseline)


def usage_totals(calls: DataFrame) -> DataFrame:
    """Running prompt usage per strategy."""
    return cost.usage_counters(calls)


def call_totals(calls: DataFrame, key: str = "model") -> DataFrame:
    """Running calls, tokens and errors per model; tokens of failed calls are not counted."""
    used = F.when(F.col("success"), F.col("prompt_tokens") + F.col("response_tokens")).otherwise(F.lit(0))
    return calls.groupBy(key).agg(
        F.count_if(F.col("success")).alias("total_calls"), F.sum(used).alias("total_tokens"),
        F.count_if(~F.col("success")).alias("errors"))


def call_history(calls: DataFrame, limit: int = 100) -> DataFrame:
    """Append-only history with shortened texts."""
    return calls.select(
        "strategy", X.truncate("premise", limit).alias("premise"), X.truncate("hypothesis", limit).alias("hypothesis"),
        F.col("raw_response").alias("response"), "prompt_tokens", "response_tokens")


def run_to_table(stream: DataFrame, name: str, mode: str = "append", root: str | None = None,
                 keys: list[str] | None = None) -> DataFrame:
    """Process what is available, then return the result as a batch table.

    "append" writes rows through the file sink (exactly once). "update" needs keys: each trigger writes the rows that
    it changed to a folder of its own, and a key's row is that of the last trigger that changed it (see Changes), so
    the work of a trigger follows its changes and a repeated trigger changes nothing. "complete" writes the whole
    result of each trigger and returns that of the last one; it suits small results without a key. With the same root
    a later call resumes where the last one stopped. A source without rows gives an empty table.
    """
    if mode not in ("append", "complete", "update"):
        raise ValueError(f"unknown mode {mode}")
    if (mode == "update") != bool(keys):
        raise ValueError("update mode needs keys, as a trigger's changes alone are not the table; other modes take none")
    spark = stream.sparkSession
    root = root or scratch_path(spark, name)
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{root}/checkpoint")
    if mode == "append":
        query = writer.outputMode("append").format("parquet").option("path", f"{root}/rows").start()
    elif mode == "update":
        changes = Changes(root, stream.schema, keys)
        query = writer.outputMode("update").foreachBatch(changes.store).start()
    else:
        def store(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{root}/state/batch={batch_id}")

        query = writer.outputMode("complete").foreachBatch(store).start()
    query.awaitTermination()
    if mode == "update":
        return changes.table(spark)
    rows = _stored(spark, f"{root}/rows" if mode == "append" else f"{root}/state",
                   stream.schema if mode == "append" else T.StructType([*stream.schema.fields, BATCH]))
    if mode == "append":
        return rows
    last = rows.agg(F.max("batch")).first()[0]
    return rows.where(F.col("batch") == last).drop("batch")


BATCH = T.StructField("batch", T.LongType())


def _stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows below path; none if nothing was written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


class Changes:
    """The rows that each trigger changed, merged by key and trigger.

    changes/batch=n holds what trigger n changed and is written as a whole, so writing it again leaves the same rows.
    Every `every` triggers the rows so far are merged into base/batch=n, and older folders are no longer read.
    """

    def __init__(self, root: str, schema: T.StructType, keys: list[str], every: int = 50):
        self.root, self.keys, self.every = root, keys, every
        self.schema = T.StructType([*schema.fields, BATCH])

    def store(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.root}/changes/batch={batch_id}")
        if (batch_id + 1) % self.every == 0:
            merged = self.table(batch.sparkSession, batch_id)
            merged.write.mode("overwrite").parquet(f"{self.root}/base/batch={batch_id}")

    def table(self, spark: SparkSession, upto: int | None = None) -> DataFrame:
        """Each key's row of the last trigger (up to one) that changed it."""
        changes, bases = (_stored(spark, f"{self.root}/{part}", self.schema) for part in ("changes", "base"))
        if upto is not None:
            changes, bases = changes.where(F.col("batch") <= upto), bases.where(F.col("batch") < upto)
        base = bases.agg(F.max("batch")).first()[0]  # a partition column: only folder names are read
        if base is not None:
            changes = changes.where(F.col("batch") > base).unionByName(bases.where(F.col("batch") == base))
        rest = [f.name for f in self.schema.fields if f.name not in self.keys and f.name != "batch"]
        last = changes.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last"))
        names = [f.name for f in self.schema.fields if f.name != "batch"]
        return last.select(*[F.col(n) if n in self.keys else F.col(f"_last.{n}").alias(n) for n in names])
