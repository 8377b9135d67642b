"""Joins between routed pairs and stored predictions. Always by key, never by position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairflow import domain
from pairflow.functions.lookup import lookup
from pairflow.functions.text import normalise_label


def answers_by_pair(predictions: DataFrame, required: tuple[str, ...] = (), key: str = "pairID") -> DataFrame:
    """(key, answers): each pair's stored predictions side by side, for pairs that have all required strategies.

    One grouping on the key, which a table bucketed by it (sources.prediction_store) does without a shuffle.
    """
    given = F.collect_list(F.struct("strategy", normalise_label("predicted_label").alias("predicted_label")))
    out = predictions.groupBy(key).agg(given.alias("answers"))
    for name in dict.fromkeys(required):
        out = out.where(F.array_contains(F.col("answers.strategy"), name))
    return out


def replay(routed: DataFrame, predictions: DataFrame, keep: tuple[str, ...] = ("difficulty_score",),
           required: tuple[str, ...] = ()) -> DataFrame:
    """For each routed row the stored prediction of the strategy it was routed to, on pairs that have all required ones.

    The only join is by pair id; the strategy is picked from the pair's answers, so a table bucketed by pair id is
    neither expanded nor shuffled.
    """
    left = routed.select("pairID", F.col("label").alias("true_label"), F.col("routed_strategy").alias("_strategy"),
                         *[c for c in keep if c in routed.columns])
    both = left.join(answers_by_pair(predictions, required), "pairID")
    picked = F.filter("answers", lambda a: a["strategy"] == F.col("_strategy"))
    return both.select(*[c for c in left.columns if c != "_strategy"], F.inline(picked)).withColumnRenamed(
        "strategy", "strategy_used")


def paired_correctness(predictions: DataFrame, a: str, b: str, key: str = "pairID") -> DataFrame:
    """(a_correct, b_correct, n) over the pairs that both strategies answered, by one grouping on the key."""
    right = F.coalesce(F.col("label") == F.col("predicted_label"), F.lit(False))
    per_pair = predictions.where(F.col("strategy").isin(a, b)).groupBy(key).agg(
        *[F.max(F.when(F.col("strategy") == s, right)).alias(f"{n}_correct") for n, s in (("a", a), ("b", b))])
    both = per_pair.where(F.col("a_correct").isNotNull() & F.col("b_correct").isNotNull())
    return both.groupBy("a_correct", "b_correct").agg(F.count(F.lit(1)).alias("n"))


def common_rows(table: DataFrame, *others: DataFrame, key: str = "pairID") -> DataFrame:
    """Rows of table whose key is in every other table."""
    for other in others:
        table = table.join(other.select(key), key, "left_semi")
    return table


def keys_with_all(predictions: DataFrame, required: tuple[str, ...], key: str = "pairID") -> DataFrame:
    """Keys that have a prediction of every required strategy, by one grouping with a flag per strategy."""
    names = list(dict.fromkeys(required))
    seen = predictions.where(F.col("strategy").isin(names)).groupBy(key).agg(
        *[F.max(F.col("strategy") == name).alias(f"_{i}") for i, name in enumerate(names)])
    for i in range(len(names)):
        seen = seen.where(f"_{i}")
    return seen.select(key)


def alignment_report(table: DataFrame, other: DataFrame, key: str = "pairID") -> DataFrame:
    """How many rows an alignment keeps and loses: keys are tagged and grouped once."""
    tagged = (table.select(F.col(key).alias("_k"), F.lit(1).alias("_l"), F.lit(0).alias("_r"))
              .unionByName(other.select(F.col(key).alias("_k"), F.lit(0).alias("_l"), F.lit(1).alias("_r"))))
    per_key = tagged.groupBy("_k").agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    both = F.col("_r") > 0
    return per_key.agg(
        F.sum("_l").alias("n_left"), F.sum("_r").alias("n_right"),
        F.coalesce(F.sum(F.when(both, F.col("_l"))), F.lit(0)).cast("long").alias("n_common"),
        F.coalesce(F.sum(F.when(~both, F.col("_l"))), F.lit(0)).cast("long").alias("n_lost"))


def common_accuracies(predictions: DataFrame, routed: DataFrame, required: tuple[str, ...] = ("zero-shot", "cot"),
                      strategies: list[str] | None = None) -> DataFrame:
    """Accuracy of every strategy and of the adaptive replay, on rows that have all required strategies.

    One grouping by pair gathers each strategy's outcome and the replayed one; no join per strategy.
    """
    names = strategies or domain.BASE_STRATEGIES
    right = (F.col("label") == normalise_label("predicted_label"))
    flags = predictions.where(F.col("strategy").isin(names)).select(
        "pairID", "strategy", F.coalesce(right, F.lit(False)).cast("int").alias("_right"),
        F.lit(None).cast("int").alias("_route"))
    place = F.lit(None).cast("int")
    for i, s in enumerate(names):
        place = F.when(F.col("routed_strategy") == s, F.lit(i)).otherwise(place)
    routes = routed.select(
        "pairID", F.lit(None).cast("string").alias("strategy"), F.lit(None).cast("int").alias("_right"),
        place.alias("_route"))
    per_pair = flags.unionByName(routes).groupBy("pairID").agg(
        *[F.max(F.when(F.col("strategy") == s, F.col("_right"))).alias(s) for s in names],
        F.max("_route").alias("_route"))
    for s in required:
        per_pair = per_pair.where(F.col(f"`{s}`").isNotNull())
    adaptive = F.lit(None).cast("int")
    for i, s in enumerate(names):
        adaptive = F.when(F.col("_route") == i, F.col(f"`{s}`")).otherwise(adaptive)
    per_pair = per_pair.withColumn("adaptive", adaptive)
    columns = [*names, "adaptive"]
    wide = per_pair.agg(*[e.alias(f"{s}|{m}") for s in columns for m, e in {
        "n": F.count(F.col(f"`{s}`")), "ok": F.sum(F.col(f"`{s}`"))}.items()])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(s).alias("strategy"), F.col(f"`{s}|n`").alias("n"),
                 F.try_divide(F.col(f"`{s}|ok`"), F.col(f"`{s}|n`")).alias("accuracy")) for s in columns])))


def with_dimension(df: DataFrame, dimension: DataFrame, key: str, value: str, default) -> DataFrame:
    """Left join a small dimension table and fill what it lacks; Spark broadcasts it by its size."""
    joined = df.join(dimension.select(key, value), key, "left")
    return joined.withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def with_constant(df: DataFrame, key: str, mapping: dict, output: str, default) -> DataFrame:
    """As with_dimension for a dictionary: no join at all."""
    return df.withColumn(output, lookup(key, mapping, default))
