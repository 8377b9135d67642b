"""Offline replay: what the router would have achieved with predictions already stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairflow import domain
from pairflow.operators import cost, replay


def replayed(routed: DataFrame, predictions: DataFrame, required: tuple[str, ...] = ("zero-shot", "cot")) -> DataFrame:
    """Routed rows that have every required strategy, each with its strategy's stored prediction."""
    return replay.replay(routed, predictions, required=required)


def accuracies(routed: DataFrame, predictions: DataFrame) -> DataFrame:
    return replay.common_accuracies(predictions, routed)


def savings(adaptive: DataFrame, predictions: DataFrame) -> DataFrame:
    counts = adaptive.groupBy(F.col("strategy_used").alias("strategy")).agg(F.count(F.lit(1)).alias("n"))
    return cost.replay_savings(counts, cost.measured_tokens(predictions, domain.BASE_STRATEGIES))
