"""Adaptive run: clean, sample, extract features, route by rule, score, evaluate, account for tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairflow.functions.features import with_features
from pairflow.operators import cleaning, cost, metrics, routing, sampling, scoring


def routed_pairs(pairs: DataFrame, per_genre: int | None = None, seed: int = 42, **thresholds) -> DataFrame:
    """Cleaned (and, if per_genre is given, sampled) pairs with features and their rule route."""
    rows = cleaning.clean(pairs)
    if per_genre:
        rows = sampling.stratified_sample(rows, per_genre, seed)
    return routing.route_by_rule(with_features(rows), **thresholds)


def run(pairs: DataFrame, factory: Callable[[], object], per_genre: int | None = 50, seed: int = 42,
        limits: scoring.Limits = scoring.Limits(), **thresholds) -> DataFrame:
    """One lazy plan up to the scored rows; the scorer is the only Python in it."""
    rows = scoring.for_routed(routed_pairs(pairs, per_genre, seed, **thresholds))
    return scoring.score(rows, factory, limits=limits, empty_error=True)


def evaluate(scored: DataFrame, *keys: str) -> DataFrame:
    """Metrics after normalising; a row without a prediction counts as an extra, wrong class."""
    return metrics.metrics(cleaning.with_normalised_labels(scored, missing="none"), *keys)


def routed_outcomes(routed: DataFrame, predictions: DataFrame) -> DataFrame:
    """Routed pairs with the stored prediction of the strategy they were routed to."""
    answers = predictions.select("pairID", "strategy", "predicted_label", "prompt_tokens", "response_tokens")
    left = routed.select("pairID", "genre", "label", "routed_strategy")
    return left.join(answers, (left.pairID == answers.pairID) & (left.routed_strategy == answers.strategy)).select(
        left.pairID, "genre", "label", "routed_strategy", "predicted_label", "prompt_tokens", "response_tokens")


def summary(pairs: DataFrame, predictions: DataFrame, baseline_tokens: int = 500, **thresholds) -> DataFrame:
    """Accuracy and token savings by genre and routed strategy."""
    outcomes = routed_outcomes(routed_pairs(pairs, **thresholds), predictions)
    right = F.coalesce((F.col("label") == F.col("predicted_label")).cast("double"), F.lit(0.0))
    spent = F.sum(F.col("prompt_tokens") + F.col("response_tokens"))
    return outcomes.groupBy("genre", "routed_strategy").agg(
        F.count(F.lit(1)).alias("n"), F.avg(right).alias("accuracy"), spent.alias("tokens_spent"),
        (F.count(F.lit(1)) * baseline_tokens - spent).alias("tokens_saved"))


def roi(scored: DataFrame) -> DataFrame:
    return cost.token_roi(scored)
