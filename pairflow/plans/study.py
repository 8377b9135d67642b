"""Strategy study: score every strategy over the same rows, compare, train and apply the router."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairflow import domain
from pairflow.operators import cost, difficulty, metrics, routing, scoring


def run_strategies(pairs: DataFrame, factory: Callable[[], object], strategies: list[str] | None = None,
                   stored: DataFrame | None = None, limits: scoring.Limits = scoring.Limits(),
                   keep: tuple[str, ...] | None = None) -> DataFrame:
    """All strategies in one pass; rows with a stored prediction are not scored again. keep: as in scoring.score."""
    if stored is None:
        return scoring.score(pairs, factory, limits=limits, keep=keep, strategies=strategies or domain.BASE_STRATEGIES)

    def score(todo: DataFrame) -> DataFrame:
        return scoring.score(scoring.with_request(todo), factory, limits=limits, keep=keep)

    return scoring.resume(scoring.as_strategies(pairs, strategies), stored, score)


def compare(predictions: DataFrame) -> DataFrame:
    return metrics.compare(predictions, "strategy")


def confusion_by_strategy(predictions: DataFrame) -> DataFrame:
    return metrics.confusion_patterns(metrics.outcome_counts(predictions, "strategy"), "strategy")


def frontier(predictions: DataFrame) -> DataFrame:
    return cost.cost_accuracy(metrics.metrics(predictions, "strategy"))


def train_router(train_features: DataFrame, predictions: DataFrame) -> difficulty.DifficultyModel:
    """Difficulty model from the training pairs; fails early if a needed strategy is missing."""
    difficulty.require_strategies(predictions)
    return difficulty.fit(difficulty.training_rows(train_features, predictions))


def apply_router(model: difficulty.DifficultyModel, features: DataFrame, tiered: bool = True) -> DataFrame:
    return routing.route_by_score(model.score(features), "difficulty_score", tiered)


def final_record(comparison: DataFrame, savings: DataFrame, cv: DataFrame) -> DataFrame:
    """One row: best strategy and accuracy, savings, cross-validation accuracy, and the comparison of strategies.

    The inputs are reports of at most a few rows; they are stacked and folded, not joined.
    """
    best = metrics.best_strategy(comparison).select(
        F.col("strategy").alias("best_strategy"), F.col("accuracy").alias("best_accuracy"))
    parts = best.unionByName(
        savings.select("cost_savings_pct", "token_savings_pct"), allowMissingColumns=True).unionByName(
        cv.select(F.col("accuracy").alias("gatekeeper_cv_accuracy")), allowMissingColumns=True)
    scores = [c for c in ("accuracy", "macro_f1", "n_samples") if c in comparison.columns]
    parts = parts.unionByName(comparison.select(F.struct("strategy", *scores).alias("_row")), allowMissingColumns=True)
    names = [c for c in parts.columns if c != "_row"]
    return parts.agg(*[F.max(c).alias(c) for c in names], F.sort_array(F.collect_list("_row")).alias("comparison"))
