"""Leaderboard over prediction tables of different shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairflow.functions.text import normalise_label, null_if_text_null
from pairflow.operators import metrics
from pairflow.sources.readers import union_sources


def ranked(sources: dict[str, DataFrame]) -> DataFrame:
    """Accuracy of each source, letter case ignored, best first."""
    rows = union_sources(sources).select(
        "strategy", normalise_label("label", strip=False).alias("label"),
        normalise_label("predicted_label", strip=False).alias("predicted_label"))
    return metrics.accuracy(rows, "strategy").orderBy(F.col("accuracy").desc(), "strategy")


def detailed(sources: dict[str, DataFrame]) -> DataFrame:
    """Full metrics of each source on normalised labels; texts standing for null count as invalid."""
    rows = union_sources(sources).select(
        "strategy", normalise_label("label").alias("label"),
        normalise_label(null_if_text_null("predicted_label")).alias("predicted_label"))
    return metrics.compare(rows, "strategy")
