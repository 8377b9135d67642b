"""Pivots and long forms of small metric tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairflow import domain


def pivot_metric(metrics: DataFrame, metric: str = "accuracy", row: str = "genre", col: str = "strategy",
                 values: list[str] | None = None) -> DataFrame:
    """One row per genre, one column per strategy (in the given order)."""
    values = values or domain.STRATEGIES
    wide = metrics.groupBy(row).pivot(col, values).agg(F.first(metric))
    return wide.select(row, *[F.col(f"`{v}`").alias(v.replace("-", "_")) for v in values])


def genre_improvement(metrics: DataFrame, better: str = "cot", base: str = "zero-shot",
                      metric: str = "accuracy", k: int | None = None) -> DataFrame:
    """Gain of one strategy over another by genre, largest first; the top k if given."""
    wide = pivot_metric(metrics, metric, values=[base, better])
    b, a = better.replace("-", "_"), base.replace("-", "_")
    out = wide.select("genre", (F.col(b) - F.col(a)).alias("improvement")).orderBy(
        F.col("improvement").desc(), "genre")
    return out.limit(k) if k else out


def class_f1_long(comparison: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """Wide per-class F1 columns to (strategy, label, f1)."""
    labels = labels or domain.LABELS
    long = comparison.unpivot(["strategy"], [f"{l}_f1" for l in labels], "label", "f1")
    return long.withColumn("label", F.regexp_replace("label", "_f1$", ""))


def class_f1_by_strategy(comparison: DataFrame, strategies: list[str] | None = None) -> DataFrame:
    """label x strategy table of F1."""
    return pivot_metric(class_f1_long(comparison), "f1", "label", "strategy", strategies)


def progression(comparison: DataFrame, metric: str = "accuracy", order: list[str] | None = None) -> DataFrame:
    """The strategies present, in the order of growing prompts."""
    order = order or domain.BASE_STRATEGIES
    place = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("strategy"))
    return comparison.select("strategy", metric, place.cast("int").alias("ord")).where("ord > 0").orderBy("ord")
