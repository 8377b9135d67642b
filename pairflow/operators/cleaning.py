"""Filters, deduplication and the reports about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairflow import domain
from pairflow.functions import text as T


def valid_label(col: Column | str = "label") -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.isin(domain.LABELS), F.lit(False))


def keep_valid_labels(df: DataFrame, label: str = "label") -> DataFrame:
    return df.where(valid_label(label))


def drop_blank_texts(df: DataFrame, premise: str = "premise", hypothesis: str = "hypothesis") -> DataFrame:
    return df.where(T.has_text(premise) & T.has_text(hypothesis))


def keep_first(df: DataFrame, premise: str = "premise", hypothesis: str = "hypothesis",
               order: str = "pairID") -> DataFrame:
    """One row per (premise, hypothesis): the one with the smallest order value.

    An aggregate rather than a window: copies collapse before the shuffle, so a text that makes up
    a third of the table arrives as one row per task. The leading 64-bit hash only speeds up the
    sort; equality is still decided by the texts themselves.
    """
    payload = [order] + [c for c in df.columns if c not in (premise, hypothesis, order)]
    grouped = df.groupBy(F.xxhash64(premise, hypothesis).alias("_h"), premise, hypothesis).agg(
        F.min(F.struct(*payload)).alias("_first"))
    return grouped.select(*[F.col(c) if c in (premise, hypothesis) else F.col(f"_first.{c}") for c in df.columns])


def clean(df: DataFrame) -> DataFrame:
    return keep_first(drop_blank_texts(keep_valid_labels(df)))


def cleaning_report(df: DataFrame) -> DataFrame:
    """Rows removed by each step and in total, from one pass and one shuffle of counts.

    Distinct texts are told apart by 256-bit digests of both texts, so that no text is shuffled.
    """
    ok_label = valid_label()
    ok_text = T.has_text("premise") & T.has_text("hypothesis")
    state = F.when(~ok_label, F.lit("label")).when(~ok_text, F.lit("blank")).otherwise(F.lit("kept"))
    kept = F.col("_state") == "kept"
    groups = df.withColumn("_state", state).groupBy(
        "_state", F.when(kept, F.concat(F.sha2("premise", 256), F.sha2("hypothesis", 256))).alias("_d"),
    ).agg(F.count(F.lit(1)).alias("_n"))
    n = F.col("_n")

    def total(cond: Column, value: Column = n) -> Column:
        return F.coalesce(F.sum(F.when(cond, value)), F.lit(0)).cast("long")

    report = groups.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("n_input"),
        total(F.col("_state") == "label").alias("n_bad_label"),
        total(F.col("_state") == "blank").alias("n_blank"),
        total(kept, n - 1).alias("n_duplicate"),
        F.count_if(kept).alias("n_kept"),
    )
    removed = F.col("n_input") - F.col("n_kept")
    return report.withColumns({
        "n_removed": removed,
        "removed_pct": F.try_divide(removed * 100.0, F.col("n_input")),
    })


def split_valid_predictions(df: DataFrame, pred: str = "predicted_label") -> DataFrame:
    """Rows with a prediction."""
    return df.where(F.col(pred).isNotNull())


def validity_counts(df: DataFrame, *keys: str, pred: str = "predicted_label", stringified: bool = False) -> DataFrame:
    """Valid and invalid predictions; stringified treats "nan" and "none" texts as missing."""
    value = T.null_if_text_null(pred) if stringified else F.col(pred)
    return df.groupBy(*keys).agg(
        F.count_if(value.isNotNull()).alias("n_valid"), F.count_if(value.isNull()).alias("n_invalid"))


def with_normalised_labels(df: DataFrame, true: str = "label", pred: str = "predicted_label",
                           missing: str | None = None) -> DataFrame:
    """Lower-cased, stripped labels; missing names the class a null prediction becomes, if any."""
    p = T.normalise_label(pred)
    if missing is not None:
        p = F.coalesce(p, F.lit(missing))
    return df.withColumns({true: T.normalise_label(true), pred: p})


def errors_only(df: DataFrame, true: str = "label", pred: str = "predicted_label") -> DataFrame:
    """Valid predictions that differ from the label."""
    return df.where(F.col(pred).isNotNull() & (F.col(true) != F.col(pred)))
