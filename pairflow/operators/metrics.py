"""Classification metrics from counts of (keys, true label, predicted label).

Rows are counted once, with map-side combining; every metric derives from that small table.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairflow import domain
from pairflow.functions.tails import chi_square_tail
from pairflow.functions.text import confusion_key


def outcome_counts(df: DataFrame, *keys: str, true: str = "label", pred: str = "predicted_label") -> DataFrame:
    """(keys, true, pred, n); rows without a prediction keep a null pred."""
    return df.groupBy(*keys, F.col(true).alias("true"), F.col(pred).alias("pred")).agg(
        F.count(F.lit(1)).alias("n"))


def accuracy(df: DataFrame, *keys: str, true: str = "label", pred: str = "predicted_label") -> DataFrame:
    """Share of equal labels; a missing prediction is wrong."""
    right = F.coalesce((F.col(true) == F.col(pred)).cast("double"), F.lit(0.0))
    return df.groupBy(*keys).agg(F.avg(right).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def confusion_matrix(counts: DataFrame, *keys: str, labels: list[str] | None = None) -> DataFrame:
    """Every cell of labels x labels, zeros included; other labels are ignored."""
    names = labels or domain.LABELS
    cells = [(t, p) for t in names for p in names]

    def hit(t: str, p: str) -> Column:
        return F.coalesce(F.sum(F.when((F.col("true") == t) & (F.col("pred") == p), F.col("n"))), F.lit(0))

    wide = counts.groupBy(*keys).agg(*[hit(t, p).cast("long").alias(f"c{i}") for i, (t, p) in enumerate(cells)])
    return wide.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(t).alias("true"), F.lit(p).alias("pred"), F.col(f"c{i}").alias("n"))
        for i, (t, p) in enumerate(cells)])))


def observed_labels(counts: DataFrame, *keys: str) -> DataFrame:
    """Labels seen as truth or prediction among rows with a prediction."""
    valid = counts.where(F.col("pred").isNotNull())
    return valid.select(*keys, F.explode(F.array("true", "pred")).alias("label")).distinct()


def observed_confusion_matrix(counts: DataFrame) -> DataFrame:
    """Every cell over the labels observed, zeros included."""
    seen = F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.array("true", "pred")))))
    cells = F.map_from_entries(F.collect_list(F.struct(F.struct("true", "pred"), "n")))
    valid = counts.where(F.col("pred").isNotNull() & F.col("true").isNotNull())
    # One row per (true, pred): the label domain, never the data, is gathered here.
    domain_row = valid.agg(seen.alias("labels"), cells.alias("cells"))
    grid = domain_row.select("cells", "labels", F.explode("labels").alias("true")).select(
        "cells", "true", F.explode("labels").alias("pred"))
    return grid.select("true", "pred", F.coalesce(
        F.try_element_at("cells", F.struct("true", "pred")), F.lit(0)).cast("long").alias("n"))


def normalised_confusion(matrix: DataFrame, *keys: str) -> DataFrame:
    """Share of each cell in its true-label row; null where the row is empty."""
    row = F.sum("n").over(W.partitionBy(*keys, "true"))
    return matrix.withColumn("share", F.try_divide(F.col("n"), row))


def _label_tallies(counts: DataFrame, *keys: str) -> DataFrame:
    """(keys, label, tp, fp, support, invalid): invalid rows sit under a null label."""
    n, zero = F.col("n"), F.lit(0).cast("long")
    right = F.col("true") == F.col("pred")

    def entry(label: Column, tp: Column, fp: Column, support: Column, invalid: Column) -> Column:
        return F.struct(label.alias("label"), tp.alias("tp"), fp.alias("fp"),
                        support.alias("support"), invalid.alias("invalid"))

    as_true = entry(F.col("true"), F.when(right, n).otherwise(zero), zero, n, zero)
    as_pred = entry(F.col("pred"), zero, F.when(right, zero).otherwise(n), zero, zero)
    missing = entry(F.lit(None).cast("string"), zero, zero, zero, n)
    entries = F.when(F.col("pred").isNull(), F.array(missing)).otherwise(F.array(as_true, as_pred))
    return counts.select(*keys, F.inline(entries)).groupBy(*keys, "label").agg(
        *[F.sum(c).alias(c) for c in ("tp", "fp", "support", "invalid")])


def _with_class_scores(tallies: DataFrame) -> DataFrame:
    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    tp, fp, support = F.col("tp"), F.col("fp"), F.col("support")
    return tallies.withColumns({
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, support),
        "f1": ratio(2 * tp, tp + fp + support),
    })


def per_class(counts: DataFrame, *keys: str, labels: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and support of each label that was observed."""
    scored = _with_class_scores(_label_tallies(counts, *keys)).where(F.col("label").isNotNull())
    if labels is not None:
        scored = scored.where(F.col("label").isin(labels))
    return scored.select(*keys, "label", "precision", "recall", "f1", "support")


def report(counts: DataFrame, *keys: str) -> DataFrame:
    """Accuracy, macro and weighted scores, per-label F1 and row counts of each key group.

    Macro scores average over the labels observed in the group, not over the fixed three.
    """
    scored = _with_class_scores(_label_tallies(counts, *keys))
    real = F.col("label").isNotNull()

    def macro(c: str) -> Column:
        return F.avg(F.when(real, F.col(c)))

    per_label = [F.coalesce(F.max(F.when(F.col("label") == l, F.col("f1"))), F.lit(0.0)).alias(f"{l}_f1")
                 for l in domain.LABELS]
    return scored.groupBy(*keys).agg(
        F.try_divide(F.sum("tp"), F.sum("support")).alias("accuracy"),
        macro("f1").alias("macro_f1"),
        F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
        macro("precision").alias("macro_precision"),
        macro("recall").alias("macro_recall"),
        F.sum("support").alias("n_samples"),
        F.sum("invalid").alias("n_invalid"),
        *per_label)


def metrics(df: DataFrame, *keys: str, true: str = "label", pred: str = "predicted_label") -> DataFrame:
    return report(outcome_counts(df, *keys, true=true, pred=pred), *keys)


def compare(df: DataFrame, key: str = "strategy", **cols: str) -> DataFrame:
    """Metrics of each strategy (or genre), best accuracy first."""
    return metrics(df, key, **cols).orderBy(F.col("accuracy").desc(), key)


# --- confusion patterns ------------------------------------------------------------------------

def confusion_patterns(counts: DataFrame, *keys: str) -> DataFrame:
    """Errors, error rate and the two neutral/entailment mix-ups."""
    n = F.col("n")
    valid = F.col("pred").isNotNull()
    wrong = valid & (F.col("true") != F.col("pred"))

    def total(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, n)), F.lit(0)).cast("long")

    out = counts.groupBy(*keys).agg(
        total(wrong).alias("total_errors"), total(valid).alias("n_valid"),
        total(wrong & (F.col("true") == "neutral") & (F.col("pred") == "entailment")).alias("neutral_to_entailment"),
        total(wrong & (F.col("true") == "entailment") & (F.col("pred") == "neutral")).alias("entailment_to_neutral"))
    mixed = F.col("neutral_to_entailment") + F.col("entailment_to_neutral")
    return out.withColumns({
        "error_rate": F.try_divide(F.col("total_errors"), F.col("n_valid")),
        "neutral_entailment_rate": mixed / F.greatest(F.col("total_errors"), F.lit(1)),
    })


def error_pairs(counts: DataFrame, *keys: str) -> DataFrame:
    """Errors per "true → pred" pair."""
    wrong = counts.where(F.col("pred").isNotNull() & (F.col("true") != F.col("pred")))
    return wrong.select(*keys, confusion_key("true", "pred").alias("confusion_pair"), "n")


def top_confusions(counts: DataFrame, *keys: str, k: int = 6) -> DataFrame:
    """The k most frequent error pairs (of each key group)."""
    pairs = error_pairs(counts, *keys)
    order = [F.col("n").desc(), F.col("confusion_pair")]
    if not keys:
        return pairs.orderBy(*order).limit(k)
    ranked = pairs.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rn") <= k).drop("_rn")


# --- paired comparison ---------------------------------------------------------------------------

def correctness_profiles(df: DataFrame, strategies: list[str] | None = None, true: str = "label",
                         pred: str = "predicted_label", id_col: str = "pairID") -> DataFrame:
    """(present, correct, n): how many pairs share the same set of answering and right strategies.

    One shuffle on the pair id replaces a self-join per strategy pair; what is left has at most one row per
    combination of strategies. Both columns are sorted arrays of strategy names, so any number of them fits.
    """
    names = strategies or domain.STRATEGIES
    right = F.coalesce(F.col(true) == F.col(pred), F.lit(False))
    flagged = df.where(F.col("strategy").isin(names)).select(F.col(id_col).alias("_id"), "strategy", right.alias("_right"))
    per_pair = flagged.groupBy("_id").agg(  # a pair's rows: one per strategy
        F.array_sort(F.collect_set("strategy")).alias("present"),
        F.array_sort(F.collect_set(F.when(F.col("_right"), F.col("strategy")))).alias("correct"))
    return per_pair.groupBy("present", "correct").agg(F.count(F.lit(1)).alias("n"))


def paired_counts(profiles: DataFrame, strategies: list[str] | None = None) -> DataFrame:
    """For each pair of strategies: rows in common and who was right on them."""
    names = strategies or domain.STRATEGIES
    pairs = F.array(*[F.struct(F.lit(a).alias("strategy_a"), F.lit(b).alias("strategy_b")) for a, b in combinations(names, 2)])
    rows = profiles.select("*", F.inline(pairs))
    rows = rows.where(F.array_contains("present", F.col("strategy_a")) & F.array_contains("present", F.col("strategy_b")))
    a = F.array_contains("correct", F.col("strategy_a"))
    b = F.array_contains("correct", F.col("strategy_b"))

    def total(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")

    return rows.groupBy("strategy_a", "strategy_b").agg(
        F.sum("n").alias("n_common"),
        total(a).alias("a_correct"), total(b).alias("b_correct"),
        total(a & ~b).alias("a_only_correct"), total(~a & b).alias("b_only_correct"))


def mcnemar(pair_counts: DataFrame) -> DataFrame:
    """Continuity-corrected McNemar statistic and its significance at 5 percent."""
    b, c = F.col("a_only_correct"), F.col("b_only_correct")
    stat = F.coalesce(F.try_divide(F.pow(F.abs(b - c) - 1, F.lit(2.0)), b + c), F.lit(0.0))
    return pair_counts.withColumn("statistic", stat).withColumn(
        "significant", F.col("statistic") > domain.CHI2_1DF_95)


def with_p_value(df: DataFrame, statistic: str = "statistic") -> DataFrame:
    """Chi-square (1 df) p-value."""
    return df.withColumn("p_value", chi_square_tail(F.col(statistic)))


# --- relative improvement, best strategy -----------------------------------------------------------

def improvement(comparison: DataFrame, better: str = "cot", base: str = "zero-shot",
                metric: str = "accuracy") -> DataFrame:
    """Relative gain of one strategy over another, in percent."""
    wide = comparison.agg(*[F.max(F.when(F.col("strategy") == s, F.col(metric))).alias(a)
                            for s, a in ((better, "better"), (base, "base"))])
    return wide.withColumn("improvement_pct", F.try_divide((F.col("better") - F.col("base")) * 100, F.col("base")))


def best_strategy(comparison: DataFrame, metric: str = "accuracy") -> DataFrame:
    return comparison.orderBy(F.col(metric).desc(), "strategy").limit(1).select("strategy", metric)
