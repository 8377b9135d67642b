"""Difficulty model: predicts whether the cheap strategy will fail on a pair."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairflow import domain
from pairflow.functions.features import require_features
from pairflow.operators import logistic
from pairflow.operators import metrics as M
from pairflow.operators.selection import with_group_rank
from pairflow.workspace import literal_table, materialize


def hard_target(label: Column, prediction: Column) -> Column:
    """1 if the zero-shot prediction was wrong or missing."""
    return F.when(F.coalesce(label == prediction, F.lit(False)), 0).otherwise(1)


def training_rows(features: DataFrame, predictions: DataFrame, strategy: str = "zero-shot",
                  required: tuple[str, ...] = ("zero-shot", "cot")) -> DataFrame:
    """Feature rows with their target; pairs without all required strategies are left out.

    The target compares the prediction with the label stored next to it.
    """
    wrong = hard_target(F.col("label"), F.col("predicted_label"))
    has = {s: F.max(F.when(F.col("strategy") == s, F.lit(1))).alias(f"has {s}") for s in required}
    per_pair = predictions.where(F.col("strategy").isin(list({strategy, *required}))).groupBy("pairID").agg(
        F.max(F.when(F.col("strategy") == strategy, wrong)).alias("target"), *has.values())
    for s in required:
        per_pair = per_pair.where(F.col(f"`has {s}`").isNotNull())
    return features.join(per_pair.select("pairID", "target"), "pairID")


def require_strategies(predictions: DataFrame, required: tuple[str, ...] = ("zero-shot", "cot")) -> None:
    """Fail early, with a clear message, if a strategy the training needs was never run."""
    names = predictions.where(F.col("strategy").isin(list(required))).select("strategy").distinct()
    present = {r.strategy for r in names.collect()}  # at most len(required) rows
    missing = [s for s in required if s not in present]
    if missing:
        raise ValueError(f"training needs results of: {', '.join(missing)}")


@dataclass(frozen=True)
class Scaling:
    names: list[str]
    mean: list[float]
    std: list[float]

    def apply(self, df: DataFrame) -> DataFrame:
        scaled = {f"{c}_z": (F.col(c).cast("double") - m) / s for c, m, s in zip(self.names, self.mean, self.std)}
        return df.withColumns(scaled)

    @property
    def columns(self) -> list[str]:
        return [f"{c}_z" for c in self.names]


def scaling_table(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Mean and population standard deviation of each feature, by one aggregate."""
    names = require_features(df, names)
    wide = df.agg(*[e.alias(f"{c}|{s}") for c in names for s, e in {
        "mean": F.avg(F.col(c).cast("double")), "std": F.stddev_pop(F.col(c).cast("double"))}.items()])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"`{c}|mean`").alias("mean"), F.col(f"`{c}|std`").alias("std"))
        for c in names])))


def fit_scaling(df: DataFrame, names: list[str] | None = None) -> Scaling:
    """A feature without spread is only centred."""
    names = require_features(df, names)
    rows = {r.feature: r for r in scaling_table(df, names).collect()}  # one row per feature
    return Scaling(names, [rows[c].mean for c in names], [rows[c].std or 1.0 for c in names])


def standardised(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    return fit_scaling(df, names).apply(df)


INTERCEPT = "(intercept)"
MODEL_SCHEMA = "position int, feature string, mean double, std double, weight double"


@dataclass
class DifficultyModel:
    scaling: Scaling
    coefficients: list[float]
    intercept: float
    sizes: dict[int, int]

    def p_hard(self) -> Column:
        """The score as one column expression over the features."""
        terms = [(F.col(c).cast("double") - m) / s * w
                 for c, m, s, w in zip(self.scaling.names, self.scaling.mean, self.scaling.std, self.coefficients)]
        return 1 / (1 + F.exp(-sum(terms, F.lit(self.intercept))))

    def slopes(self) -> list[float]:
        """Intercept and weights for features as they are."""
        s = self.scaling
        own = [w / d for w, d in zip(self.coefficients, s.std)]
        return [self.intercept - sum(w * m for w, m in zip(own, s.mean)), *own]

    def score(self, df: DataFrame) -> DataFrame:
        """Adds predicted_difficulty (0 or 1), p_easy, p_hard and difficulty_score, in one pass."""
        require_features(df, self.scaling.names)
        return df.select("*", self.p_hard().alias("_p")).select(*df.columns, *_scores())

    def table(self, spark: SparkSession) -> DataFrame:
        """The model as rows: position, feature, mean, std, weight; the intercept comes first."""
        s = self.scaling
        return literal_table(spark, [(0, INTERCEPT, 0.0, 1.0, self.intercept), *zip(
            range(1, len(s.names) + 1), s.names, s.mean, s.std, self.coefficients)],
            dict(f.split() for f in MODEL_SCHEMA.split(", ")))

    def importance(self, spark: SparkSession, k: int | None = None) -> DataFrame:
        """Signed coefficients, by absolute value; the first k if given."""
        table = self.table(spark).where(F.col("position") > 0).select("feature", F.col("weight").alias("importance"))
        ordered = table.orderBy(F.abs("importance").desc(), "feature")
        return ordered.limit(k) if k else ordered

    def save(self, spark: SparkSession, path: str, cv: DataFrame | None = None) -> None:
        """Tables anyone can read: coefficients with the scaling, class sizes, settings; cv: a cross-validation report."""
        self.table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/coefficients")
        literal_table(spark, sorted(self.sizes.items()), {"target": "int", "n": "long"}).coalesce(1).write.mode(
            "overwrite").parquet(f"{path}/classes")
        meta = json.dumps({"penalty": "l2", "inverse_strength": 1.0, "class_weight": "balanced", "solver": "newton"})
        spark.range(1).select(F.lit(meta).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/settings")
        if cv is not None:
            cv.write.mode("overwrite").parquet(f"{path}/cv")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "DifficultyModel":
        rows = spark.read.schema(MODEL_SCHEMA).parquet(f"{path}/coefficients").orderBy("position").collect()
        features = rows[1:]
        scaling = Scaling([r.feature for r in features], [r.mean for r in features], [r.std for r in features])
        sizes = {r.target: r.n for r in spark.read.parquet(f"{path}/classes").collect()}
        return cls(scaling, [r.weight for r in features], rows[0].weight, sizes)


def _scores() -> list[Column]:
    """Score columns from _p."""
    p = F.col("_p")
    return [(p > 0.5).cast("int").alias("predicted_difficulty"), (1 - p).alias("p_easy"), p.alias("p_hard"),
            p.alias("difficulty_score")]


def _model(names: list[str], fitted: logistic.Fit) -> DifficultyModel:
    numbers = lambda values: [float(v) for v in values]
    return DifficultyModel(Scaling(names, numbers(fitted.mean), numbers(fitted.std)), numbers(fitted.beta[1:]),
                           float(fitted.beta[0]), dict(fitted.sizes))


def fit(df: DataFrame, names: list[str] | None = None) -> DifficultyModel:
    """L2 logistic regression with balanced class weights, on rows with a target; needs both classes."""
    names = require_features(df, names)
    rows = materialize(df.select("target", *names), "training")
    return _model(names, logistic.fit_all(rows, names, [None])[0])


def with_folds(df: DataFrame, n_folds: int = 5, seed: int = 42, by_genre: bool = False) -> DataFrame:
    """Stratified folds: rows of each class are dealt out in hash order."""
    keys = ["target", "genre"] if by_genre else ["target"]
    return with_group_rank(df, keys, "_rank", seed=seed).withColumn(
        "fold", (F.col("_rank") % n_folds).cast("int")).drop("_rank")


def out_of_fold(df: DataFrame, n_folds: int = 5, seed: int = 42, by_genre: bool = False,
                scale_per_fold: bool = False, names: list[str] | None = None) -> DataFrame:
    """Each row scored by the model fitted on the other folds.

    The narrow training table (id, target, features, fold) is written once; all folds are fitted in the same passes
    over it and one more pass scores every row by its own fold's model. By default features are scaled over all rows
    before folding; scale_per_fold avoids that leak.
    """
    names = require_features(df, names)
    keep = ["pairID", "genre", "target"]
    rows = materialize(df.select(*keep, *names), "training")
    table = materialize(with_folds(rows, n_folds, seed, by_genre), "folds")
    models = [_model(names, m) for m in logistic.fit_all(
        table, names, list(range(n_folds)), "fold", own_scaling=scale_per_fold)]
    weights = F.get(F.array(*[F.array(*[F.lit(x) for x in m.slopes()]) for m in models]), F.col("fold"))
    margin = sum((F.col(c).cast("double") * F.get("_m", F.lit(j)) for j, c in enumerate(names, 1)), F.get("_m", F.lit(0)))
    return (table.select("*", weights.alias("_m")).select(*keep, "fold", (1 / (1 + F.exp(-margin))).alias("_p"))
            .select(*keep, "fold", *_scores()).drop("difficulty_score"))


def cv_report(oof: DataFrame) -> DataFrame:
    return M.metrics(_as_labels(oof))


def cv_class_report(oof: DataFrame) -> DataFrame:
    return M.per_class(M.outcome_counts(_as_labels(oof)))


def _as_labels(oof: DataFrame) -> DataFrame:
    return oof.select(F.col("target").cast("string").alias("label"),
                      F.col("predicted_difficulty").cast("string").alias("predicted_label"))


def training_summary(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_samples"), F.sum("target").alias("n_hard"),
                  F.sum(1 - F.col("target")).alias("n_easy"))


def difficulty_by_genre(scored: DataFrame, key: str = "genre") -> DataFrame:
    """Hard share and score spread per genre, to three decimals (half to even)."""
    score = F.col("difficulty_score")
    out = scored.groupBy(key).agg(
        F.bround(F.avg("predicted_difficulty"), 3).alias("hard_ratio"),
        F.sum("predicted_difficulty").alias("hard_count"), F.count(F.lit(1)).alias("total"),
        F.bround(F.avg(score), 3).alias("avg_score"), F.bround(F.stddev_samp(score), 3).alias("std_score"),
        F.bround(F.min(score), 3).alias("min_score"), F.bround(F.max(score), 3).alias("max_score"))
    return out.orderBy(F.col("hard_ratio").desc(), key)
