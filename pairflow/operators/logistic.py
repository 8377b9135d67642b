"""Logistic regression by Newton steps, each one aggregate over the rows for all models at once.

A model leaves out the rows of one fold, or none. A row is repeated for the models it trains, which differ only in
their coefficients; gradient, curvature and loss of every model are sums of columns, combined before the shuffle, so a
step sends the driver one short row per model whatever the table's size. The loss is convex and the steps are shortened
until it falls, so a handful of passes is enough.

Minimised is  sum(w * log loss) + |weights|^2 / 2  with balanced class weights w = n / (2 n_class); features are
standardised, the intercept is free.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_STEPS = 100
# Of the last step that is taken. A Newton step squares the error, so another pass would change no digit that is reported.
TOLERANCE = 1e-7


@dataclass
class Moments:
    """Rows, means and sums of squared deviations of some rows."""

    n: int
    mean: np.ndarray
    squares: np.ndarray

    def plus(self, other: "Moments") -> "Moments":
        n = self.n + other.n
        if not n:
            return self
        gap = other.mean - self.mean
        return Moments(n, self.mean + gap * other.n / n, self.squares + other.squares + gap**2 * self.n * other.n / n)

    @property
    def std(self) -> np.ndarray:
        """Population standard deviation; 1 for a feature without spread, which is only centred."""
        spread = np.sqrt(self.squares / max(self.n, 1))
        return np.where(spread > 0, spread, 1.0)


@dataclass
class Fit:
    """A model in training: weights of features standardised by mean and std, intercept first."""

    left_out: int | None
    sizes: dict[int, int]
    mean: np.ndarray
    std: np.ndarray
    beta: np.ndarray = field(default_factory=lambda: np.zeros(0))
    base: np.ndarray = field(default_factory=lambda: np.zeros(0))
    step: np.ndarray = field(default_factory=lambda: np.zeros(0))
    loss: float = np.inf
    done: bool = False


def moments(df: DataFrame, names: list[str], fold: str | None, target: str) -> dict[tuple[int | None, int], Moments]:
    """By fold and class: as many rows as there are folds and classes, from one aggregate."""
    keys = [*([fold] if fold else []), target]
    value = lambda c: F.col(f"`{c}`").cast("double")
    rows = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(value(c)) for c in names]).alias("m"),
                                 F.array(*[F.var_pop(value(c)) for c in names]).alias("v")).collect()
    return {(r[fold] if fold else None, r[target]): Moments(r.n, np.array(r.m, float), np.array(r.v, float) * r.n) for r in rows}


def _total(parts: dict[tuple[int | None, int], Moments], width: int, left_out: int | None) -> tuple[Moments, dict[int, int]]:
    """All rows but the left-out fold's."""
    total, sizes = Moments(0, np.zeros(width), np.zeros(width)), {}
    for (fold, cls), part in sorted(parts.items(), key=str):
        if left_out is None or fold != left_out:
            total = total.plus(part)
            sizes[cls] = sizes.get(cls, 0) + part.n
    return total, sizes


def fit_all(df: DataFrame, names: list[str], left_out: list[int | None], fold: str | None = None,
            target: str = "target", own_scaling: bool = False) -> list[Fit]:
    """One model for each entry of left_out (a fold whose rows it does not see, or None for all rows).

    df is read a few times: hand in a stored table. own_scaling: features are standardised over a model's own rows
    instead of over all of them.
    """
    parts = moments(df, names, fold, target)
    everything, _ = _total(parts, len(names), None)
    models = []
    for k in left_out:
        own, sizes = _total(parts, len(names), k)
        if len(sizes) < 2:
            raise ValueError("training needs both easy and hard rows" + ("" if k is None else f", also without fold {k}"))
        scale = own if own_scaling else everything
        models.append(Fit(k, sizes, scale.mean, scale.std, *(np.zeros(len(names) + 1) for _ in range(3))))
    # Sums are taken over features standardised by all rows; a model's own scaling is an affine step from there.
    shared = [(F.col(f"`{c}`").cast("double") - float(m)) / float(s) for c, m, s in zip(names, everything.mean, everything.std)]
    rows = df.select(F.col(target).cast("double").alias("_y"), *([F.col(fold).alias("_fold")] if fold else []),
                     *[z.alias(f"_z{j}") for j, z in enumerate(shared, 1)])
    for _ in range(MAX_STEPS):
        _step(rows, models, everything, fold is not None)
        if all(m.done for m in models):
            return models
    raise RuntimeError(f"no convergence in {MAX_STEPS} steps")


def _affine(model: Fit, everything: Moments) -> np.ndarray:
    """Matrix from (1, features standardised by all rows) to (1, features standardised by the model)."""
    p = len(model.mean)
    out = np.eye(p + 1)
    out[1:, 0] = (everything.mean - model.mean) / model.std
    out[np.arange(1, p + 1), np.arange(1, p + 1)] = everything.std / model.std
    return out


def _sums(rows: DataFrame, models: list[Fit], everything: Moments, folded: bool) -> dict[int, list[float]]:
    p = len(everything.mean)
    todo = [(i, m) for i, m in enumerate(models) if not m.done]
    # A constant array reaches the compiled code by reference, so every step runs the code of the first.
    settings = F.array(*[F.struct(
        F.lit(i).alias("_model"), F.lit(-1 if m.left_out is None else m.left_out).alias("_out"),
        F.array(*[F.lit(float(x)) for x in _affine(m, everything).T @ m.beta]).alias("_c"),
        *[F.lit(sum(m.sizes.values()) / (2 * m.sizes[k])).alias(f"_w{k}") for k in (0, 1)]) for i, m in todo])
    z: list[Column] = [F.lit(1.0), *[F.col(f"_z{j}") for j in range(1, p + 1)]]
    spread = rows.select("*", F.inline(settings))
    if folded:
        spread = spread.where(F.col("_fold") != F.col("_out"))
    margin = sum((F.get("_c", F.lit(j)) * z[j] for j in range(1, p + 1)), F.get("_c", F.lit(0)))
    staged = spread.select("_model", "_y", *[f"_z{j}" for j in range(1, p + 1)], margin.alias("_t"),
                           F.when(F.col("_y") == 1, F.col("_w1")).otherwise(F.col("_w0")).alias("_w"))
    chance = 1 / (1 + F.exp(-F.col("_t")))
    signed = F.col("_t") * (2 * F.col("_y") - 1)
    staged = staged.select(
        "_model", *[f"_z{j}" for j in range(1, p + 1)], (F.col("_w") * (F.col("_y") - chance)).alias("_e"),
        (F.col("_w") * chance * (1 - chance)).alias("_h"),
        (F.col("_w") * (F.log1p(F.exp(-F.abs(signed))) + F.greatest(-signed, F.lit(0.0)))).alias("_loss"))
    sums = [F.sum("_loss"), *[F.sum(F.col("_e") * z[i]) for i in range(p + 1)],
            *[F.sum(F.col("_h") * z[i] * z[j]) for i in range(p + 1) for j in range(i, p + 1)]]
    return {r[0]: list(r[1:]) for r in staged.groupBy("_model").agg(*sums).collect()}


def _step(rows: DataFrame, models: list[Fit], everything: Moments, folded: bool) -> None:
    p = len(everything.mean)
    penalty = np.eye(p + 1)
    penalty[0, 0] = 0
    upper = np.triu_indices(p + 1)
    for i, sums in _sums(rows, models, everything, folded).items():
        m = models[i]
        loss = sums[0] + m.beta[1:] @ m.beta[1:] / 2
        if loss > m.loss + 1e-12 * abs(m.loss):  # too far: half the way
            m.step = m.step / 2
            m.beta = m.base + m.step
            continue
        to_own = _affine(m, everything)
        curve = np.zeros((p + 1, p + 1))
        curve[upper] = sums[p + 2:]
        curve = curve + np.triu(curve, 1).T
        slope = to_own @ np.array(sums[1:p + 2]) - penalty @ m.beta
        m.loss, m.base = loss, m.beta
        m.step = np.linalg.solve(to_own @ curve @ to_own.T + penalty, slope)
        m.beta = m.base + m.step
        m.done = bool(np.abs(m.step).max() < TOLERANCE * max(1.0, np.abs(m.beta).max()))
