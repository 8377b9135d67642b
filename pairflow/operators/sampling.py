"""Stratified samples and the train/test split, by hash order instead of a random generator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairflow import domain
from pairflow.functions.ordering import shuffle_key
from pairflow.operators.cleaning import clean, keep_valid_labels
from pairflow.operators.selection import GROUP_LIMIT, first_n, with_first_flag
from pairflow.workspace import literal_table


def label_quotas(per_genre: int) -> dict[str, int]:
    """Rows wanted per label: an equal share, the first labels taking the remainder."""
    base, rest = divmod(per_genre, len(domain.LABELS))
    return {label: base + (i < rest) for i, label in enumerate(domain.LABELS)}


def _quota_column(per_genre: int, label: Column) -> Column:
    out = F.lit(0)
    for name, quota in label_quotas(per_genre).items():
        out = F.when(label == name, F.lit(quota)).otherwise(out)
    return out


def stratified_sample(df: DataFrame, per_genre: int = 50, seed: int = 42, balance_labels: bool = True) -> DataFrame:
    """Up to per_genre rows of each genre; a short stratum contributes all it has."""
    if balance_labels:
        rows, keys, quota = keep_valid_labels(df), ["genre", "label"], _quota_column(per_genre, F.col("label"))
        largest = max(label_quotas(per_genre).values())
    else:
        rows, keys, quota, largest = df, ["genre"], F.lit(per_genre), per_genre
    if largest <= GROUP_LIMIT:
        return first_n(rows, keys, largest, seed=seed).where(F.col("_rn") <= quota).drop("_rn")
    flagged = with_first_flag(
        rows, keys, lambda sizes: sizes.withColumn("quota", quota), "_in", seed=seed)
    return flagged.where("_in").drop("_in")


def shuffled(df: DataFrame, seed: int = 42) -> DataFrame:
    """Random but reproducible total order, for the sink."""
    return df.orderBy(shuffle_key("pairID", seed), "pairID")


def short_strata(df: DataFrame, per_genre: int = 50, balance_labels: bool = True) -> DataFrame:
    """Strata with fewer rows than wanted, those without any row included."""
    if not balance_labels:
        sizes = df.groupBy("genre").agg(F.count(F.lit(1)).alias("available"))
        return sizes.withColumn("quota", F.lit(per_genre).cast("long")).where("available < quota")
    wanted = label_quotas(per_genre)
    sizes = df.groupBy("genre").agg(*[F.count_if(F.col("label") == l).alias(l) for l in wanted])
    strata = F.array(*[
        F.struct(F.lit(l).alias("label"), F.col(l).alias("available"), F.lit(q).cast("long").alias("quota"))
        for l, q in wanted.items()])
    return sizes.select("genre", F.inline(strata)).where("available < quota")


def test_quotas(sizes: DataFrame, test_size: float, keys: list[str]) -> DataFrame:
    """Test rows per stratum by largest remainder, so that they add up to ceil(test_size * N).

    sizes has one row per stratum, hence the windows without a partition.
    """
    everything = W.partitionBy()
    exact = F.col("n") * F.lit(float(test_size))
    staged = sizes.withColumns({"_floor": F.floor(exact), "_frac": exact - F.floor(exact)})
    staged = staged.withColumns({
        "_missing": F.ceil(F.sum("n").over(everything) * F.lit(float(test_size))) - F.sum("_floor").over(everything),
        "_place": F.row_number().over(W.orderBy(F.col("_frac").desc(), *keys)),
    })
    extra = (F.col("_place") <= F.col("_missing")).cast("long")
    return staged.withColumn("quota", F.col("_floor") + extra).drop("_floor", "_frac", "_missing", "_place")


def train_test_split(df: DataFrame, test_size: float = 0.3, seed: int = 42) -> DataFrame:
    """Adds split in {train, test}, stratified by genre and label."""
    keys = ["genre", "label"]
    flagged = with_first_flag(df, keys, lambda sizes: test_quotas(sizes, test_size, keys), "_test", seed=seed)
    return flagged.withColumn("split", F.when(F.col("_test"), F.lit("test")).otherwise(F.lit("train"))).drop("_test")


def prepare(df: DataFrame, per_genre: int = 50, test_size: float = 0.3, seed: int = 42) -> DataFrame:
    """Clean, sample and split."""
    return train_test_split(stratified_sample(clean(df), per_genre, seed), test_size, seed)


def with_full_split(df: DataFrame) -> DataFrame:
    """Each row once as part of `full` and once in its own split."""
    return df.withColumn("split", F.explode(F.array(F.lit("full"), F.col("split"))))


def one_per_genre(df: DataFrame, genres: list[str], seed: int = 42) -> DataFrame:
    return first_n(df.where(F.col("genre").isin(genres)), ["genre"], 1, seed=seed).drop("_rn")


def label_quota_table(spark, per_genre: int) -> DataFrame:
    return literal_table(spark, list(label_quotas(per_genre).items()), {"label": "string", "quota": "long"})
