"""Lexical features of a pair as flat columns."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairflow import domain
from pairflow.functions import text as T


def with_lengths(df: DataFrame, premise: str = "premise", hypothesis: str = "hypothesis",
                 mode: str = "simple") -> DataFrame:
    """Token and character lengths only."""
    return _lengths(_tokenised(df, premise, hypothesis, mode), premise, hypothesis).drop("_p", "_h")


def with_negations(df: DataFrame, premise: str = "premise", hypothesis: str = "hypothesis",
                   mode: str = "simple") -> DataFrame:
    return _negations(_tokenised(df, premise, hypothesis, mode)).drop("_p", "_h")


def with_overlap(df: DataFrame, premise: str = "premise", hypothesis: str = "hypothesis",
                 mode: str = "simple", remove_stopwords: bool = True) -> DataFrame:
    staged = _tokenised(df, premise, hypothesis, mode)
    return _overlap(staged, mode == "full" and remove_stopwords).drop("_p", "_h")


def with_features(df: DataFrame, premise: str = "premise", hypothesis: str = "hypothesis",
                  mode: str = "simple", remove_stopwords: bool = True) -> DataFrame:
    """All 13 features; columns of the same name are replaced, never duplicated.

    Each text is tokenised once; the token arrays live only between two projections of one stage.
    Stop words are removed before the overlap in "full" mode only.
    """
    staged = _tokenised(df.drop(*domain.FEATURES), premise, hypothesis, mode)
    staged = _lengths(staged, premise, hypothesis)
    staged = _negations(staged)
    staged = _overlap(staged, mode == "full" and remove_stopwords)
    kept = [c for c in df.columns if c not in domain.FEATURES]
    return staged.select(*kept, *domain.FEATURES)


def feature_matrix(df: DataFrame, names: list[str] | None = None, output: str = "features") -> DataFrame:
    """Assemble the model features into one vector column."""
    names = require_features(df, names)
    return VectorAssembler(inputCols=names, outputCol=output, handleInvalid="error").transform(df)


def select_features(df: DataFrame, *keep: str, names: list[str] | None = None) -> DataFrame:
    return df.select(*keep, *[F.col(c).cast("double").alias(c) for c in require_features(df, names)])


def require_features(df: DataFrame, names: list[str] | None = None) -> list[str]:
    names = names or domain.MODEL_FEATURES
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"Missing feature columns: {missing}")
    return names


def _tokenised(df: DataFrame, premise: str, hypothesis: str, mode: str) -> DataFrame:
    return df.withColumns({"_p": T.tokens(premise, mode), "_h": T.tokens(hypothesis, mode)})


def _lengths(df: DataFrame, premise: str, hypothesis: str) -> DataFrame:
    p, h = F.size("_p"), F.size("_h")
    return df.withColumns({
        "premise_length": p,
        "hypothesis_length": h,
        "combined_length": p + h,
        "length_ratio": h / F.greatest(p, F.lit(1)),
        "char_length": F.length(premise) + F.length(hypothesis),
    })


def _negations(df: DataFrame) -> DataFrame:
    p, h = T.negation_count("_p"), T.negation_count("_h")
    return df.withColumns({
        "premise_negations": p, "hypothesis_negations": h, "total_negations": p + h,
    })


def _overlap(df: DataFrame, remove_stopwords: bool) -> DataFrame:
    def token_set(name: str):
        return T.drop_stopwords(name) if remove_stopwords else F.array_distinct(name)

    sets = df.withColumns({"_ps": token_set("_p"), "_hs": token_set("_h")})
    sizes = sets.withColumns({
        "_np": F.size("_ps"), "_nh": F.size("_hs"),
        "shared_words": F.size(F.array_intersect("_ps", "_hs")),
    })
    shared = F.col("shared_words")
    # |P union H| = |P| + |H| - |P and H|
    union = F.greatest(F.col("_np") + F.col("_nh") - shared, F.lit(1))
    return sizes.withColumns({
        "jaccard_similarity": shared / union,
        "lexical_overlap": shared / union,
        "hypothesis_overlap": shared / F.greatest(F.col("_nh"), F.lit(1)),
        "premise_coverage": shared / F.greatest(F.col("_np"), F.lit(1)),
    }).drop("_ps", "_hs", "_np", "_nh")
