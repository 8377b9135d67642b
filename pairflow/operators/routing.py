"""Routing of pairs to strategies, by rule or by difficulty score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairflow import domain
from pairflow.functions.lookup import lookup

NO_MODEL_REASON = "No classifier available, using default strategy"


# --- rule routing --------------------------------------------------------------------------

def rule_route(genre: Column | None, chars: Column | None, negations: Column | None, overlap: Column | None,
               length: int = 220, min_negations: int = 3, max_overlap: float = 0.4) -> Column:
    """Strategy by fixed rule. An absent or null feature counts as 0 characters, 0 negations, overlap 1."""
    def default(col: Column | None, value) -> Column:
        return F.lit(value) if col is None else F.coalesce(col, F.lit(value))

    genre = default(genre, "unknown")
    complex_pair = ((default(chars, 0) > length) & (default(negations, 0) >= min_negations)
                    & (default(overlap, 1.0) < max_overlap))
    return (F.when(F.lower(genre).isin(domain.HYBRID_GENRES), F.lit("6-shot-cot"))
            .when(complex_pair, F.lit("6-shot")).otherwise(F.lit("zero-shot")))


def route_by_rule(df: DataFrame, length: int = 220, negations: int = 3, overlap: float = 0.4,
                  output: str = "routed_strategy") -> DataFrame:
    def col(name: str) -> Column | None:
        return F.col(name) if name in df.columns else None

    return df.withColumn(output, rule_route(
        col("genre"), col("char_length"), col("total_negations"), col("lexical_overlap"),
        length, negations, overlap))


# --- score routing -------------------------------------------------------------------------

def score_confidence(score: Column) -> Column:
    """Probability of the likelier of the two classes."""
    return F.greatest(score, 1 - score)


def binary_strategy(score: Column, confidence: Column, hard: float = 0.6, min_confidence: float = 0.7) -> Column:
    easy = (score < hard) & (confidence > min_confidence)
    return F.when(easy, F.lit("zero-shot")).otherwise(F.lit("cot"))


def tiered_strategy(score: Column, confidence: Column, hard: float = 0.6, min_confidence: float = 0.7,
                    easy: float = 0.3) -> Column:
    return (F.when((score < easy) & (confidence > min_confidence), F.lit("zero-shot"))
            .when(score > hard, F.lit("cot")).otherwise(F.lit("few-shot")))


def routing_reason(strategy: Column, score: Column, confidence: Column, tiered: bool = True) -> Column:
    """Explanation of the decision, with two decimals."""
    if not tiered:
        return F.when(strategy == "zero-shot", F.format_string(
            "Low difficulty (%.2f) with high confidence (%.2f)", score, confidence)).otherwise(F.format_string(
                "High difficulty (%.2f) or low confidence (%.2f)", score, confidence))
    return (F.when(strategy == "zero-shot", F.format_string("Easy query (score=%.2f, conf=%.2f)", score, confidence))
            .when(strategy == "cot", F.format_string("Hard query (score=%.2f), using reasoning", score))
            .otherwise(F.format_string("Medium difficulty (score=%.2f), using examples", score)))


def route_by_score(df: DataFrame, score: str | Column | None = "difficulty_score", tiered: bool = True,
                   hard: float = 0.6, min_confidence: float = 0.7) -> DataFrame:
    """Adds the five routing columns. A row without a score takes the middle strategy."""
    raw = F.lit(None).cast("double") if score is None else (F.col(score) if isinstance(score, str) else score)
    staged = df.withColumn("_score", raw.cast("double"))
    s = F.col("_score")
    staged = staged.withColumn("_conf", score_confidence(s))
    conf = F.col("_conf")
    decide = tiered_strategy if tiered else binary_strategy
    staged = staged.withColumn("routed_strategy", F.when(s.isNull(), F.lit("few-shot")).otherwise(
        decide(s, conf, hard, min_confidence)))
    strategy = F.col("routed_strategy")
    return staged.withColumns({
        "difficulty_score": F.coalesce(s, F.lit(0.5)),
        "routing_confidence": F.coalesce(conf, F.lit(0.5)),
        "routing_reasoning": F.when(s.isNull(), F.lit(NO_MODEL_REASON)).otherwise(
            routing_reason(strategy, s, conf, tiered)),
        "estimated_tokens": lookup(strategy, domain.ROUTER_TOKENS, dtype="int"),
        "has_model": s.isNotNull(),
    }).drop("_score", "_conf")


# --- summaries -----------------------------------------------------------------------------

def distribution(df: DataFrame, strategy: str = "routed_strategy") -> DataFrame:
    """Rows and share of each strategy (window over one row per strategy)."""
    counts = df.groupBy(strategy).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))


def routing_savings(df: DataFrame, baseline: str = "cot") -> DataFrame:
    """Per strategy: count and percent, with the table's token totals against the baseline."""
    per = df.groupBy("routed_strategy").agg(
        F.count(F.lit(1)).alias("n"), F.sum("estimated_tokens").cast("long").alias("tokens"))
    everything = W.partitionBy()
    staged = per.withColumns({
        "n_queries": F.sum("n").over(everything),
        "adaptive_tokens": F.sum("tokens").over(everything),
    }).withColumn("baseline_tokens", F.col("n_queries") * domain.ROUTER_TOKENS[baseline])
    saved = F.col("baseline_tokens") - F.col("adaptive_tokens")
    return staged.withColumns({
        "tokens_saved": saved,
        "savings_pct": F.try_divide(saved * 100.0, F.col("baseline_tokens")),
        "strategy_pct": F.try_divide(F.col("n") * 100.0, F.col("n_queries")),
    }).drop("tokens")


def routing_counters(df: DataFrame, baseline: str = "cot") -> DataFrame:
    """Additive counters per strategy; works on batch and streaming tables alike.

    Rows routed without a model are not counted.
    """
    base = domain.ROUTER_TOKENS[baseline]
    tracked = df.where("has_model") if "has_model" in df.columns else df
    return tracked.groupBy("routed_strategy").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("estimated_tokens").cast("long").alias("tokens_spent"),
        F.sum(F.greatest(F.lit(0), F.lit(base) - F.col("estimated_tokens"))).cast("long").alias("tokens_saved"))


def routing_summary(counters: DataFrame) -> DataFrame:
    """Shares and the saved ratio from the counters."""
    everything = W.partitionBy()
    staged = counters.withColumns({
        "total_queries": F.sum("n").over(everything),
        "total_spent": F.sum("tokens_spent").over(everything),
        "total_saved": F.sum("tokens_saved").over(everything),
    })
    return staged.withColumns({
        "share": F.col("n") / F.greatest(F.col("total_queries"), F.lit(1)),
        "savings_ratio": F.col("total_saved") / F.greatest(F.col("total_spent") + F.col("total_saved"), F.lit(1)),
    }).drop("tokens_spent", "tokens_saved")


def share_within_genre(df: DataFrame, strategies: list[str] | None = None) -> DataFrame:
    """Row-normalised genre x strategy table, one column per strategy."""
    names = strategies or domain.STRATEGIES
    counts = df.groupBy("genre").pivot("routed_strategy", names).count().fillna(0, names)
    total = sum((F.col(f"`{s}`") for s in names), F.lit(0))
    return counts.select("genre", *[(F.col(f"`{s}`") / total).alias(s.replace("-", "_")) for s in names])
