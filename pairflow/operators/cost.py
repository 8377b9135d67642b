"""Token and price accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairflow import domain
from pairflow.functions.lookup import lookup
from pairflow.operators.ranges import rising_steps
from pairflow.workspace import literal_table, materialize

Tokens = dict[str, tuple[int, int]]

# Steps of a frontier that are sent to every task: blocks of some 30 MB.
STEP_BLOCK, STEP_BLOCKS = 1_000_000, 4


def token_price(input_tokens: Column, output_tokens: Column, model: str | Column = domain.DEFAULT_MODEL) -> Column:
    """USD for a number of input and output tokens; model may be a column."""
    if isinstance(model, str):
        p_in, p_out = (F.lit(p) for p in domain.PRICES[model])
    else:
        p_in = lookup(model, {m: p[0] for m, p in domain.PRICES.items()})
        p_out = lookup(model, {m: p[1] for m, p in domain.PRICES.items()})
    return input_tokens / 1000 * p_in + output_tokens / 1000 * p_out


def price_table(spark) -> DataFrame:
    return literal_table(spark, [(m, *p) for m, p in domain.PRICES.items()], {
        "model": "string", "input_price_per_1k": "double", "output_price_per_1k": "double"})


def token_table(spark, tokens: Tokens | None = None) -> DataFrame:
    return literal_table(spark, [(s, *t) for s, t in (tokens or domain.COST_TOKENS).items()], {
        "strategy": "string", "input": "int", "output": "int"})


def with_strategy_cost(df: DataFrame, n: str = "n", tokens: Tokens | None = None,
                       default: tuple[int, int] = domain.COST_TOKENS_DEFAULT,
                       model: str = domain.DEFAULT_MODEL) -> DataFrame:
    """Cost columns for a table of (strategy, n samples); unknown strategies use the default estimate."""
    est = tokens or domain.COST_TOKENS
    strategy, count = F.col("strategy"), F.col(n)
    staged = df.withColumns({
        "input_tokens": lookup(strategy, {s: t[0] for s, t in est.items()}, default[0], "long") * count,
        "output_tokens": lookup(strategy, {s: t[1] for s, t in est.items()}, default[1], "long") * count,
    })
    staged = staged.withColumns({
        "total_tokens": F.col("input_tokens") + F.col("output_tokens"),
        "cost_usd": token_price(F.col("input_tokens"), F.col("output_tokens"), model),
    })
    return staged.withColumn("cost_per_sample", F.when(
        count > 0, F.try_divide(F.col("cost_usd"), count)).otherwise(F.lit(0.0)))


def sample_size_per_strategy(df: DataFrame, strategies: list[str] | None = None) -> DataFrame:
    """(strategy, n) with n the size of the table, for planning costs of strategies not yet run."""
    names = F.array(*[F.lit(s) for s in (strategies or domain.BASE_STRATEGIES)])
    return df.agg(F.count(F.lit(1)).alias("n")).select(F.explode(names).alias("strategy"), "n")


def cost_comparison(df: DataFrame, **options) -> DataFrame:
    """As with_strategy_cost, cheapest first, with the cost relative to the cheapest."""
    costed = with_strategy_cost(df, **options)
    return costed.withColumn("relative_cost", F.try_divide(
        F.col("cost_usd"), F.min("cost_usd").over(W.partitionBy()))).orderBy("cost_usd", "strategy")


def adaptive_savings(distribution: DataFrame, baseline: str = "cot", **options) -> DataFrame:
    """Cost and tokens of a routing distribution (strategy, n) against one strategy for all rows."""
    total = with_strategy_cost(distribution, **options).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_samples"),
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("adaptive_cost_usd"),
        F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("adaptive_tokens"))
    base = with_strategy_cost(total.withColumn("strategy", F.lit(baseline)), n="total_samples", **options)
    saved = F.col("baseline_cost_usd") - F.col("adaptive_cost_usd")
    token_saved = F.col("baseline_tokens") - F.col("adaptive_tokens")
    return base.select(
        "total_samples", "adaptive_cost_usd", "adaptive_tokens",
        F.col("cost_usd").alias("baseline_cost_usd"), F.col("total_tokens").alias("baseline_tokens"),
    ).withColumns({
        "cost_savings_usd": saved,
        "cost_savings_pct": F.coalesce(F.try_divide(saved, F.col("baseline_cost_usd")), F.lit(0.0)) * 100,
        "token_savings": token_saved,
        "token_savings_pct": F.coalesce(F.try_divide(token_saved, F.col("baseline_tokens")), F.lit(0.0)) * 100,
    })


# --- cost-accuracy frontier ----------------------------------------------------------------------

def cost_accuracy(comparison: DataFrame, n: str = "n_samples", **options) -> DataFrame:
    """Strategy metrics with cost, efficiency and the Pareto flag, cheapest first."""
    costed = with_strategy_cost(comparison.select("strategy", "accuracy", "macro_f1", n), n=n, **options)
    table = costed.select(
        "strategy", "accuracy", "macro_f1", "cost_usd", "total_tokens", "cost_per_sample",
        F.try_divide(F.col("accuracy"), F.col("cost_usd")).alias("efficiency"))
    return with_pareto_flag(table).orderBy("cost_usd", "strategy")


def with_pareto_flag(df: DataFrame, cost: str = "cost_usd", value: str = "accuracy",
                     output: str = "pareto_optimal") -> DataFrame:
    """False where another row is at least as good on both counts and better on one; ties all stay.

    Suits tables of strategies and tables of many items alike. The rows that stay are those at a step of the running
    maximum of the best value per cost; the steps are found over ranges of the costs and the rows look themselves up
    among them. Up to STEP_BLOCKS blocks of STEP_BLOCK steps are sent to the tasks, after a count, so the rows are
    not shuffled; more steps than that meet the rows in a shuffle join. A row without a cost or value stays.
    """
    points = df.groupBy(F.col(cost).alias("_c")).agg(F.max(value).alias("_v")).where(
        F.col("_c").isNotNull() & ~F.isnan(F.col("_c").cast("double")) & F.col("_v").isNotNull())
    steps = materialize(rising_steps(points, "_c", "_v"), "steps")
    own = (F.col(cost) == F.col("_c")) & (F.col(value) == F.col("_v"))
    free = F.col(cost).isNull() | F.isnan(F.col(cost).cast("double")) | F.col(value).isNull()
    n = steps.count()
    blocks = -(-n // STEP_BLOCK)
    if blocks > STEP_BLOCKS:
        return df.join(steps, own, "left").withColumn(output, free | F.col("_c").isNotNull()).drop("_c", "_v")
    out, kept = df, free
    for k in range(blocks):
        block = steps.where(F.pmod(F.xxhash64("_c"), F.lit(blocks)) == k).select("_c", "_v", F.lit(True).alias(f"_at{k}"))
        out = out.join(F.broadcast(block), own, "left").drop("_c", "_v")
        kept = kept | F.col(f"_at{k}").isNotNull()
    return out.withColumn(output, kept).drop(*[f"_at{k}" for k in range(blocks)])


def undominated(df: DataFrame, cost: str = "cost_usd", value: str = "accuracy") -> DataFrame:
    """Rows for which no better row exists: the anti-join on inequalities, without its pairs."""
    return with_pareto_flag(df, cost, value, "_keep").where("_keep").drop("_keep")


def pareto_points(frontier: DataFrame) -> DataFrame:
    return frontier.where("pareto_optimal").orderBy("cost_usd", "strategy")


# --- budget, ROI, plans ------------------------------------------------------------------------------

def budget_projection(weights: DataFrame, budget_usd: float, **options) -> DataFrame:
    """Samples a budget pays for under (strategy, weight), in total and per strategy."""
    unit = with_strategy_cost(weights.withColumn("_one", F.lit(1).cast("long")), n="_one", **options)
    average = F.sum(F.col("cost_per_sample") * F.col("weight")).over(W.partitionBy())
    staged = unit.withColumn("avg_cost_per_sample", average)
    staged = staged.withColumn("max_samples", F.when(
        F.col("avg_cost_per_sample") > 0, F.floor(F.try_divide(F.lit(float(budget_usd)), F.col("avg_cost_per_sample")))
    ).otherwise(F.lit(0)).cast("long"))
    return staged.select(
        "strategy", "weight", F.lit(float(budget_usd)).alias("budget_usd"), "avg_cost_per_sample", "max_samples",
        F.floor(F.col("max_samples") * F.col("weight")).cast("long").alias("strategy_samples"))


def equal_weights(strategies: DataFrame) -> DataFrame:
    return strategies.withColumn("weight", F.lit(1.0) / F.count(F.lit(1)).over(W.partitionBy()))


def token_roi(df: DataFrame, routed: str = "routed_strategy", reference: str = "6-shot",
              fallback: float = domain.ROI_FALLBACK_TOKENS) -> DataFrame:
    """Savings against giving every row the reference strategy at its measured mean tokens.

    baseline_source tells whether that mean was measured or is the fallback constant.
    """
    ref = F.col(routed) == reference
    measured = F.avg(F.when(ref, F.col("prompt_tokens"))) + F.avg(F.when(ref, F.col("response_tokens")))
    totals = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum(F.col("prompt_tokens") + F.col("response_tokens")), F.lit(0)).alias("adaptive_tokens"),
        measured.alias("_measured"))
    staged = totals.withColumns({
        "baseline_source": F.when(F.col("_measured").isNull(), F.lit("fallback")).otherwise(F.lit("measured")),
        "baseline_tokens": F.col("n_rows") * F.coalesce(F.col("_measured"), F.lit(float(fallback))),
    }).drop("_measured")
    saved = F.col("baseline_tokens") - F.col("adaptive_tokens")
    return staged.withColumns({
        "savings_pct": F.try_divide(saved, F.col("baseline_tokens")) * 100,
        "savings_usd": saved * F.lit(domain.ROI_USD_PER_TOKEN),
    })


def planned_usage(df: DataFrame, n: str = "n") -> DataFrame:
    """Planned tokens and cost of (strategy, n), at the planner's own estimates and prices."""
    prompt = lookup("strategy", domain.PLANNED_PROMPT_TOKENS, domain.PLANNED_PROMPT_DEFAULT, "long")
    response = F.lit(domain.PLANNED_RESPONSE_TOKENS)
    count = F.col(n)
    return df.select(
        "strategy", count.alias("n"),
        (count * (prompt + response)).alias("estimated_tokens"),
        (count * prompt / 1000 * F.lit(domain.PLANNED_PRICE_INPUT_PER_1K)
         + count * response / 1000 * F.lit(domain.PLANNED_PRICE_OUTPUT_PER_1K)).alias("estimated_cost_usd"),
        (prompt + response).alias("tokens_per_sample"))


def usage_counters(df: DataFrame, key: str = "strategy") -> DataFrame:
    """Additive token counters; works on batch and streaming tables alike."""
    return df.groupBy(key).agg(
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("response_tokens").alias("response_tokens"),
        F.count(F.lit(1)).alias("calls"))


def usage_summary(counters: DataFrame, strategies: list[str] | None = None) -> DataFrame:
    """Usage by strategy, unused ones at zero, and a "total" row."""
    names = strategies or domain.BASE_STRATEGIES
    zeros = literal_table(counters.sparkSession, [(s, 0, 0, 0) for s in names], {
        "strategy": "string", "prompt_tokens": "long", "response_tokens": "long", "calls": "long"})
    rolled = counters.unionByName(zeros).rollup("strategy").agg(
        F.grouping("strategy").alias("_all"),
        *[F.sum(c).alias(c) for c in ("prompt_tokens", "response_tokens", "calls")])
    calls = F.greatest(F.col("calls"), F.lit(1))
    return rolled.select(
        F.when(F.col("_all") == 1, F.lit("total")).otherwise(F.col("strategy")).alias("strategy"),
        "prompt_tokens", "response_tokens", "calls",
        (F.col("prompt_tokens") + F.col("response_tokens")).alias("total_tokens"),
        (F.col("prompt_tokens") / calls).alias("avg_prompt_tokens"),
        (F.col("response_tokens") / calls).alias("avg_response_tokens"))


def measured_tokens(predictions: DataFrame, strategies: list[str] | None = None,
                    defaults: dict[str, int] | None = None) -> DataFrame:
    """Mean tokens of each strategy's calls; the default where none or zero was measured."""
    defaults = defaults or domain.REPLAY_TOKENS
    names = strategies or list(defaults)
    means = predictions.where(F.col("strategy").isin(names)).groupBy("strategy").agg(
        (F.avg("prompt_tokens") + F.avg("response_tokens")).alias("_mean"))
    known = literal_table(predictions.sparkSession, [(s,) for s in names], {"strategy": "string"})
    joined = known.join(means, "strategy", "left")
    return joined.select("strategy", F.coalesce(
        F.nullif(F.col("_mean"), F.lit(0.0)), lookup("strategy", defaults).cast("double")).alias("mean_tokens"))


def replay_savings(distribution: DataFrame, tokens: DataFrame, baseline: str = "cot") -> DataFrame:
    """Token savings of routed counts (strategy, n) at measured means, against one strategy for all."""
    joined = distribution.join(tokens, "strategy", "full")
    staged = joined.agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.col("n") * F.coalesce(F.col("mean_tokens"), F.lit(0.0))).alias("adaptive_tokens"),
        F.max(F.when(F.col("strategy") == baseline, F.col("mean_tokens"))).alias("_base"))
    staged = staged.withColumn("baseline_tokens", F.col("n_rows") * F.col("_base")).drop("_base")
    return staged.withColumn("savings_pct", F.try_divide(
        (F.col("baseline_tokens") - F.col("adaptive_tokens")) * 100, F.col("baseline_tokens")))
