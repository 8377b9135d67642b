import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pairflow import domain
from pairflow.operators import cost, metrics, replay, reshape, routing
from pairflow.plans import adaptive, leaderboard, offline, study


# --- routing -----------------------------------------------------------------------------------

@pytest.mark.parametrize("chars,neg,overlap,genre,route", [
    (221, 3, 0.39, "fiction", "6-shot"), (220, 3, 0.39, "fiction", "zero-shot"), (221, 2, 0.39, "fiction", "zero-shot"),
    (221, 3, 0.4, "fiction", "zero-shot"), (1, 0, 1.0, "OUP", "6-shot-cot"), (None, None, None, None, "zero-shot"),
])
def test_rule_route(spark, chars, neg, overlap, genre, route):
    df = spark.createDataFrame([(chars, neg, overlap, genre)], "char_length int, total_negations int, lexical_overlap double, genre string")
    assert routing.route_by_rule(df).first().routed_strategy == route
    assert routing.route_by_rule(df.select("genre")).first().routed_strategy in ("zero-shot", "6-shot-cot")


@pytest.mark.parametrize("score,conf,tiered,binary", [
    (0.29, 0.71, "zero-shot", "zero-shot"), (0.3, 0.7, "few-shot", "cot"), (0.6, 0.9, "few-shot", "cot"),
    (0.61, 0.9, "cot", "cot"), (0.59, 0.71, "few-shot", "zero-shot"),
])
def test_score_strategies(spark, score, conf, tiered, binary):
    r = spark.range(1).select(routing.tiered_strategy(F.lit(score), F.lit(conf)).alias("t"),
                              routing.binary_strategy(F.lit(score), F.lit(conf)).alias("b")).first()
    assert (r.t, r.b) == (tiered, binary)


def test_rows_without_score(spark):
    df = spark.createDataFrame([("1", 0.1), ("2", None), ("3", 0.9)], "pairID string, s double")
    out = routing.route_by_score(df, "s")
    got = {r.pairID: r for r in out.collect()}
    assert [got[k].routed_strategy for k in "123"] == ["zero-shot", "few-shot", "cot"]
    assert got["1"].routing_reasoning == "Easy query (score=0.10, conf=0.90)"
    assert (got["2"].difficulty_score, got["2"].estimated_tokens, got["2"].has_model) == (0.5, 465, False)
    s = {r.routed_strategy: r for r in routing.routing_summary(routing.routing_counters(out)).collect()}
    assert set(s) == {"zero-shot", "cot"} and s["cot"].total_spent == 665 and s["cot"].total_saved == 335
    assert s["cot"].savings_ratio == pytest.approx(0.335)
    save = routing.routing_savings(out).where("routed_strategy = 'cot'").first()
    assert (save.baseline_tokens, save.adaptive_tokens, save.tokens_saved) == (1500, 1130, 370)


# --- metrics -------------------------------------------------------------------------------------

def reference_report(rows):
    """Scores of one group by the definitions, in plain Python."""
    valid = [(t, p) for t, p in rows if p is not None]
    labels = {x for pair in valid for x in pair}
    f1, prec, rec, support = {}, {}, {}, Counter(t for t, _ in valid)
    for l in labels:
        tp = sum(t == p == l for t, p in valid)
        fp = sum(p == l != t for t, p in valid)
        fn = sum(t == l != p for t, p in valid)
        prec[l] = tp / (tp + fp) if tp + fp else 0.0
        rec[l] = tp / (tp + fn) if tp + fn else 0.0
        f1[l] = 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0
    n = len(valid)
    mean = lambda d: sum(d.values()) / len(d) if d else None
    return {
        "accuracy": sum(t == p for t, p in valid) / n if n else None, "macro_f1": mean(f1),
        "macro_precision": mean(prec), "macro_recall": mean(rec),
        "weighted_f1": sum(f1[l] * support[l] for l in labels) / n if n else None,
        "n_samples": n, "n_invalid": len(rows) - n,
        **{f"{l}_f1": f1.get(l, 0.0) for l in domain.LABELS},
    }


def test_report_equals_definitions(spark):
    rng = random.Random(3)
    rows = []
    for group, labels in (("all", domain.LABELS), ("two", domain.LABELS[:2]), ("odd", ["neutral", "unknown"])):
        rows += [(group, rng.choice(labels), rng.choice(labels + [None])) for _ in range(60)]
    rows += [("none", "neutral", None)] * 3
    df = spark.createDataFrame(rows, "g string, label string, predicted_label string")
    for r in metrics.metrics(df, "g").collect():
        want = reference_report([(t, p) for g, t, p in rows if g == r.g])
        for k, v in want.items():
            assert r[k] == (pytest.approx(v) if v is not None else None), (r.g, k)


def test_confusion_matrix_total(spark, predictions):
    c = metrics.outcome_counts(predictions, "strategy")
    valid = {r.strategy: r.n_samples for r in metrics.report(c.where(F.col("true").isin(domain.LABELS)), "strategy").collect()}
    cells = metrics.confusion_matrix(c, "strategy").groupBy("strategy").agg(F.sum("n").alias("n"), F.count("*").alias("cells"))
    assert {r.strategy: r.n for r in cells.collect()} == valid
    assert {r.cells for r in cells.collect()} == {9}


def test_normalised_confusion_of_an_empty_row_is_null(spark):
    df = spark.createDataFrame([("neutral", "neutral")], ["label", "predicted_label"])
    m = metrics.normalised_confusion(metrics.confusion_matrix(metrics.outcome_counts(df)))
    got = {(r["true"], r.pred): r.share for r in m.collect()}
    assert got[("neutral", "neutral")] == 1.0 and got[("entailment", "neutral")] is None


def test_patterns_without_valid_rows(spark):
    df = spark.createDataFrame([("neutral", None)], "label string, predicted_label string")
    r = metrics.confusion_patterns(metrics.outcome_counts(df)).first()
    assert (r.total_errors, r.error_rate, r.neutral_entailment_rate) == (0, None, 0.0)


def test_mcnemar_golden(spark):
    rows = []
    for i in range(10 + 2 + 5):
        a, b = (1, 0) if i < 10 else (0, 1) if i < 12 else (1, 1)
        rows += [(str(i), "zero-shot", "x", "x" if a else None), (str(i), "cot", "x", "x" if b else "y")]
    rows.append(("lonely", "cot", "x", "x"))
    df = spark.createDataFrame(rows, "pairID string, strategy string, label string, predicted_label string")
    r = metrics.with_p_value(metrics.mcnemar(metrics.paired_counts(metrics.correctness_profiles(df)))).first()
    assert (r.strategy_a, r.strategy_b, r.n_common, r.a_only_correct, r.b_only_correct) == ("zero-shot", "cot", 17, 10, 2)
    assert r.statistic == pytest.approx(49 / 12) and r.significant
    assert r.p_value == pytest.approx(math.erfc(math.sqrt(49 / 24)))
    assert r.p_value == pytest.approx(0.0433, abs=1e-4)


def test_top_confusions(spark, predictions):
    c = metrics.outcome_counts(predictions)
    got = [(r.confusion_pair, r.n) for r in metrics.top_confusions(c, k=2).collect()]
    want = Counter(f"{r.label} → {r.predicted_label}" for r in predictions.where(
        F.col("predicted_label").isNotNull() & (F.col("label") != F.col("predicted_label"))).select("label", "predicted_label").collect())
    assert got == sorted(want.items(), key=lambda x: (-x[1], x[0]))[:2]


def test_null_prediction_modes(spark):
    df = spark.createDataFrame([("neutral", " Neutral "), ("neutral", None)], "label string, predicted_label string")
    dropped = metrics.metrics(df.withColumn("predicted_label", F.lower(F.trim("predicted_label")))).first()
    kept = adaptive.evaluate(df).first()
    assert (dropped.accuracy, dropped.n_invalid, dropped.macro_f1) == (1.0, 1, 1.0)
    assert (kept.accuracy, kept.n_invalid) == (0.5, 0) and kept.macro_f1 == pytest.approx(1 / 3)


def test_leaderboard_of_mixed_schemas(spark):
    a = spark.createDataFrame([("Neutral", "neutral"), ("x", "nan")], ["label", "predicted_label"])
    b = spark.createDataFrame([("neutral", "NEUTRAL")], ["true_label", "bert_prediction"])
    assert [(r.strategy, r.accuracy) for r in leaderboard.ranked({"a": a, "b": b}).collect()] == [("b", 1.0), ("a", 0.5)]
    d = {r.strategy: r for r in leaderboard.detailed({"a": a, "b": b}).collect()}
    assert (d["a"].accuracy, d["a"].n_invalid) == (1.0, 1)


# --- cost -----------------------------------------------------------------------------------------

def test_adaptive_savings_golden(spark):
    dist = spark.createDataFrame([("zero-shot", 200), ("few-shot", 200), ("cot", 100)], "strategy string, n long")
    r = cost.adaptive_savings(dist).first()
    assert (r.adaptive_tokens, r.baseline_tokens, r.token_savings) == (176_000, 250_000, 74_000)
    assert r.token_savings_pct == pytest.approx(29.6)
    empty = cost.adaptive_savings(dist.limit(0)).first()
    assert (empty.total_samples, empty.cost_savings_pct, empty.token_savings_pct) == (0, 0.0, 0.0)


def test_unknown_strategy_uses_default_tokens(spark):
    df = spark.createDataFrame([("guess", 2), ("cot", 0)], "strategy string, n long")
    out = {r.strategy: r for r in cost.with_strategy_cost(df).collect()}
    assert (out["guess"].input_tokens, out["guess"].output_tokens) == (400, 100)
    assert out["cot"].cost_per_sample == 0.0
    own = cost.with_strategy_cost(df, tokens={"guess": (1, 2)}).where("strategy = 'guess'").first()
    assert own.total_tokens == 6


def test_pareto_equals_nested_loop(spark):
    rng = random.Random(5)
    rows = [(i, rng.randint(0, 12) / 4, rng.randint(0, 8) / 8) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, cost_usd double, accuracy double")
    want = {i for i, c, a in rows if not any((a2 > a and c2 <= c) or (c2 < c and a2 >= a) for _, c2, a2 in rows)}
    assert want
    assert {r.id for r in cost.with_pareto_flag(df).where("pareto_optimal").collect()} == want
    assert {r.id for r in cost.undominated(df).collect()} == want


def test_budget_and_roi(spark):
    w = cost.equal_weights(spark.createDataFrame([("zero-shot",), ("cot",)], ["strategy"]))
    r = cost.budget_projection(w, 1.0).first()
    each = (150 * 0.000075 + 15 * 0.0003 + 350 * 0.000075 + 150 * 0.0003) / 1000 / 2
    assert r.avg_cost_per_sample == pytest.approx(each) and r.max_samples == int(1 / each)
    assert r.strategy_samples == r.max_samples // 2
    df = spark.createDataFrame([("6-shot", 90, 10), ("zero-shot", 40, 10)], "routed_strategy string, prompt_tokens long, response_tokens long")
    roi = cost.token_roi(df).first()
    assert (roi.baseline_source, roi.baseline_tokens, roi.savings_pct) == ("measured", 200.0, 25.0)
    assert cost.token_roi(df.where("routed_strategy <> '6-shot'")).first().baseline_source == "fallback"


def test_usage_summary_shows_unused(spark):
    df = spark.createDataFrame([("cot", 10, 2), ("cot", 20, 4)], "strategy string, prompt_tokens long, response_tokens long")
    out = {r.strategy: r for r in cost.usage_summary(cost.usage_counters(df)).collect()}
    assert set(out) == {*domain.BASE_STRATEGIES, "total"}
    assert (out["zero-shot"].calls, out["zero-shot"].avg_prompt_tokens) == (0, 0.0)
    assert (out["total"].total_tokens, out["total"].avg_response_tokens) == (36, 3.0)


def test_measured_tokens_defaults(spark):
    df = spark.createDataFrame([("cot", 10, 2), ("zero-shot", 0, 0)], "strategy string, prompt_tokens long, response_tokens long")
    out = {r.strategy: r.mean_tokens for r in cost.measured_tokens(df).collect()}
    assert out == {"zero-shot": 165.0, "one-shot": 235.0, "few-shot": 465.0, "cot": 12.0}


# --- replay and shapes ----------------------------------------------------------------------------

def test_replay_takes_each_rows_own_strategy(spark, pairs, predictions):
    from pairflow.sources import fixtures
    routed = routing.route_by_score(pairs, fixtures.difficulty_score())
    out = offline.replayed(routed, predictions)
    assert out.count() == pairs.count()
    mixed = out.join(routed, "pairID").where("strategy_used <> routed_strategy")
    assert mixed.count() == 0
    acc = {r.strategy: (r.n, r.accuracy) for r in offline.accuracies(routed, predictions).collect()}
    right = out.where("true_label = predicted_label").count()
    assert acc["adaptive"] == (out.count(), pytest.approx(right / out.count()))


def test_alignment_drops_and_counts(spark):
    a = spark.createDataFrame([(str(i), i) for i in range(5)], ["pairID", "v"])
    b = spark.createDataFrame([("3",), ("4",), ("9",)], ["pairID"])
    assert {r.pairID for r in replay.common_rows(a, b).collect()} == {"3", "4"}
    r = replay.alignment_report(a, b).first()
    assert (r.n_left, r.n_right, r.n_common, r.n_lost) == (5, 3, 2, 3)


def test_shapes(spark, predictions):
    m = metrics.metrics(predictions, "strategy", "genre")
    top = reshape.genre_improvement(m, k=3).collect()
    assert len(top) == 3 and top[0].improvement >= top[1].improvement >= top[2].improvement
    wide = reshape.pivot_metric(m, values=["cot", "zero-shot"])
    assert wide.columns == ["genre", "cot", "zero_shot"]
    order = [r.strategy for r in reshape.progression(study.compare(predictions)).collect()]
    assert order == domain.BASE_STRATEGIES
    f1 = reshape.class_f1_by_strategy(study.compare(predictions))
    assert {r.label for r in f1.collect()} == set(domain.LABELS)


def test_paired_comparison_shuffles_once(spark, predictions):
    plan = metrics.correctness_profiles(predictions)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 2


def test_pareto_flag_does_not_shuffle_the_rows(spark):
    rows = spark.range(5000).select((F.col("id") % 7).cast("double").alias("cost_usd"), (F.col("id") * 37 % 101).cast("double").alias("accuracy"), "id")
    flagged = cost.with_pareto_flag(rows)
    assert "Exchange hashpartitioning" not in flagged._jdf.queryExecution().executedPlan().toString()
    best = {}
    for r in rows.collect():
        best[r.cost_usd] = max(best.get(r.cost_usd, -1), r.accuracy)
    for r in flagged.collect():
        better = r.accuracy < best[r.cost_usd] or any(v >= r.accuracy for c, v in best.items() if c < r.cost_usd)
        assert r.pareto_optimal == (not better)


@pytest.mark.parametrize("block,blocks", [(1_000_000, 4), (20, 100), (20, 1)])
def test_frontier_of_many_steps(spark, monkeypatch, block, blocks):
    """Costs and values that rise together are all steps; sent whole, in blocks, or met in a shuffle join."""
    monkeypatch.setattr(cost, "STEP_BLOCK", block)
    monkeypatch.setattr(cost, "STEP_BLOCKS", blocks)
    rng = random.Random(2)
    rows = [(i, i / 2, float(i // 3)) for i in range(300)] + [(1000 + i, rng.randint(0, 300) / 2, float(rng.randint(0, 100))) for i in range(300)]
    rows += [(5000, None, 1.0), (5001, 3.0, None), (5002, float("nan"), 0.0), (5003, float("inf"), 1e9), (5004, -1.0, -5.0), (5005, -1.0, -5.0)]
    df = spark.createDataFrame(rows, "id int, cost_usd double, accuracy double").repartition(7)
    real = [(i, c, a) for i, c, a in rows if c is not None and c == c and a is not None]
    want = {i for i, c, a in real if not any((a2 > a and c2 <= c) or (c2 < c and a2 >= a) for _, c2, a2 in real)} | {5000, 5001, 5002}
    flagged = cost.with_pareto_flag(df)
    assert flagged.columns == ["id", "cost_usd", "accuracy", "pareto_optimal"] and flagged.count() == len(rows)
    assert {r.id for r in flagged.where("pareto_optimal").collect()} == want
    assert cost.with_pareto_flag(df.limit(0)).collect() == []


def test_a_million_costs_do_not_shuffle_the_rows(spark):
    import numpy as np
    rows = spark.range(1_000_000).select(
        "id", (F.lit(1.0) + F.col("id") / 1e6).alias("cost_usd"), (F.col("id") * 48271 % 999_983 + F.col("id") / 2).cast("double").alias("accuracy"))
    flagged = cost.with_pareto_flag(rows)
    plan = flagged._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan
    ids = np.arange(1_000_000)
    value = (ids * 48271 % 999_983) + ids / 2
    want = ids[value > np.concatenate(([-1], np.maximum.accumulate(value)[:-1]))]
    assert sorted(r.id for r in flagged.where("pareto_optimal").select("id").collect()) == want.tolist()


def test_chi_square_tail(spark):
    from pairflow.functions.tails import chi_square_tail
    values = [0.0, 1e-12, 0.01, 0.5, 1.0, 3.841, 6.6, 12.4999, 12.5, 12.5001, 40.0, 300.0, 1400.0, 1e5]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "statistic double").coalesce(1)
    out = metrics.with_p_value(df)
    got = [r.p_value for r in out.collect()]
    assert got[-1] is None
    for v, p in zip(values, got):
        assert math.isclose(p, math.erfc(math.sqrt(v / 2)), rel_tol=1e-11, abs_tol=1e-300), v
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_stored_predictions_are_not_shuffled(spark, pairs, predictions):
    from pyspark.sql import functions as F

    from pairflow.sources import prediction_store
    name = prediction_store.write(predictions.drop("premise", "hypothesis", "genre"), 4)
    stored = prediction_store.read(spark, name)
    routed = routing.route_by_score(pairs, (F.length("premise") % 100) / 100)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = replay.replay(routed, stored, required=("zero-shot", "cot"))
        side = replay.answers_by_pair(stored, ("zero-shot", "cot"))
        assert _exchanges(side) == 0 and _exchanges(joined) == 1
        plain = routed.select("pairID", F.col("routed_strategy").alias("strategy_used")).join(
            predictions.select("pairID", F.col("strategy").alias("strategy_used"), "predicted_label"), ["pairID", "strategy_used"])
        got = joined.select("pairID", "strategy_used", "predicted_label")
        assert got.exceptAll(plain).count() == 0 and got.count() == plain.count() > 0
        few = prediction_store.read(spark, name, "zero-shot", "cot")
        assert few.select("strategy").distinct().count() == 2
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        assert "PartitionFilters: [strategy" in few._jdf.queryExecution().explainString(mode)
        assert _exchanges(replay.common_rows(few.where("strategy = 'zero-shot'"), few.where("strategy = 'cot'"))) == 0
        assert _exchanges(replay.paired_correctness(few, "zero-shot", "cot")) == 1  # the four counts
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql(f"DROP TABLE {name}")


def test_replay_of_missing_and_repeated_answers(spark):
    routed = spark.createDataFrame([("1", "neutral", "cot", 0.5), ("2", "neutral", "zero-shot", 0.1), ("3", "neutral", "cot", 0.2)],
                                   "pairID string, label string, routed_strategy string, difficulty_score double")
    stored = spark.createDataFrame([("1", "cot", "Neutral"), ("1", "zero-shot", None), ("2", "zero-shot", None), ("3", "zero-shot", "neutral")],
                                   "pairID string, strategy string, predicted_label string")
    got = {r.pairID: (r.true_label, r.difficulty_score, r.strategy_used, r.predicted_label) for r in replay.replay(routed, stored).collect()}
    assert got == {"1": ("neutral", 0.5, "cot", "neutral"), "2": ("neutral", 0.1, "zero-shot", None)}
    assert [r.pairID for r in replay.replay(routed, stored, required=("cot",)).collect()] == ["1"]
