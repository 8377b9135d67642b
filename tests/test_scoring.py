import os
import subprocess
import sys

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairflow import domain
from pairflow.functions.features import with_features
from pairflow.operators import difficulty as D
from pairflow.operators import routing, scoring
from pairflow.plans import adaptive, study
from pairflow.sources import fixtures, readers
from pairflow.sources.rule_scorer import rule_factory
from pairflow.streaming import running
from pairflow.workspace import materialize, scratch_path

FAST = scoring.RetryPolicy(delay_s=0.0)
RESULT = ["pairID", "strategy", "raw_response", "predicted_label", "prompt_tokens", "response_tokens", "success", "error"]


class Flaky:
    """Fails a number of times per row before it answers; rows named "bad" fail for good."""

    def __init__(self, failures: int, error: str):
        self.left, self.error = failures, error

    def answer(self, batch):
        fail, self.left = self.left > 0, self.left - 1
        return [scoring.Answer("", 1, 0, 1.0, False, "invalid request") if i == "bad"
                else scoring.Answer("", 1, 0, 1.0, False, self.error) if fail
                else scoring.Answer("neutral", 1, 1, 1.0) for i in batch["id"]]


@pytest.mark.parametrize("failures,error,ok,attempts,slept", [
    (0, "", True, 1, []), (1, "Rate Limit exceeded", True, 2, [1.0]), (2, "request timeout", True, 3, [1.0, 2.0]),
    (5, "service unavailable", False, 3, [1.0, 2.0]), (5, "invalid key", False, 1, []),
])
def test_retry_policy(failures, error, ok, attempts, slept):
    naps = []
    batch = pd.DataFrame({"id": ["a", "bad", "b"]})
    answers, tries = scoring.answer_with_retries(Flaky(failures, error), batch, scoring.RetryPolicy(), naps.append)
    assert [a.success for a in answers] == [ok, False, ok]
    assert tries == [attempts, 1, attempts] and naps == slept


def test_scoring_matches_stored_answers(spark, pairs, predictions):
    rows = scoring.for_strategies(pairs, domain.STRATEGIES)
    got = scoring.score(rows, rule_factory(), FAST, scoring.Limits(in_flight=3)).select(*RESULT)
    want = predictions.select(*RESULT)
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_resume_scores_only_what_is_missing(spark, pairs, predictions):
    stored = predictions.where("strategy = 'cot' AND success").withColumn("attempts", F.lit(0))
    done = study.run_strategies(pairs, rule_factory(), ["cot", "zero-shot"], stored=stored)
    n = pairs.count()
    assert done.count() == 2 * n == done.select("pairID", "strategy").distinct().count()
    assert done.where("attempts = 0").count() == stored.count()


def test_adaptive_run_answers_every_row(spark, pairs):
    out = adaptive.run(pairs, rule_factory(), per_genre=5, length=100, negations=1)
    assert out.where("error IS NULL").count() == 0
    assert out.where("strategy <> routed_strategy").count() == 0
    assert out.groupBy("genre").count().where("count > 5").count() == 0
    r = adaptive.roi(out).first()
    assert r.n_rows == out.count() and r.baseline_source in ("measured", "fallback")


def test_batch_summary(spark):
    df = spark.createDataFrame([("a", True, None, 10, 2, 5.0, 1), ("a", False, "Timeout!", 1, 0, 5.0, 3)],
                               "strategy string, success boolean, error string, prompt_tokens long, response_tokens long, latency_ms double, attempts int")
    r = scoring.batch_summary(df, "strategy").first()
    assert (r.successful, r.failed, r.success_rate, r.total_tokens, r.retries, r.retryable_failures) == (1, 1, 0.5, 13, 2, 1)


def test_scorer_reaches_workers_without_the_package(tmp_path):
    code = """
import sys; sys.path.insert(0, sys.argv[1])
from pairflow.session import local_session
from pairflow.operators import scoring
from pairflow.sources.rule_scorer import rule_factory
spark = local_session("elsewhere", cpus=1, memory="1g")
df = spark.createDataFrame([("1", "p", "h", 0, "cot", "x")], "pairID string, premise string, hypothesis string, label_id int, strategy string, prompt string")
print("answered", scoring.score(df, rule_factory()).count())
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code, root], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "answered 1" in out.stdout, out.stderr[-2000:]


# --- difficulty model ---------------------------------------------------------------------------

@pytest.fixture(scope="module")
def training(spark, pairs, predictions):
    return materialize(D.training_rows(with_features(pairs), predictions))


def test_training_rows_need_both_strategies(spark, pairs, predictions):
    f = with_features(pairs)
    some = predictions.where("strategy = 'zero-shot' OR (strategy = 'cot' AND success)")
    rows = D.training_rows(f, some)
    assert rows.count() == predictions.where("strategy = 'cot' AND success").count()
    with pytest.raises(ValueError, match="cot"):
        study.train_router(f, predictions.where("strategy = 'zero-shot'"))


def test_coefficients_equal_a_newton_solve(spark, training):
    import numpy as np
    model = D.fit(training)
    data = model.scaling.apply(training).select(*model.scaling.columns, "target").toPandas()
    x = np.c_[data[model.scaling.columns].values, np.ones(len(data))]
    y = data["target"].values
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    theta, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1])
    ridge[-1, -1] = 0
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ theta))
        theta -= np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (w * (p - y)) + ridge @ theta)
    assert np.allclose(x[:, :-1].std(axis=0), 1) and np.allclose(x[:, :-1].mean(axis=0), 0)
    assert np.abs(np.array([*model.coefficients, model.intercept]) - theta).max() < 1e-8
    ordered = [abs(r.importance) for r in model.importance(spark, 5).collect()]
    assert ordered == sorted(ordered, reverse=True) and len(ordered) == 5


def test_out_of_fold_covers_each_row_once(spark, training):
    oof = materialize(D.out_of_fold(training))
    assert oof.count() == training.count() == oof.select("pairID").distinct().count()
    sizes = oof.groupBy("target", "fold").count().collect()
    for t in (0, 1):
        n = [r["count"] for r in sizes if r.target == t]
        assert len(n) == 5 and max(n) - min(n) <= 1
    r = D.cv_report(oof).first()
    assert 0 < r.accuracy < 1 and r.n_samples == training.count()
    assert {x.label for x in D.cv_class_report(oof).collect()} == {"0", "1"}


def test_coefficients_equal_spark_ml(spark, training):
    """Unit inverse strength is a penalty of 1/n per row there."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    model, n = D.fit(training), training.count()
    weight = F.when(F.col("target") == 1, n / (2 * model.sizes[1])).otherwise(n / (2 * model.sizes[0]))
    rows = VectorAssembler(inputCols=model.scaling.columns, outputCol="x").transform(model.scaling.apply(training)).withColumn("w", weight)
    other = LogisticRegression(featuresCol="x", labelCol="target", weightCol="w", regParam=1 / n, elasticNetParam=0.0,
                               standardization=False, maxIter=1000, tol=1e-14).fit(rows)
    gap = [a - b for a, b in zip([*model.coefficients, model.intercept], [*other.coefficients, other.intercept])]
    # combined_length is the sum of two features: along that direction its iterations stop a little early.
    assert max(map(abs, gap)) < 1e-5
    both = model.score(training).select("pairID", "p_hard").join(other.transform(rows).select("pairID", vector_to_array("probability")[1].alias("p")), "pairID")
    assert both.where(F.abs(F.col("p") - F.col("p_hard")) > 1e-6).count() == 0


@pytest.mark.parametrize("per_fold", [False, True])
def test_folds_fitted_together_equal_single_fits(spark, training, per_fold):
    table = materialize(D.with_folds(training))
    got = {r.pairID: r.p_hard for r in D.out_of_fold(training, scale_per_fold=per_fold).collect()}
    for fold in range(5):
        own = table.where(F.col("fold") != fold)
        if per_fold:
            want = D.fit(own)
        else:  # standardised over all rows, then fitted on the fold's training rows without further scaling
            scale = D.fit_scaling(training)
            zs = materialize(scale.apply(table))
            fitted = D.logistic.fit_all(zs, scale.columns, [fold], "fold")[0]
            want = D.DifficultyModel(scale, [float(b / s) for b, s in zip(fitted.beta[1:], fitted.std)],
                                     float(fitted.beta[0] - (fitted.beta[1:] * fitted.mean / fitted.std).sum()), {})
        for r in want.score(table.where(F.col("fold") == fold)).select("pairID", "p_hard").collect():
            assert abs(got[r.pairID] - r.p_hard) < 1e-9


def test_one_pass_fits_all_folds(spark, training, monkeypatch):
    calls = []
    sums = D.logistic._sums
    monkeypatch.setattr(D.logistic, "_sums", lambda rows, models, *a: calls.append(sum(not m.done for m in models)) or sums(rows, models, *a))
    D.out_of_fold(training)
    assert calls[0] == 5 and len(calls) < 15


def test_separable_classes_converge(spark):
    rows = [(str(i), "g", int(i >= 20), float(i), 1.0) for i in range(40)]
    df = spark.createDataFrame(rows, "pairID string, genre string, target int, a double, b double")
    model = D.fit(df, ["a", "b"])
    assert model.scaling.std[1] == 1.0 and model.coefficients[1] == 0.0
    scored = model.score(df)
    assert scored.where("predicted_difficulty <> target").count() == 0
    assert D.out_of_fold(df, names=["a", "b"]).where("predicted_difficulty <> target").count() <= 2


def test_model_is_a_plain_table(spark, training):
    model = D.fit(training)
    path = scratch_path(spark, "model")
    model.save(spark, path, D.cv_report(D.out_of_fold(training)))
    rows = spark.read.parquet(f"{path}/coefficients").orderBy("position").collect()
    assert [r.feature for r in rows] == [D.INTERCEPT, *model.scaling.names] and rows[0].weight == model.intercept
    assert spark.read.parquet(f"{path}/cv").first().n_samples == training.count()
    plan = model.score(training)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_model_round_trip(spark, training):
    model = D.fit(training)
    path = scratch_path(spark, "model")
    model.save(spark, path)
    loaded = D.DifficultyModel.load(spark, path)
    assert loaded.scaling == model.scaling and loaded.sizes == model.sizes
    a = model.score(training).select("pairID", "difficulty_score")
    b = loaded.score(training).select("pairID", F.col("difficulty_score").alias("other"))
    assert a.join(b, "pairID").where("difficulty_score <> other").count() == 0
    scored = routing.route_by_score(model.score(training))
    assert scored.where(F.abs(F.col("routing_confidence") - F.greatest("p_easy", "p_hard")) > 1e-12).count() == 0


def test_one_class_is_an_error(spark, training):
    with pytest.raises(ValueError, match="both"):
        D.fit(training.where("target = 0"))


def test_by_genre_report(spark):
    df = spark.createDataFrame([("g", 1, 0.6), ("g", 0, 0.4), ("h", 1, 0.9)], "genre string, predicted_difficulty int, difficulty_score double")
    r = D.difficulty_by_genre(df).collect()
    assert [(x.genre, x.hard_ratio, x.total) for x in r] == [("h", 1.0, 1), ("g", 0.5, 2)]
    assert r[1].std_score == 0.141 and r[0].std_score is None


# --- streams: the final state equals the batch result ------------------------------------------------

@pytest.fixture(scope="module")
def pair_files(spark, pairs):
    path = scratch_path(spark, "stream-source")
    pairs.repartition(4).write.parquet(path)
    return path


def same(a, b):
    return a.count() == b.count() and a.select(*b.columns).exceptAll(b).count() == 0


def test_running_counters(spark, pairs, pair_files):
    stream = running.read_stream(spark, pair_files, pairs.schema, files_per_trigger=1)
    routed = routing.route_by_score(stream, fixtures.difficulty_score())
    got = running.run_to_table(running.routing_totals(routed, domain.ROUTER_TOKENS, 0), "t1", "complete")
    want = routing.routing_counters(routing.route_by_score(pairs, fixtures.difficulty_score()))
    assert same(got, want)
    calls = fixtures.scored(running.read_stream(spark, pair_files, pairs.schema, 1)).withColumn("model", F.lit("m"))
    got = running.run_to_table(running.call_totals(calls), "t2", "complete")
    assert got.count() == 1
    with pytest.raises(ValueError):
        running.run_to_table(running.call_totals(calls), "t2", "update")


@pytest.mark.parametrize("every", [50, 2])
def test_changes_are_merged_by_key_and_trigger(spark, pairs, pair_files, monkeypatch, every):
    plain = running.Changes.__init__
    monkeypatch.setattr(running.Changes, "__init__", lambda self, root, schema, keys: plain(self, root, schema, keys, every))
    root = scratch_path(spark, "update")
    routed = routing.route_by_score(running.read_stream(spark, pair_files, pairs.schema, 1), fixtures.difficulty_score())
    totals = running.routing_totals(routed, domain.ROUTER_TOKENS, 0)
    got = running.run_to_table(totals, "t4", "update", root, ["routed_strategy"])
    want = materialize(routing.routing_counters(routing.route_by_score(pairs, fixtures.difficulty_score())))
    assert same(got, want)
    triggers = spark.read.parquet(f"{root}/changes").select("batch").distinct().count()
    assert triggers >= 4
    # A trigger that runs again writes what it wrote, and the table stays.
    changes = running.Changes(root, totals.schema, ["routed_strategy"])
    for k in (1, triggers - 1):
        again = materialize(spark.read.parquet(f"{root}/changes").where(f"batch = {k}").drop("batch"))
        changes.store(again, k)
        assert same(changes.table(spark), want)
    assert same(running.run_to_table(totals, "t4", "update", root, ["routed_strategy"]), want)


def test_a_trigger_writes_only_what_it_changed(spark):
    schema = "model string, success boolean, prompt_tokens long, response_tokens long"
    path, root = scratch_path(spark, "calls"), scratch_path(spark, "calls-root")
    from pyspark.sql.types import StructType

    def run(model):
        spark.createDataFrame([(model, True, 1, 2)], schema).coalesce(1).write.mode("append").parquet(path)
        stream = running.read_stream(spark, path, StructType.fromDDL(schema), 1)
        table = running.run_to_table(running.call_totals(stream), "calls", "update", root, ["model"])
        return {r.model: r.total_calls for r in table.collect()}

    assert run("m1") == {"m1": 1} and run("m2") == {"m1": 1, "m2": 1} and run("m1") == {"m1": 2, "m2": 1}
    written = {r.batch: r["count"] for r in spark.read.parquet(f"{root}/changes").groupBy("batch").count().collect()}
    assert written == {0: 1, 1: 1, 2: 1}


def test_state_of_every_trigger_and_resumption(spark):
    schema = "model string, success boolean, prompt_tokens long, response_tokens long"
    path, root = scratch_path(spark, "calls"), scratch_path(spark, "calls-root")
    write = lambda model: spark.createDataFrame([(model, True, 1, 2)], schema).coalesce(1).write.mode("append").parquet(path)
    write("m1")
    write("m2")
    from pyspark.sql.types import StructType
    run = lambda: {r.model: r.total_calls for r in running.run_to_table(running.call_totals(
        running.read_stream(spark, path, StructType.fromDDL(schema), 1)), "calls", "complete", root).collect()}
    assert run() == {"m1": 1, "m2": 1}
    assert run() == {"m1": 1, "m2": 1}
    write("m1")
    assert run() == {"m1": 2, "m2": 1}


def test_stream_without_rows(spark):
    path = scratch_path(spark, "no-files")
    spark.createDataFrame([], "model string, success boolean, prompt_tokens long, response_tokens long").write.parquet(path)
    schema = spark.read.parquet(path).schema
    for mode in ("append", "complete", "update"):
        stream = running.read_stream(spark, path, schema)
        table = running.run_to_table(stream if mode == "append" else running.call_totals(stream), "none", mode,
                                     keys=["model"] if mode == "update" else None)
        assert table.count() == 0


def test_scorer_must_answer_every_row():
    class Short:
        def answer(self, batch):
            return [scoring.Answer("x", 1, 1, 1.0)] * (len(batch) - 1)

    with pytest.raises(ValueError):
        scoring.answer_with_retries(Short(), pd.DataFrame({"id": [1, 2]}), scoring.RetryPolicy(), lambda s: None)


def test_some_failures_pass_at_the_second_try(spark, pairs):
    def factory():
        class Once:
            """Refuses every second row once."""

            def __init__(self):
                self.seen = set()

            def answer(self, batch):
                out = []
                for i in batch["pairID"]:
                    refused = len(i) % 2 and i not in self.seen
                    self.seen.add(i)
                    out.append(scoring.Answer("", 1, 0, success=False, error="Rate limit") if refused else scoring.Answer("neutral", 1, 1))
                return out
        return Once()

    rows = scoring.for_strategies(pairs.limit(200), ["cot"])
    out = scoring.score(rows, factory, FAST).selectExpr("pairID", "success", "attempts", "latency_ms").collect()
    assert all(r.success and r.attempts == 1 + len(r.pairID) % 2 and r.latency_ms >= 0 for r in out) and len(out) == 200


def test_token_bucket():
    now, naps = [0.0], []

    def sleep(s):
        naps.append(s)
        now[0] += s

    bucket = scoring.TokenBucket(5, lambda: now[0], sleep)
    for _ in range(4):
        bucket.take(5)
    assert naps == [1.0, 1.0, 1.0]  # the first second's worth goes at once
    now[0] += 10
    bucket.take(5)
    assert len(naps) == 3
    bucket.take(20)  # more than a second's worth is paid by waiting
    assert naps[-1] == 4.0


def test_shares_of_limits():
    assert scoring.Limits(80, 16).share(8) == scoring.Limits(10, 2)
    assert scoring.Limits(None, 3).share(8) == scoring.Limits(None, 1) and scoring.Limits().share(8) == scoring.Limits()


def _counting(folder):
    def factory():
        class Slow:
            """Leaves a file for every call at work and notes how many there are."""

            def answer(self, batch):
                import time
                import uuid
                name = os.path.join(folder, "now", uuid.uuid4().hex)
                open(name, "w").close()
                n = len(os.listdir(os.path.join(folder, "now")))
                open(os.path.join(folder, "seen", f"{n}-{len(batch)}"), "w").close()
                time.sleep(0.02)
                os.remove(name)
                return [scoring.Answer("neutral", 1, 1) for _ in range(len(batch))]
        return Slow()
    return factory


@pytest.mark.parametrize("in_flight,chunk", [(2, 1), (32, 4)])
def test_requests_in_flight(spark, tmp_path, in_flight, chunk):
    for name in ("now", "seen"):
        (tmp_path / name).mkdir()
    rows = spark.range(0, 96, 1, 12).select(F.col("id").cast("string").alias("pairID"), F.lit("p").alias("prompt"))
    out = scoring.score(rows, _counting(str(tmp_path)), limits=scoring.Limits(in_flight=in_flight))
    assert out.rdd.getNumPartitions() == 12 and out.count() == 96
    seen = [tuple(map(int, f.split("-"))) for f in os.listdir(tmp_path / "seen")]
    assert max(n for n, _ in seen) * chunk <= in_flight and {c for _, c in seen} == {chunk}


def test_rate_is_shared_out(spark):
    import time
    rows = spark.range(0, 40, 1, 8).select(F.col("id").cast("string").alias("pairID"), F.lit("p").alias("prompt"))

    def factory():
        class Quick:
            def answer(self, batch):
                return [scoring.Answer("neutral", 1, 1) for _ in range(len(batch))]
        return Quick()

    begun = time.time()
    assert scoring.score(rows, factory, limits=scoring.Limits(per_second=16)).count() == 40
    assert time.time() - begun >= 1.4  # five rows a task at two a second, two of them at once


def test_waves_are_resumed_from_the_log(spark, tmp_path):
    calls, path = str(tmp_path / "calls"), f"{scratch_path(spark, 'waves')}"
    os.mkdir(calls)

    def factory(broken):
        def make():
            class Scorer:
                def answer(self, batch):
                    if (batch["pairID"] == broken).any():
                        raise RuntimeError("the service is gone")
                    for i in batch["pairID"]:
                        open(os.path.join(calls, i), "a").write("x")
                    return [scoring.Answer("neutral", 1, 1) for _ in range(len(batch))]
            return Scorer()
        return make

    df = spark.range(60).select(F.col("id").cast("string").alias("pairID"), F.lit("cot").alias("strategy"), F.lit("p").alias("prompt"))
    wave = {r.pairID: r.w for r in df.select("pairID", F.pmod(F.xxhash64("pairID", "strategy"), F.lit(5)).alias("w")).collect()}
    broken = next(i for i, w in wave.items() if w == 3)
    with pytest.raises(Exception, match="gone"):
        scoring.score_stored(df, path, factory(broken), waves=5)
    done = scoring.score_stored(df, path, factory(None), waves=5)
    assert sorted(int(r.pairID) for r in done.collect()) == list(range(60)) and "_wave" not in done.columns
    times = {i: os.path.getsize(os.path.join(calls, i)) for i in wave}
    assert all(times[i] == 1 for i, w in wave.items() if w != 3)
    assert scoring.score_stored(df, path, factory("0"), waves=5).count() == 60  # all from the log
    with pytest.raises(ValueError, match="5 waves"):
        scoring.score_stored(df, path, factory(None), waves=6)


def test_prompt_lengths(spark, pairs):
    from pairflow.functions.prompts import fixed_chars, with_prompt
    for s in domain.STRATEGIES:
        rows = with_prompt(pairs.limit(20).withColumn("strategy", F.lit(s)))
        assert rows.where(F.length("prompt") != fixed_chars(s) + F.length("premise") + F.length("hypothesis")).count() == 0


def test_stateless_stream(spark, pairs, pair_files):
    stream = running.read_stream(spark, pair_files, pairs.schema, files_per_trigger=2)
    got = running.run_to_table(running.features_and_route(stream, length=100, negations=1), "t3")
    want = routing.route_by_rule(with_features(pairs), length=100, negations=1)
    assert same(got, want)


def test_second_pair_source(spark, sf):
    turns = fixtures.turn_pairs(spark, sf)
    both = readers.combine_validation(fixtures.raw_pairs(spark, sf), turns)
    n = {r.source: r["count"] for r in both.groupBy("source").count().collect()}
    assert n["mismatched"] == turns.count() > 0
