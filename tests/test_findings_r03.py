"""One test per mended finding of the third review."""

import pytest
from pyspark.sql import functions as F

from pairflow import domain
from pairflow.functions import prompts as P
from pairflow.functions import text as T
from pairflow.operators import scoring
from pairflow.sources import fixtures as FX
from pairflow.sources import writers
from pairflow.sources.rule_scorer import rule_factory

ROWS = [("a", "The cat sat down", "A cat sat"), ("b", "No dog is here", "Dog"), (None, "Rain", "Sun shone"), ("c", "One", "Two three")]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(ROWS, "pairID string, premise string, hypothesis string")


def test_missing_strategies_are_those_of_the_anti_join(spark, texts):
    stored = spark.createDataFrame(
        [("a", "cot"), ("a", "zero-shot"), ("b", "cot"), (None, "cot"), *[("c", s) for s in domain.BASE_STRATEGIES]],
        "pairID string, strategy string")
    rows = scoring.missing_strategies(texts, stored, domain.BASE_STRATEGIES).select("pairID", F.explode("missing").alias("strategy"))
    plain = scoring.unscored(scoring.as_strategies(texts), stored).select("pairID", "strategy")
    key = lambda r: (r.pairID or "", r.strategy)
    assert sorted(rows.collect(), key=key) == sorted(plain.collect(), key=key)


def test_waves_store_no_prompts(spark, texts, tmp_path):
    """Prompts are many times a pair's texts; the stored waves hold a pair once, whatever its strategies."""
    wanted = texts.withColumn("missing", F.array(F.lit("cot"), F.lit("zero-shot")))
    done = scoring.score_stored(
        wanted, str(tmp_path), rule_factory(), waves=2, keys=("pairID",), keep=("pairID", "strategy"),
        ready=lambda rows: P.with_prompt(rows.withColumn("strategy", F.explode("missing")).drop("missing")))
    todo = spark.read.parquet(f"{tmp_path}/todo")
    assert todo.count() == len(ROWS) and "prompt" not in todo.columns
    assert done.columns == ["pairID", "strategy", *[f.name for f in scoring.RESULT_FIELDS], "predicted_label"]
    expected = FX.scored(texts, ["cot", "zero-shot"]).select("pairID", "strategy", "raw_response", "prompt_tokens")
    key = lambda r: (r.pairID or "", r.strategy)
    assert sorted(done.select(expected.columns).collect(), key=key) == sorted(expected.collect(), key=key)


def test_chunks_of_a_batch_come_back_as_one(spark, texts, monkeypatch):
    """A batch per chunk of what may be in flight costs a table each; the scorer still sees only the chunk."""
    class Seen:
        def answer(self, batch):
            return [scoring.Answer(f"{len(batch)} neutral", 1, 1) for _ in range(len(batch))]

    rows = texts.coalesce(1).withColumn("prompt", F.col("premise"))
    slots = spark.sparkContext.defaultParallelism
    out = scoring.score(rows, lambda: Seen(), limits=scoring.Limits(in_flight=2 * slots), keep=("pairID",)).collect()
    assert [r.raw_response for r in out] == ["2 neutral"] * 4 and out[0].asDict().keys() >= {"pairID", "latency_ms"}
    assert "premise" not in out[0].asDict()


def test_labels_of_the_fixture_are_not_parsed_again_in_predicates(spark, texts):
    rows = FX.scored(texts.withColumn("label", F.lit("neutral")))
    plan = rows.where(F.col("label") != F.col("predicted_label")).select("pairID")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and plan.count("regexp_extract_all") <= 4
    assert rows.where(~F.col("predicted_label").eqNullSafe(T.parse_label("raw_response"))).count() == 0


FULL = [r for rules in T.FULL_STEPS.values() for r in rules]


def test_full_tokens_by_gates_equal_all_rules(spark):
    """Every row is tokenised by the rules that can match in it, with the result of all of them."""
    parts = ["cannot", "gonna", " ", "  ", ",", ",,", ";", "(a)", "?!", "don't", "x", "not", "\t", ":3", "*", "é", "lemme ", "`", "'",
             "-", "--", "wanna\n", "$5", "’", "e.g. ", ".", "\x01"]
    pick = lambda i: F.element_at(F.array(*map(F.lit, parts)), (F.pmod(F.xxhash64("id", F.lit(i)), F.lit(len(parts))) + 1).cast("int"))
    rows = spark.range(3000).select(F.concat(*[pick(i) for i in range(5)]).alias("t"))
    whole = F.regexp_extract_all(T._rewritten(F.lower("t"), FULL), F.lit(r"(\S+)"), F.lit(1))
    assert rows.where(~T.full_tokens("t").eqNullSafe(whole)).count() == 0
    assert len(T.MARK_RULES) < len(T.PLAIN_RULES) < len(FULL)


def test_stopwords_are_dropped_as_by_array_except(spark):
    rows = spark.sql("SELECT explode(array(array('the', 'cat', null, 'cat', 'a'), array(), null, array('the'))) AS t")
    plain = F.array_except("t", F.array(*[F.lit(w) for w in domain.STOPWORDS]))
    assert rows.where(~T.drop_stopwords("t").eqNullSafe(plain)).count() == 0


def test_json_files_are_compressed_and_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(writers.TEXT_OPTIONS, "maxRecordsPerFile", "100")
    before = spark.conf.get("spark.sql.optimizer.plannedWrite.enabled")
    writers.write_json(spark.range(1000).coalesce(1).selectExpr("id % 2 AS strategy", "repeat('words ', 50) AS text"), str(tmp_path / "out"), "strategy")
    files = [f for f in (tmp_path / "out").rglob("part-*")]
    assert len(files) == 10 and all(f.name.endswith(".gz") for f in files)
    assert spark.conf.get("spark.sql.optimizer.plannedWrite.enabled") == before


def test_parse_label_needs_no_trimming(spark):
    rows = spark.createDataFrame([(" Neutral\n",), ("contradictioneutral",), ("neutral, or ENTAILMENT",), ("it contradicts",), ("",),
                                  (None,), ("Not ENTAILED by: x",), ("maybe",)], "t string")
    out = rows.select(T.parse_label("t").alias("p"), T.parse_label("t", "last_mention").alias("l"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan
    assert [tuple(r) for r in out.collect()] == [
        ("neutral", "neutral"), ("contradiction", "contradiction"), ("entailment", "entailment"), ("contradiction", "contradiction"),
        (None, None), (None, None), ("entailment", "entailment"), (None, None)]


def test_no_pass_after_the_last_step_that_matters(spark, monkeypatch):
    """One more pass over the rows was made to see a step that changed nothing."""
    from pairflow.operators import logistic as L
    rows = spark.createDataFrame([(int(i * 37 % 11 > 4), i / 40, (i * i % 11) / 5) for i in range(80)], "target int, a double, b double")
    calls, sums, fits, own = [], L._sums, {}, L.TOLERANCE
    monkeypatch.setattr(L, "_sums", lambda *a: calls.append(1) or sums(*a))
    for tolerance in (own, 1e-10, 1e-13):
        calls.clear()
        monkeypatch.setattr(L, "TOLERANCE", tolerance)
        fits[tolerance] = L.fit_all(rows, ["a", "b"], [None])[0].beta, len(calls)
    assert abs(fits[own][0] - fits[1e-13][0]).max() < 1e-11
    assert fits[own][1] < fits[1e-13][1] and own > 1e-10


@pytest.mark.parametrize("name", ["ml8_predict", "ml9_difficulty_by_genre", "snk5_model_round_trip", "ml10_train_and_route", "inf9_score_routed"])
def test_rows_are_stored_before_they_are_used_again(spark, sf, name):
    """What is fitted and then scored, or sampled and then sorted, was made of the documents twice."""
    from pairflow.catalog import QUERIES
    assert not [f for f in QUERIES[name](spark, sf).inputFiles() if "documents" in f]


def test_a_pair_goes_to_its_scoring_task_once(spark, texts):
    """Every strategy's prompt, many times as long as the pair, was sent to Python."""
    rows = texts.where("pairID IS NOT NULL").withColumn("hypothesis", F.when(F.col("pairID") != "b", F.col("hypothesis")))
    names = domain.STRATEGIES

    class Echo:
        def answer(self, batch):
            assert len(batch) <= 12
            return [scoring.Answer(f"{s}/{m}/{p}", 1, 1) for s, m, p in zip(batch["strategy"], batch["max_tokens"], batch["prompt"])]

    slots = spark.sparkContext.defaultParallelism
    out = scoring.score(rows, lambda: Echo(), limits=scoring.Limits(in_flight=12 * slots), strategies=names)
    plain = scoring.score(scoring.for_strategies(rows, names), lambda: Echo(), keep=("pairID", "premise", "hypothesis", "strategy", "max_tokens"))
    key = lambda r: (r.pairID, r.strategy)
    columns = ["pairID", "premise", "hypothesis", "strategy", "max_tokens", "raw_response", "attempts"]
    assert sorted(out.select(columns).collect(), key=key) == sorted(plain.select(columns).collect(), key=key)
    assert [f.dataType for f in out.select(columns).schema] == [f.dataType for f in plain.select(columns).schema]
    sent = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Classification" not in sent.split("MapInArrow")[-1] and domain.STUDY_LIMIT_COT != domain.STUDY_LIMIT_PLAIN
    assert scoring.score(rows, lambda: Echo(), strategies=[]).count() == 0
    with pytest.raises(ValueError):
        scoring.score(rows, lambda: Echo(), strategies=["no-shot"])
