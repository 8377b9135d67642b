"""Every operator as a query over the given tables, keyed by its inventory id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairflow import domain
from pairflow.functions import features as FT
from pairflow.functions import prompts as PR
from pairflow.functions import text as X
from pairflow.operators import (cleaning, cost, difficulty, metrics, profile, replay, reshape, routing, sampling,
                                scoring)
from pairflow.plans import adaptive, leaderboard, offline, study
from pairflow.sources import fixtures as FX
from pairflow.sources import prediction_store, readers, writers
from pairflow.sources.rule_scorer import rule_factory
from pairflow.streaming import running
from pairflow.workspace import materialize, repartition_as, scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
NO_DELAY = scoring.RetryPolicy(delay_s=0.0)
ROUTES = {"length": 100, "negations": 1, "overlap": 0.4}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of decimals, for comparison across engines."""
    return df.select(*[
        F.round(F.col(f"`{f.name}`"), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
        for f in df.schema.fields])


def pairs(spark, d):
    return FX.pairs(spark, d)


def cleaned(spark, d):
    return cleaning.clean(pairs(spark, d))


def featured(spark, d):
    return FT.with_features(pairs(spark, d))


def clean_features(spark, d):
    return FT.with_features(cleaned(spark, d))


def preds(spark, d):
    return FX.predictions(spark, d)


def rule_routed(spark, d):
    return routing.route_by_rule(featured(spark, d), **ROUTES)


def score_routed(spark, d, tiered=True):
    return routing.route_by_score(pairs(spark, d), FX.difficulty_score(), tiered)


def counts(spark, d, *keys):
    return metrics.outcome_counts(preds(spark, d), *keys)


# --- sources and sinks ---------------------------------------------------------------------

@query
def src1_read_split(spark, d):
    path = scratch_path(spark, "split")
    FX.raw_pairs(spark, d).write.parquet(path)
    return readers.read_split(spark, path)


@query
def src2_decode_label(spark, d):
    return readers.with_label(FX.raw_pairs(spark, d)).select("pairID", "label_id", "label")


@query
def src3_content_id(spark, d):
    keyed = readers.with_content_id(pairs(spark, d), output="content_id")
    return keyed.select("pairID", "content_id")


@query
def src4_validation_combined(spark, d):
    both = readers.combine_validation(FX.raw_pairs(spark, d), FX.turn_pairs(spark, d))
    return readers.with_label(both).select("pairID", "premise", "hypothesis", "genre", "label", "source")


@query
def src5_read_predictions_csv(spark, d):
    path = scratch_path(spark, "predictions-csv")
    stored = FX.predictions(spark, d, ["zero-shot", "few-shot", "cot"])
    writers.write_csv(stored.select("strategy", *readers.PREDICTION_SCHEMA.names), path, "strategy", compressed=True)
    return readers.read_predictions_csv(spark, path, domain.BASE_STRATEGIES)


@query
def src6_read_sample_csv(spark, d):
    path = scratch_path(spark, "sample-csv")
    writers.write_csv(cleaned(spark, d).select(*readers.PAIR_SCHEMA.names), path)
    return readers.read_pairs_csv(spark, path)


@query
def snk1_write_splits(spark, d):
    path = scratch_path(spark, "splits")
    writers.write_splits(sampling.with_full_split(sampling.prepare(pairs(spark, d))), path)
    return spark.read.parquet(path).select("pairID", "genre", "label", "split")


@query
def snk2_write_csv(spark, d):
    path = scratch_path(spark, "features-csv")
    out = rounded(featured(spark, d).select("pairID", "label", *domain.FEATURES))
    writers.write_csv(out, path)
    return writers.many_lines(spark.read.schema(out.schema).options(**readers.CSV_OPTIONS).csv(path))


@query
def snk3_write_json(spark, d):
    path = scratch_path(spark, "predictions-json")
    out = FX.prediction_table(spark, d)
    writers.write_json(out, path, "strategy")
    return spark.read.schema(out.schema).json(path)


@query
def snk4_write_summary(spark, d):
    path = scratch_path(spark, "summary")
    p = preds(spark, d)
    rows = difficulty.training_rows(clean_features(spark, d), p)
    cv = difficulty.cv_report(difficulty.out_of_fold(rows))
    counts_ = routing.distribution(score_routed(spark, d)).select(F.col("routed_strategy").alias("strategy"), "n")
    record = study.final_record(study.compare(p), cost.adaptive_savings(counts_), cv)
    writers.write_summary(record, path)
    stored = spark.read.schema(record.schema).json(path)
    return rounded(stored.select(*[c for c in stored.columns if c != "comparison"], F.inline("comparison")))


@query
def snk5_model_round_trip(spark, d):
    path = scratch_path(spark, "model")
    f = materialize(clean_features(spark, d).select("pairID", "genre", *domain.MODEL_FEATURES), "features")
    rows = materialize(difficulty.training_rows(f, preds(spark, d)), "training")
    difficulty.fit(rows).save(spark, path, difficulty.cv_report(difficulty.out_of_fold(rows)))
    loaded = difficulty.DifficultyModel.load(spark, path)
    accuracy = spark.read.parquet(f"{path}/cv").first().accuracy
    return rounded(loaded.score(f).select(
        "pairID", "predicted_difficulty", "difficulty_score", F.lit(accuracy).alias("cv_accuracy")), 4)


@query
def snk6_validate_splits(spark, d):
    path = scratch_path(spark, "splits")
    writers.write_splits(sampling.with_full_split(sampling.prepare(pairs(spark, d))), path)
    return profile.split_check(spark.read.parquet(path))


# --- filters ---------------------------------------------------------------------------------

@query
def flt1_valid_labels(spark, d):
    return cleaning.keep_valid_labels(pairs(spark, d)).select("pairID", "label")


@query
def flt2_drop_blank(spark, d):
    return cleaning.drop_blank_texts(pairs(spark, d)).select("pairID", "premise", "hypothesis")


@query
def flt3_keep_first(spark, d):
    return cleaning.keep_first(pairs(spark, d)).select("pairID", "premise", "hypothesis", "genre", "label")


@query
def flt4_cleaning_report(spark, d):
    return rounded(cleaning.cleaning_report(pairs(spark, d)))


@query
def flt5_valid_predictions(spark, d):
    return cleaning.validity_counts(preds(spark, d), "strategy")


@query
def flt6_stringified_nulls(spark, d):
    text = preds(spark, d).withColumn("predicted_label", F.coalesce("predicted_label", F.lit("nan")))
    return cleaning.validity_counts(text, "strategy", stringified=True)


@query
def flt7_normalise_labels(spark, d):
    rows = preds(spark, d).withColumn("predicted_label", F.concat(F.lit(" "), F.upper("predicted_label"), F.lit("\n")))
    return cleaning.with_normalised_labels(rows, missing="none").select("pairID", "strategy", "label", "predicted_label")


@query
def flt8_harmonise_columns(spark, d):
    first = FX.predictions(spark, d, ["zero-shot"]).select("pairID", "label", "predicted_label", "prompt_tokens")
    second = FX.predictions(spark, d, ["cot"]).select(
        "pairID", F.col("label").alias("true_label"), F.col("predicted_label").alias("bert_prediction"))
    return readers.union_sources({"zero-shot": first, "encoder": second})


@query
def flt9_feature_matrix(spark, d):
    assembled = FT.feature_matrix(FT.select_features(featured(spark, d), "pairID"))
    return rounded(assembled.select("pairID", F.round(F.aggregate(
        X_vector("features"), F.lit(0.0), lambda a, v: a + v), 6).alias("feature_sum"), *domain.MODEL_FEATURES))


def X_vector(name: str) -> Column:
    from pyspark.ml.functions import vector_to_array
    return vector_to_array(F.col(name))


@query
def flt10_error_rows(spark, d):
    return cleaning.errors_only(preds(spark, d)).select("pairID", "strategy", "label", "predicted_label")


@query
def flt11_rows_by_genre(spark, d):
    return preds(spark, d).groupBy("genre").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == F.col("predicted_label")).alias("n_correct"))


# --- sampling --------------------------------------------------------------------------------

@query
def smp1_stratified_sample(spark, d):
    return sampling.stratified_sample(cleaned(spark, d), 50).select("pairID", "genre", "label")


@query
def smp2_sample_per_genre(spark, d):
    return sampling.stratified_sample(cleaned(spark, d), 50, balance_labels=False).select("pairID", "genre", "label")


@query
def smp3_shuffled_sample(spark, d):
    sample = sampling.stratified_sample(cleaned(spark, d), 50)
    return sampling.shuffled(sample).select("pairID", "genre", "label", F.md5(F.concat("pairID", F.lit("|42"))).alias("shuffle_key"))


@query
def smp4_short_strata(spark, d):
    return sampling.short_strata(cleaned(spark, d), 1400)


@query
def smp5_train_test_split(spark, d):
    return sampling.train_test_split(cleaned(spark, d), 0.3).select("pairID", "genre", "label", "split")


@query
def smp6_prepare(spark, d):
    return sampling.prepare(pairs(spark, d), 50, 0.3).select("pairID", "premise", "hypothesis", "genre", "label", "split")


@query
def smp7_one_per_genre(spark, d):
    return sampling.one_per_genre(pairs(spark, d), ["fiction", "government", "telephone"]).select(
        "pairID", "genre", "premise", "hypothesis", "label")


# --- text ----------------------------------------------------------------------------------------

@query
def txt1_word_tokens(spark, d):
    t = X.tokens("premise")
    return pairs(spark, d).select("pairID", F.array_join(t, " ").alias("tokens"), F.size(t).alias("n_tokens"))


@query
def txt2_full_tokens(spark, d):
    t = X.tokens("premise", "full")
    return pairs(spark, d).select("pairID", F.array_join(t, " ").alias("tokens"), F.size(t).alias("n_tokens"))


@query
def txt3_overlap_without_stopwords(spark, d):
    out = FT.with_overlap(pairs(spark, d), mode="full", remove_stopwords=True)
    return rounded(out.select("pairID", "shared_words", "jaccard_similarity", "hypothesis_overlap", "premise_coverage"))


@query
def txt4_lengths(spark, d):
    return rounded(FT.with_lengths(pairs(spark, d)).select(
        "pairID", "premise_length", "hypothesis_length", "combined_length", "length_ratio", "char_length"))


@query
def txt5_negations(spark, d):
    return FT.with_negations(pairs(spark, d)).select(
        "pairID", "premise_negations", "hypothesis_negations", "total_negations")


@query
def txt6_overlap(spark, d):
    return rounded(FT.with_overlap(pairs(spark, d)).select(
        "pairID", "jaccard_similarity", "lexical_overlap", "hypothesis_overlap", "premise_coverage", "shared_words"))


@query
def txt7_all_features(spark, d):
    return rounded(featured(spark, d).select("pairID", *domain.FEATURES))


@query
def txt8_features_replace_columns(spark, d):
    again = FT.with_features(FT.with_features(cleaned(spark, d)))
    return rounded(again.select("pairID", "genre", "label", *domain.FEATURES))


@query
def txt9_mean_word_counts(spark, d):
    return rounded(profile.mean_word_counts(pairs(spark, d)))


@query
def txt10_approx_tokens(spark, d):
    return pairs(spark, d).select("pairID", X.approx_tokens("premise").alias("premise_tokens"),
                                  X.approx_tokens("hypothesis").alias("hypothesis_tokens"))


@query
def txt11_truncate(spark, d):
    return pairs(spark, d).select("pairID", X.truncate("premise", 100).alias("premise_short"),
                                  X.truncate("hypothesis", 50).alias("hypothesis_short"))


@query
def txt12_parse_label(spark, d):
    # Over the answers and over the free texts themselves.
    wordy = F.concat(F.lit("Not ENTAILED by: "), "premise", F.lit("; rather "), "raw_response")
    rows = preds(spark, d).select(F.inline(F.array(
        F.struct(F.concat_ws("/", "pairID", "strategy").alias("id"), F.col("raw_response").alias("t")),
        F.struct(F.concat_ws("/", "pairID", "strategy", F.lit("wordy")).alias("id"), wordy.alias("t")))))
    return rows.select("id", X.parse_label("t").alias("label"), X.parse_label("t", "last_mention").alias("last_label"))


@query
def txt13_canonical_strategy(spark, d):
    raw = F.when(F.col("strategy") == "cot", F.lit("Chain_Of_Thought")).otherwise(
        F.upper(F.replace(F.col("strategy"), F.lit("-"), F.lit("_"))))
    return preds(spark, d).groupBy(X.checked_strategy(raw).alias("strategy"), raw.alias("given")).agg(
        F.count(F.lit(1)).alias("n"))


def _prompt_digest(df: DataFrame, prompt: Column) -> DataFrame:
    return _variant_digests(df, {"": prompt}).drop("variant")


def _variant_digests(df: DataFrame, variants: dict[str, Column]) -> DataFrame:
    """Digest and size of several prompts of each row, from one pass over the table."""
    rows = df.select("pairID", F.inline(F.array(*[
        F.struct(F.lit(v).alias("variant"), p.alias("prompt")) for v, p in variants.items()])))
    return rows.select("pairID", F.md5("prompt").alias("prompt_md5"), F.length("prompt").alias("prompt_chars"),
                       X.approx_tokens("prompt").alias("prompt_tokens"), "variant")


def _ph() -> tuple[Column, Column]:
    return F.col("premise"), F.col("hypothesis")


@query
def txt14_zero_shot_prompt(spark, d):
    return _prompt_digest(pairs(spark, d), PR.zero_shot(*_ph()))


@query
def txt15_one_shot_prompt(spark, d):
    return _prompt_digest(pairs(spark, d), PR.one_shot(*_ph()))


@query
def txt16_few_shot_prompt(spark, d):
    own = F.array(F.struct(F.col("hypothesis").alias("premise"), F.col("premise").alias("hypothesis"), "label"))
    return _variant_digests(pairs(spark, d), {
        "five": PR.few_shot(*_ph()), "six": PR.few_shot(*_ph(), count=6), "custom": PR.few_shot_from(*_ph(), own)})


@query
def txt17_cot_prompt(spark, d):
    return _variant_digests(pairs(spark, d), {
        "example": PR.chain_of_thought(*_ph()), "plain": PR.chain_of_thought(*_ph(), with_example=False)})


@query
def txt18_six_shot_cot_prompt(spark, d):
    return _prompt_digest(pairs(spark, d), PR.six_shot_cot(*_ph()))


@query
def txt19_prompt_by_strategy(spark, d):
    rows = FX.with_strategies(pairs(spark, d), domain.STRATEGIES)
    return PR.with_prompt(rows).select("pairID", "strategy", F.md5("prompt").alias("prompt_md5"))


@query
def txt20_routing_reason(spark, d):
    return score_routed(spark, d).select("pairID", "routed_strategy", "routing_reasoning")


@query
def txt21_confusion_key(spark, d):
    return metrics.error_pairs(counts(spark, d))


@query
def txt22_plausible_label(spark, d):
    return pairs(spark, d).select("pairID", X.plausible_label("premise", "hypothesis").alias("plausible_label"))


# --- routing ---------------------------------------------------------------------------------------

@query
def rte1_rule_routing(spark, d):
    return rule_routed(spark, d).select("pairID", "genre", "routed_strategy")


@query
def rte2_rule_distribution(spark, d):
    return rounded(routing.distribution(rule_routed(spark, d)))


@query
def rte3_binary_routing(spark, d):
    return rounded(score_routed(spark, d, False).select("pairID", "difficulty_score", "routing_confidence", "routed_strategy"))


@query
def rte4_tiered_routing(spark, d):
    return rounded(score_routed(spark, d).select("pairID", "difficulty_score", "routing_confidence", "routed_strategy"))


@query
def rte5_no_model(spark, d):
    return routing.route_by_score(pairs(spark, d), None).select(
        "pairID", "routed_strategy", "difficulty_score", "routing_confidence", "routing_reasoning",
        "estimated_tokens", "has_model")


@query
def rte6_confidence(spark, d):
    return rounded(pairs(spark, d).select("pairID", routing.score_confidence(FX.difficulty_score()).alias("confidence")))


@query
def rte7_batch_routing(spark, d):
    return rounded(score_routed(spark, d).select(
        "pairID", "routed_strategy", "difficulty_score", "routing_confidence", "estimated_tokens"))


@query
def rte8_savings_estimate(spark, d):
    return rounded(routing.routing_savings(score_routed(spark, d)))


@query
def rte9_routing_summary(spark, d):
    return rounded(routing.routing_summary(routing.routing_counters(score_routed(spark, d))))


@query
def rte10_share_within_genre(spark, d):
    return rounded(routing.share_within_genre(rule_routed(spark, d)))


# --- scoring -----------------------------------------------------------------------------------------

# Latencies are measured: the checks only see that there is one.
SCORED_COLUMNS = ["pairID", "strategy", "raw_response", "predicted_label", "prompt_tokens", "response_tokens",
                  "success", "error", "attempts"]


def _scored(spark, d, strategies=None, **options):
    return scoring.score(pairs(spark, d), rule_factory(), NO_DELAY, keep=("pairID", "strategy"), strategies=strategies, **options)


@query
def inf1_score_table(spark, d):
    return _scored(spark, d, ["zero-shot"]).select(*SCORED_COLUMNS, (F.col("latency_ms") >= 0).alias("timed"))


@query
def inf2_bounded_concurrency(spark, d):
    return _scored(spark, d, ["few-shot"], limits=scoring.Limits(in_flight=400), empty_error=True).select(*SCORED_COLUMNS)


@query
def inf3_retries(spark, d):
    return _scored(spark, d, ["cot"]).groupBy("success", "error", "attempts").agg(F.count(F.lit(1)).alias("n"))


@query
def inf4_batch_summary(spark, d):
    return rounded(scoring.batch_summary(preds(spark, d), "strategy").drop("retries"))


@query
def inf5_several_strategies(spark, d):
    return study.run_strategies(pairs(spark, d), rule_factory(), domain.STRATEGIES, limits=scoring.Limits(in_flight=8000),
                                keep=("pairID", "strategy")).select(
        "pairID", "strategy", "predicted_label", "prompt_tokens", "response_tokens")


@query
def inf6_token_limits(spark, d):
    limits = preds(spark, d).select(
        "strategy", scoring.study_limit(F.col("strategy")).alias("study_limit"),
        scoring.adaptive_limit(F.col("strategy")).alias("adaptive_limit"))
    return limits.groupBy("strategy", "study_limit", "adaptive_limit").agg(F.count(F.lit(1)).alias("n"))


@query
def inf7_label_from_scores(spark, d):
    # Sums over three blocks that cover the whole vector stand for the class scores.
    third = F.floor(F.size("embedding") / 3).cast("int")
    total = lambda start, n: F.aggregate(F.slice("embedding", start, n), F.lit(0.0), lambda a, v: a + v.cast("double"))
    scores = F.array(total(F.lit(1), third), total(third + 1, third), total(2 * third + 1, F.size("embedding")))
    return FX.table(spark, d, "embeddings").select("vec_id", X.label_from_scores(scores).alias("predicted_label"))


@query
def inf8_resume(spark, d):
    p = pairs(spark, d)
    stored = FX.scored(p, ["zero-shot", "cot"]).where("success").withColumn("attempts", F.lit(1))
    wanted = scoring.missing_strategies(p.select("pairID", "premise", "hypothesis"), stored, domain.BASE_STRATEGIES)
    # Waves store a pair's texts once; its rows and their prompts are made when a wave is read.
    fresh = scoring.score_stored(
        wanted, scratch_path(spark, "scored"), rule_factory(), waves=4, keys=("pairID",), policy=NO_DELAY, keep=("pairID", "strategy"),
        ready=lambda rows: PR.with_prompt(rows.withColumn("strategy", F.explode("missing")).drop("missing")))
    done = stored.unionByName(fresh, allowMissingColumns=True)
    return done.select("pairID", "strategy", "raw_response", "predicted_label", "attempts")


@query
def inf9_score_routed(spark, d):
    rows = scoring.for_routed(rule_routed(spark, d)).select("pairID", "premise", "hypothesis", "strategy", "prompt", "max_tokens")
    out = scoring.score(rows, rule_factory(), NO_DELAY, empty_error=True, keep=("pairID", "strategy", "max_tokens"))
    # A sort reads its input twice, first for the bounds of its ranges: answers are stored, so that no pair is scored twice.
    stored = materialize(out.select("pairID", "strategy", "max_tokens", "predicted_label", "prompt_tokens", "error"), "answers")
    return writers.in_display_order(stored)


# --- metrics -------------------------------------------------------------------------------------------

@query
def met1_accuracy(spark, d):
    return rounded(metrics.accuracy(preds(spark, d), "strategy"))


@query
def met2_confusion_matrix(spark, d):
    return metrics.confusion_matrix(counts(spark, d, "strategy"), "strategy")


@query
def met3_observed_confusion(spark, d):
    return metrics.observed_confusion_matrix(counts(spark, d))


@query
def met4_per_class(spark, d):
    return rounded(metrics.per_class(counts(spark, d, "strategy"), "strategy", labels=domain.LABELS))


@query
def met5_macro_scores(spark, d):
    return rounded(metrics.metrics(preds(spark, d), "genre").select("genre", "macro_f1", "macro_precision", "macro_recall"))


@query
def met6_weighted_f1(spark, d):
    return rounded(metrics.metrics(preds(spark, d), "strategy").select("strategy", "weighted_f1"))


@query
def met7_full_report(spark, d):
    return rounded(metrics.metrics(preds(spark, d)))


@query
def met8_per_genre(spark, d):
    return rounded(metrics.compare(preds(spark, d), "genre"))


@query
def met9_strategy_comparison(spark, d):
    return rounded(study.compare(preds(spark, d)))


@query
def met10_confusion_patterns(spark, d):
    return rounded(metrics.confusion_patterns(counts(spark, d)))


@query
def met11_top_confusions(spark, d):
    return metrics.top_confusions(counts(spark, d, "strategy"), "strategy", k=2)


@query
def met12_patterns_by_strategy(spark, d):
    return rounded(study.confusion_by_strategy(preds(spark, d)))


def _paired(spark, d):
    return metrics.paired_counts(metrics.correctness_profiles(preds(spark, d)))


@query
def met13_mcnemar(spark, d):
    return rounded(metrics.mcnemar(_paired(spark, d)).select(
        "strategy_a", "strategy_b", "a_only_correct", "b_only_correct", "statistic", "significant"))


@query
def met13_mcnemar_p_value(spark, d):
    return rounded(metrics.with_p_value(metrics.mcnemar(_paired(spark, d))).select("strategy_a", "strategy_b", "statistic", "p_value"))


@query
def met13_mcnemar_quality_toxic(spark, d):
    # Two real label columns of the same documents, each judged as a prediction of the other's complement.
    labels = FX.table(spark, d, "labels")
    long = labels.select("doc_id", F.inline(F.array(
        F.struct(F.lit("zero-shot").alias("strategy"), F.col("quality").alias("predicted_label")),
        F.struct(F.lit("cot").alias("strategy"), (1 - F.col("toxic")).alias("predicted_label")),
    ))).withColumn("label", F.lit(1))
    names = ["zero-shot", "cot"]
    profiles = metrics.correctness_profiles(long, names, id_col="doc_id")
    return rounded(metrics.mcnemar(metrics.paired_counts(profiles, names)))


@query
def met14_crosstab_margins(spark, d):
    return profile.crosstab_with_margins(pairs(spark, d))


@query
def met15_crosstab(spark, d):
    return profile.crosstab(cleaned(spark, d), values=domain.LABELS)


@query
def met16_validation_report(spark, d):
    return profile.validation_report(pairs(spark, d).select("pairID", "premise", "hypothesis", "genre", "label"))


@query
def met17_sample_statistics(spark, d):
    s = profile.sample_statistics(cleaned(spark, d))
    return rounded(s.select("genre", "total", "total_samples", "avg_premise_words", "avg_hypothesis_words",
                            *[f"all_{l}" for l in domain.LABELS], *[F.coalesce(F.try_element_at("labels", F.lit(l)), F.lit(0)).cast("long").alias(l)
                              for l in domain.LABELS]))


@query
def met18_value_counts(spark, d):
    return rounded(profile.value_counts_of(pairs(spark, d), ["genre", "label"]))


@query
def met19_accuracy_by_genre(spark, d):
    return rounded(metrics.accuracy(preds(spark, d), "strategy", "genre"))


@query
def met20_normalised_by_genre(spark, d):
    return rounded(adaptive.evaluate(preds(spark, d), "genre").select("genre", "accuracy", "macro_f1", "n_samples"))


def _sources(spark, d):
    first = FX.predictions(spark, d, ["zero-shot"]).select("pairID", "label", "predicted_label")
    second = FX.predictions(spark, d, ["cot"]).select(
        "pairID", F.upper("label").alias("true_label"), F.col("predicted_label").alias("bert_prediction"))
    third = FX.predictions(spark, d, ["few-shot"]).select(
        "pairID", "label", F.coalesce("predicted_label", F.lit("nan")).alias("predicted_label"))
    return {"zero-shot": first, "encoder": second, "few-shot": third}


@query
def met21_ranked_sources(spark, d):
    return rounded(leaderboard.ranked(_sources(spark, d)))


@query
def met21_detailed_sources(spark, d):
    return rounded(leaderboard.detailed(_sources(spark, d)).select("strategy", "accuracy", "macro_f1", "n_samples", "n_invalid"))


@query
def met22_improvement(spark, d):
    return rounded(metrics.improvement(metrics.metrics(preds(spark, d), "strategy")))


@query
def met23_paired_counts(spark, d):
    return _paired(spark, d)


@query
def met24_feature_summary(spark, d):
    return rounded(profile.feature_summary(featured(spark, d)), 2)


@query
def met25_correlations(spark, d):
    return rounded(profile.correlations(featured(spark, d)))


@query
def met26_box_stats(spark, d):
    f = featured(spark, d)
    return rounded(profile.box_stats(f, "combined_length", "genre").withColumnRenamed("genre", "group").withColumn("feature", F.lit("combined_length")).unionByName(
        profile.box_stats(f, "jaccard_similarity", "label").withColumnRenamed("label", "group").withColumn("feature", F.lit("jaccard_similarity"))))


@query
def met27_mean_negations(spark, d):
    return rounded(profile.mean_by_genre(featured(spark, d)))


# --- cost ------------------------------------------------------------------------------------------------

def _by_strategy(spark, d):
    return preds(spark, d).groupBy("strategy").agg(F.count(F.lit(1)).alias("n"))


def _planned(spark, d):
    return cost.sample_size_per_strategy(pairs(spark, d))


@query
def cst1_token_price(spark, d):
    priced = preds(spark, d).select("strategy", "prompt_tokens", "response_tokens", F.explode(
        F.array(*[F.lit(m) for m in domain.PRICES])).alias("model"))
    # Prices are linear in tokens: add the tokens up first, price the few sums after.
    sums = priced.groupBy("strategy", "model").agg(
        F.sum("prompt_tokens").alias("input_tokens"), F.sum("response_tokens").alias("output_tokens"))
    return rounded(sums.withColumn("cost_usd", cost.token_price(
        F.col("input_tokens"), F.col("output_tokens"), F.col("model"))), 9)


@query
def cst2_strategy_cost(spark, d):
    return rounded(cost.with_strategy_cost(_by_strategy(spark, d)), 9)


@query
def cst3_cost_comparison(spark, d):
    return rounded(cost.cost_comparison(_planned(spark, d)), 9)


def _routed_counts(spark, d):
    return routing.distribution(score_routed(spark, d)).select(F.col("routed_strategy").alias("strategy"), "n")


@query
def cst4_adaptive_savings(spark, d):
    return rounded(cost.adaptive_savings(_routed_counts(spark, d)), 9)


@query
def cst5_cost_accuracy(spark, d):
    return rounded(study.frontier(preds(spark, d)).drop("pareto_optimal"), 9)


@query
def cst6_pareto(spark, d):
    # Every prediction as an item: cost from its tokens, value from its speed.
    items = preds(spark, d).select("pairID", "strategy", F.col("prompt_tokens").cast("double").alias("cost_usd"),
                                   F.col("response_tokens").cast("double").alias("accuracy"))
    return cost.with_pareto_flag(items)


@query
def cst7_budget(spark, d):
    return rounded(cost.budget_projection(cost.equal_weights(_planned(spark, d)), 25.0), 12)


@query
def cst7_budget_by_routed_share(spark, d):
    share = routing.distribution(score_routed(spark, d)).select(
        F.col("routed_strategy").alias("strategy"), F.col("share").alias("weight"))
    return rounded(cost.budget_projection(share, 25.0), 12)


def _routed_predictions(spark, d, **thresholds):
    routed = routing.route_by_rule(featured(spark, d), **thresholds)
    return adaptive.routed_outcomes(routed, FX.prediction_table(spark, d))


@query
def cst8_token_roi(spark, d):
    return rounded(adaptive.roi(_routed_predictions(spark, d, **ROUTES)), 9)


@query
def cst8_token_roi_fallback(spark, d):
    return rounded(adaptive.roi(_routed_predictions(spark, d)), 9)


@query
def cst9_planned_usage(spark, d):
    return rounded(cost.planned_usage(_planned(spark, d)), 9)


@query
def cst10_usage_summary(spark, d):
    used = FX.predictions(spark, d, ["zero-shot", "few-shot", "cot"])
    return rounded(cost.usage_summary(cost.usage_counters(used)))


@query
def cst11_measured_savings(spark, d):
    p = FX.predictions(spark, d, ["zero-shot", "cot"])  # no few-shot rows: its default applies
    return rounded(cost.replay_savings(_routed_counts(spark, d), cost.measured_tokens(p)))


# --- joins, sets, reshaping ----------------------------------------------------------------------------------

@query
def jon1_append_features(spark, d):
    return rounded(FT.with_features(pairs(spark, d)).select("pairID", "premise", "hypothesis", "jaccard_similarity", "shared_words"))


def _stored(spark, d, *strategies, partial=False):
    """Predictions of these strategies alone, bucketed by pair; partial: failed calls were never stored."""
    p = FX.predictions(spark, d, list(strategies) or domain.BASE_STRATEGIES).drop("premise", "hypothesis", "genre")
    return prediction_store.read(spark, prediction_store.write(p.where("success") if partial else p))


@query
def jon2_replay(spark, d):
    return rounded(offline.replayed(score_routed(spark, d), _stored(spark, d)))


@query
def jon3_common_rows(spark, d):
    p = _stored(spark, d, "zero-shot", "cot", partial=True)
    zero, cot = p.where("strategy = 'zero-shot'"), p.where("strategy = 'cot'")
    return replay.common_rows(zero, cot).select("pairID", "label", "predicted_label")


@query
def jon3_alignment_report(spark, d):
    p = _stored(spark, d, "zero-shot", "cot", partial=True)
    return replay.alignment_report(p.where("strategy = 'zero-shot'"), p.where("strategy = 'cot'"))


@query
def jon4_common_accuracies(spark, d):
    return rounded(offline.accuracies(score_routed(spark, d), _stored(spark, d, partial=True)))


@query
def jon5_dimension_lookup(spark, d):
    stats = _by_strategy(spark, d)
    joined = replay.with_dimension(stats, cost.token_table(spark), "strategy", "input", domain.COST_TOKENS_DEFAULT[0])
    return replay.with_constant(joined, "strategy", domain.ROUTER_TOKENS, "router_tokens", 0)


@query
def jon6_undominated(spark, d):
    items = FT.with_lengths(pairs(spark, d)).select(
        "pairID", F.col("char_length").cast("double").alias("cost_usd"), F.col("hypothesis_length").cast("double").alias("accuracy"))
    return cost.undominated(items)


@query
def jon7_paired_correctness(spark, d):
    return replay.paired_correctness(_stored(spark, d, "zero-shot", "cot"), "zero-shot", "cot")


@query
def set1_union_sources(spark, d):
    both = readers.combine_validation(FX.raw_pairs(spark, d), FX.turn_pairs(spark, d))
    return both.groupBy("source", "genre").agg(F.count(F.lit(1)).alias("n"))


@query
def set2_token_sets(spark, d):
    p, h = X.word_tokens("premise"), X.word_tokens("hypothesis")
    return pairs(spark, d).select(
        "pairID", F.size(F.array_intersect(p, h)).alias("n_both"), F.size(F.array_union(p, h)).alias("n_either"),
        F.size(F.array_except(p, h)).alias("n_premise_only"))


@query
def set3_observed_labels(spark, d):
    return metrics.observed_labels(counts(spark, d, "strategy"), "strategy")


def _genre_metrics(spark, d):
    return metrics.metrics(preds(spark, d), "strategy", "genre")


@query
def shp1_genre_by_strategy(spark, d):
    return rounded(reshape.pivot_metric(_genre_metrics(spark, d)))


@query
def shp2_genre_improvement(spark, d):
    return rounded(reshape.genre_improvement(_genre_metrics(spark, d)))


@query
def shp3_class_f1_by_strategy(spark, d):
    return rounded(reshape.class_f1_by_strategy(study.compare(preds(spark, d))))


@query
def shp3_class_f1_long(spark, d):
    return rounded(reshape.class_f1_long(study.compare(preds(spark, d))))


@query
def shp4_normalised_confusion(spark, d):
    labels = domain.LABELS + ["none"]
    matrix = metrics.confusion_matrix(counts(spark, d, "strategy"), "strategy", labels=labels)
    return rounded(metrics.normalised_confusion(matrix, "strategy"))


@query
def shp5_progression(spark, d):
    return rounded(reshape.progression(metrics.metrics(preds(spark, d), "strategy")))


@query
def shp6_pareto_points(spark, d):
    return rounded(cost.pareto_points(study.frontier(preds(spark, d))).select("strategy", "accuracy", "cost_usd"), 9)


# --- windows, sorts, top-k --------------------------------------------------------------------------------------

@query
def win1_first_per_key(spark, d):
    return cleaning.keep_first(pairs(spark, d)).select("pairID", "label")


@query
def win2_ratio_to_minimum(spark, d):
    return rounded(cost.cost_comparison(_by_strategy(spark, d)).select("strategy", "relative_cost"))


@query
def win3_share_of_total(spark, d):
    return rounded(routing.distribution(score_routed(spark, d)))


@query
def win4_running_best(spark, d):
    # Pairs as items: characters cost, shared words count.
    items = featured(spark, d).select("pairID", F.col("char_length").cast("double").alias("cost_usd"),
                                      F.col("shared_words").cast("double").alias("accuracy"))
    return cost.with_pareto_flag(items).groupBy("pareto_optimal").agg(
        F.count(F.lit(1)).alias("n"), F.sum("cost_usd").alias("cost_total"), F.max("accuracy").alias("best"))


@query
def srt1_sort_by_metric(spark, d):
    return rounded(metrics.compare(preds(spark, d), "genre").select("genre", "accuracy"))


@query
def srt2_sort_by_absolute(spark, d):
    model = difficulty.fit(difficulty.training_rows(clean_features(spark, d), preds(spark, d)))
    return rounded(model.importance(spark))


@query
def srt3_restore_order(spark, d):
    return writers.in_display_order(rule_routed(spark, d).select("pairID", "routed_strategy"))


@query
def top1_top_error_pairs(spark, d):
    return metrics.top_confusions(counts(spark, d), k=2)


@query
def top1_top_genres(spark, d):
    return rounded(reshape.genre_improvement(_genre_metrics(spark, d), k=3))


@query
def top2_best_strategy_matrix(spark, d):
    c = materialize(counts(spark, d, "strategy"))
    best = metrics.best_strategy(metrics.report(c, "strategy"))
    return metrics.confusion_matrix(c.join(best, "strategy", "left_semi"), "strategy")


# --- difficulty model ------------------------------------------------------------------------------------------------

def _training(spark, d):
    return difficulty.training_rows(clean_features(spark, d), preds(spark, d))


def _training_table(spark, d):
    """The training rows without their texts, stored: they are fitted and then scored."""
    return materialize(_training(spark, d).select("pairID", "genre", "target", *domain.MODEL_FEATURES), "training")


@query
def ml1_hard_target(spark, d):
    return _training(spark, d).select("pairID", "target")


@query
def ml2_standardise(spark, d):
    rows = clean_features(spark, d)
    scaling = difficulty.fit_scaling(rows)
    return rounded(scaling.apply(rows).select("pairID", *scaling.columns))


@query
def ml3_coefficients(spark, d):
    return rounded(difficulty.fit(_training(spark, d)).importance(spark))


@query
def ml4_out_of_fold(spark, d):
    return rounded(difficulty.out_of_fold(_training(spark, d)), 4)


@query
def ml5_cv_report(spark, d):
    return rounded(difficulty.cv_class_report(difficulty.out_of_fold(_training(spark, d))))


@query
def ml6_training_summary(spark, d):
    return difficulty.training_summary(_training(spark, d))


@query
def ml7_top_importance(spark, d):
    return rounded(difficulty.fit(_training(spark, d)).importance(spark, 5))


@query
def ml8_predict(spark, d):
    rows = _training_table(spark, d)
    return rounded(difficulty.fit(rows).score(rows).select(
        "pairID", "predicted_difficulty", "p_easy", "p_hard", "difficulty_score"), 4)


@query
def ml9_difficulty_by_genre(spark, d):
    rows = _training_table(spark, d)
    return difficulty.difficulty_by_genre(difficulty.fit(rows).score(rows))


@query
def ml9_score_spread_by_genre(spark, d):
    """The report itself on the deterministic score."""
    scored = pairs(spark, d).withColumn("difficulty_score", FX.difficulty_score()).withColumn(
        "predicted_difficulty", (F.col("difficulty_score") > 0.5).cast("int"))
    return difficulty.difficulty_by_genre(scored)


@query
def ml10_train_and_route(spark, d):
    split = sampling.train_test_split(cleaned(spark, d))
    features = materialize(FT.with_features(split).select("pairID", "split", *domain.MODEL_FEATURES), "features")
    model = study.train_router(features.where("split = 'train'"), preds(spark, d))
    model.save(spark, scratch_path(spark, "router"))
    return rounded(routing.routing_savings(study.apply_router(model, features.where("split = 'test'"))))


# --- streaming -------------------------------------------------------------------------------------------------------------

def _pair_stream(spark, d):
    # Several files in several triggers, so that state is carried from batch to batch.
    batch = FX.table(spark, d, "documents").select("doc_id", "source", "text")
    files = max(4, batch.rdd.getNumPartitions())
    path = scratch_path(spark, "stream")
    batch.repartition(files, "doc_id").write.parquet(path)
    stream = running.read_stream(spark, path, batch.schema, files_per_trigger=-(-files // 4))
    return readers.with_label(FX.document_pairs(repartition_as(stream, batch, "doc_id")))


@query
def str1_running_routing(spark, d):
    routed = routing.route_by_score(_pair_stream(spark, d), FX.difficulty_score())
    totals = running.routing_totals(routed, domain.ROUTER_TOKENS, 0)
    return running.run_to_table(totals, "str1", "update", keys=["routed_strategy"])


@query
def str2_running_usage(spark, d):
    return running.run_to_table(running.usage_totals(FX.scored(_pair_stream(spark, d))), "str2", "update", keys=["strategy"])


@query
def str3_running_calls(spark, d):
    calls = FX.scored(_pair_stream(spark, d)).withColumn("model", F.when(
        F.col("strategy").endswith("cot"), F.lit("gpt-4o")).otherwise(F.lit("gpt-4o-mini")))
    return running.run_to_table(running.call_totals(calls), "str3", "update", keys=["model"])


@query
def str4_call_history(spark, d):
    return running.run_to_table(running.call_history(FX.scored(_pair_stream(spark, d), ["zero-shot", "cot"])), "str4")


@query
def str5_streaming_features(spark, d):
    out = running.features_and_route(_pair_stream(spark, d), **ROUTES)
    return running.run_to_table(rounded(out.select("pairID", *domain.FEATURES, "routed_strategy")), "str5")


# --- compositions --------------------------------------------------------------------------------------------------------------

@query
def adaptive_summary(spark, d):
    """Flagship: clean, featurise, route, replay, accuracy and savings by genre and strategy."""
    return rounded(adaptive.summary(pairs(spark, d), FX.prediction_table(spark, d), **ROUTES))


@query
def adaptive_run(spark, d):
    scored = adaptive.run(FX.pairs(spark, d), rule_factory(), per_genre=None, **ROUTES)
    return rounded(adaptive.evaluate(scored, "genre"))


@query
def offline_savings(spark, d):
    p = _stored(spark, d)
    return rounded(offline.savings(offline.replayed(score_routed(spark, d), p), p))
