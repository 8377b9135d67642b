import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairflow import domain
from pairflow.operators import cleaning, profile, sampling, selection
from pairflow.sources import fixtures, readers, writers
from pairflow.workspace import materialize, scratch_path


@pytest.fixture(scope="module")
def skewed(spark):
    """A stratum with most of the rows, copies of one text that make up a third of them."""
    base = spark.range(6000).select(
        F.concat(F.lit("p"), "id").alias("pairID"),
        F.when(F.col("id") % 3 == 0, F.lit("same premise")).otherwise(F.concat(F.lit("premise "), "id")).alias("premise"),
        F.when(F.col("id") % 3 == 0, F.lit("same hypothesis")).otherwise(F.concat(F.lit("hyp "), "id")).alias("hypothesis"),
        F.when(F.col("id") % 10 < 8, "fiction").when(F.col("id") % 10 == 8, "slate").alias("genre"),
        F.element_at(F.array(*[F.lit(l) for l in domain.LABELS + ["unknown"]]), (F.col("id") % 4 + 1).cast("int")).alias("label"))
    return materialize(base)


def test_keep_first_takes_the_smallest_id(spark, skewed):
    kept = cleaning.keep_first(skewed)
    assert kept.columns == skewed.columns
    assert kept.count() == 4001
    assert kept.where("premise = 'same premise'").first().pairID == "p0"


def test_cleaning_report_matches_clean(spark):
    df = spark.createDataFrame([
        ("1", "a", "b", "g", "neutral"), ("2", "a", "b", "g", "entailment"), ("3", "a", " \n", "g", "neutral"),
        ("4", None, "x", "g", "neutral"), ("5", "q", "r", "g", "unknown"), ("6", "q", "r", "g", None),
    ], "pairID string, premise string, hypothesis string, genre string, label string")
    r = cleaning.cleaning_report(df).first()
    assert (r.n_input, r.n_bad_label, r.n_blank, r.n_duplicate, r.n_kept, r.n_removed) == (6, 2, 2, 1, 1, 5)
    assert [x.pairID for x in cleaning.clean(df).collect()] == ["1"]


def test_cleaning_report_of_nothing(spark):
    empty = spark.createDataFrame([], "pairID string, premise string, hypothesis string, genre string, label string")
    r = cleaning.cleaning_report(empty).first()
    assert (r.n_input, r.n_kept, r.removed_pct) == (0, 0, None)


def test_label_quotas():
    assert sampling.label_quotas(50) == {"entailment": 17, "neutral": 17, "contradiction": 16}
    assert sampling.label_quotas(1) == {"entailment": 1, "neutral": 0, "contradiction": 0}


@pytest.mark.parametrize("balance", [True, False])
@pytest.mark.parametrize("per_genre", [2, 50, 1500])
def test_both_sampling_paths_agree(monkeypatch, skewed, per_genre, balance):
    def sample():
        return {r.pairID for r in sampling.stratified_sample(skewed, per_genre, balance_labels=balance).collect()}

    by_limit = sample()
    monkeypatch.setattr(sampling, "GROUP_LIMIT", 0)
    assert sample() == by_limit


def test_quotas_respected_and_short_strata_reported(skewed):
    sample = sampling.stratified_sample(skewed, 1000)
    got = {(r.genre, r.label): r["count"] for r in sample.groupBy("genre", "label").count().collect()}
    have = {(r.genre, r.label): r["count"] for r in skewed.groupBy("genre", "label").count().collect()}
    quotas = sampling.label_quotas(1000)
    assert got == {k: min(n, quotas[k[1]]) for k, n in have.items() if k[1] in quotas}
    short = {(r.genre, r.label) for r in sampling.short_strata(skewed, 1000).collect()}
    assert short == {k for k in ((g, l) for g in ("fiction", "slate", None) for l in domain.LABELS)
                     if have.get(k, 0) < quotas[k[1]]}


def test_split_is_disjoint_complete_and_exact(skewed):
    rows = skewed.where("label <> 'unknown'")
    split = sampling.train_test_split(rows, 0.3)
    total, test = rows.count(), split.where("split = 'test'").count()
    assert split.count() == total == split.select("pairID").distinct().count()
    assert test == -(-3 * total // 10)
    for r in split.groupBy("genre", "label").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "test").alias("t")).collect():
        assert abs(r.t - 0.3 * r.n) < 1


@pytest.mark.parametrize("broadcast_rows", [0, 20_000])
def test_first_flag_with_and_without_broadcast(monkeypatch, skewed, broadcast_rows):
    small = selection.broadcast_if_small
    monkeypatch.setattr(selection, "broadcast_if_small", lambda df: small(df, broadcast_rows))
    flagged = selection.with_first_flag(
        skewed, ["genre"], lambda s: s.withColumn("quota", F.lit(700).cast("long")), "_in")
    want = {r.pairID for r in selection.first_n(skewed, ["genre"], 700).collect()}
    assert {r.pairID for r in flagged.where("_in").collect()} == want


def test_group_rank_equals_row_number(skewed):
    from pyspark.sql import Window as W

    from pairflow.functions.ordering import shuffle_key
    ranked = selection.with_group_rank(skewed, ["label"], "r", digits=2)
    plain = skewed.withColumn("k", shuffle_key()).withColumn(
        "w", F.row_number().over(W.partitionBy("label").orderBy("k", "pairID"))).select("pairID", "w")
    assert ranked.join(plain, "pairID").where("r <> w").count() == 0


def test_group_limit_runs_before_the_shuffle(skewed):
    plan = sampling.stratified_sample(skewed, 50)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_sample_order_is_reproducible(skewed):
    sample = sampling.stratified_sample(skewed, 30)
    first = [r.pairID for r in sampling.shuffled(sample).collect()]
    assert first == [r.pairID for r in sampling.shuffled(sample.repartition(5)).collect()]
    assert first != sorted(first)


def test_csv_round_trip_keeps_difficult_texts(spark):
    path = scratch_path(spark, "csv")
    rows = [("1", 'say "hi", ok', "line\nbreak", "g", "neutral"), ("2", "  padded ", "", None, "\\"), ("3", "é中", "a,b", "g", None)]
    df = spark.createDataFrame(rows, readers.PAIR_SCHEMA)
    writers.write_csv(df, path)
    assert sorted(map(tuple, readers.read_pairs_csv(spark, path).collect())) == sorted(rows)


def test_ids(spark):
    path = scratch_path(spark, "ids")
    spark.createDataFrame([("a", "b", "g")] * 3 + [("a|b", "", "g")], "premise string, hypothesis string, genre string").write.parquet(path)
    df = spark.read.parquet(path)
    assert readers.with_content_id(df).select("pairID").distinct().count() == 2
    assert readers.with_position_id(df).select("pairID").distinct().count() == 4


def test_missing_strategy_is_skipped(spark, predictions):
    path = scratch_path(spark, "preds")
    writers.write_predictions(predictions.where("strategy in ('cot', 'one-shot')"), path)
    got = {r.strategy for r in readers.read_predictions(spark, path, domain.BASE_STRATEGIES).select("strategy").distinct().collect()}
    assert got == {"cot", "one-shot"}
    chosen = readers.read_predictions(spark, path, ["cot"])
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = chosen._jdf.queryExecution().explainString(mode)
    assert "PartitionFilters: [(strategy" in plan.replace("isnotnull(strategy", "(strategy")


def test_bucketed_tables_join_without_shuffle(spark, pairs, predictions):
    for name, df in (("t_pairs", pairs), ("t_predictions", predictions)):
        writers.write_bucketed(df, name, scratch_path(spark, name), 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("t_pairs").join(spark.table("t_predictions").select("pairID", "strategy"), "pairID")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == predictions.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("t_pairs", "t_predictions"):
            spark.sql(f"DROP TABLE {name}")


def test_exact_quantiles_equal_numpy(spark):
    import numpy as np
    rng = np.random.default_rng(7)
    data = [(g, float(v)) for g, n in (("a", 999), ("b", 4), ("c", 1)) for v in np.round(rng.normal(0, 50, n), 1)]
    df = spark.createDataFrame(data, ["g", "v"])
    q = profile.exact_quantiles(profile.value_table(df, ["v"], ["g"]), ["g"], {"q10": 0.1, "q25": 0.25, "q50": 0.5, "q99": 0.99})
    for r in q.collect():
        values = [v for g, v in data if g == r.g]
        want = np.quantile(values, [0.1, 0.25, 0.5, 0.99])
        assert np.allclose([r.q10, r.q25, r.q50, r.q99], want)


def test_quantiles_of_close_values_are_spread_over_tasks(spark):
    """A million distinct values between 1 and 2."""
    import numpy as np
    from pairflow.operators import ranges
    df = spark.range(1_000_000).select(F.lit("g").alias("g"), (1 + F.col("id") * 7919 % 1_000_000 / 1e6).alias("v"))
    values = profile.value_table(df, ["v"], ["g"])
    sizes = [r["count"] for r in ranges.ranged(values, "g", "feature", "value").groupBy("_range").count().collect()]
    assert len(sizes) >= 4 and max(sizes) < 3 * sum(sizes) / len(sizes)
    r = profile.exact_quantiles(values, ["g"], {"q25": 0.25, "q50": 0.5, "q999": 0.999}).first()
    assert np.allclose([r.q25, r.q50, r.q999], np.quantile(1 + np.arange(1_000_000) / 1e6, [0.25, 0.5, 0.999]), atol=1e-12)


def test_feature_summary_equals_pandas(spark, pairs):
    from pairflow.functions.features import with_features
    f = with_features(pairs)
    want = f.select(*domain.MODEL_FEATURES).toPandas()
    got = profile.feature_summary(f).toPandas().set_index("feature")
    d = want.describe().T
    for ours, theirs in {"mean": "mean", "std": "std", "q25": "25%", "q50": "50%", "q75": "75%", "max": "max"}.items():
        assert (got[ours] - d.loc[got.index, theirs]).abs().max() < 1e-9
    corr = profile.correlations(f).toPandas().pivot(index="feature_a", columns="feature_b", values="correlation")
    assert (corr - want.corr().loc[corr.index, corr.columns]).abs().max().max() < 1e-9


def test_sample_statistics_nested(spark):
    df = spark.createDataFrame([("g", "neutral", "a b", "c"), ("g", "entailment", "a", "c d e"), ("h", "neutral", "x", "y")],
                               "genre string, label string, premise string, hypothesis string")
    out = {r.genre: r for r in profile.sample_statistics(df).collect()}
    assert out["g"].labels == {"neutral": 1, "entailment": 1} and out["g"].total == 2
    assert out["h"].total_samples == 3 and out["h"].avg_premise_words == pytest.approx(4 / 3)


def test_pairs_use_every_sentence_and_document(spark):
    docs = spark.createDataFrame([(1, "src0", "A b. C d. E f."), (2, "src1", "Only one"), (3, "src2", " . "), (4, "src3", None)], "doc_id long, source string, text string")
    got = sorted((r.pairID, r.premise, r.hypothesis) for r in fixtures.document_pairs(docs).collect())
    assert got == [("1-0", "A b", "C d"), ("1-1", "C d", "E f"), ("2-0", "Only one", "")]


def test_correlations_ignore_nulls_pair_by_pair(spark):
    rows = [(1.0, 1.0, None), (2.0, 3.0, 1.0), (3.0, 2.0, 2.0), (4.0, 5.0, None), (5.0, 4.0, 5.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double").withColumn("k", F.lit(1.0))
    got = {(r.feature_a, r.feature_b): r.correlation for r in profile.correlations(df, ["a", "b", "c", "k"]).collect()}
    want = pd.DataFrame(rows, columns=list("abc")).corr()
    for x in "abc":
        for y in "abc":
            assert abs(got[x, y] - want.loc[x, y]) < 1e-12
    assert got["a", "k"] is None and got["k", "k"] is None


def test_csv_keeps_line_breaks_and_splits(spark):
    rows = [(f"p{i}", 'a\nb "c", \\n \r\\', "", "g", "neutral") for i in range(3000)] + [("q", "\\\\n", None, "g", "neutral")]
    names = ["pairID", "premise", "hypothesis", "genre", "label"]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in names)).select(*[f.name for f in readers.PAIR_SCHEMA.fields])
    path = scratch_path(spark, "csv-lines")
    writers.write_csv(df.coalesce(1), path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        back = readers.read_pairs_csv(spark, path)
        assert back.rdd.getNumPartitions() > 1
        assert back.exceptAll(df).count() == 0 and back.count() == df.count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_csv_keeps_every_string(spark):
    """Strings of separators, quotes, escapes and line ends, each in a line of its own."""
    from hypothesis import given, settings
    from hypothesis import strategies as st
    awkward = st.text(alphabet="\x00\n\r\\\"nr0N,#' \t\x01\x1c\x85\u2028ab\ufeff", max_size=12)
    drawn = []
    settings(max_examples=300, database=None, deadline=None)(given(awkward, st.one_of(st.none(), awkward))(lambda a, b: drawn.append((a, b))))()
    drawn += [("\\\n", "a\x00b"), ("\\n", "\\\\n"), ("\\N", '""'), ("", None), ("\x00", "\\0"), ("#x", " lead"), ("\\", "\\\\")]
    rows = [(i, a, b) for i, (a, b) in enumerate(drawn)]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    path = scratch_path(spark, "awkward-csv")
    writers.write_csv(df, path)
    back = writers.many_lines(spark.read.schema(df.schema).options(**readers.CSV_OPTIONS).csv(path))
    assert sorted(tuple(r) for r in back.collect()) == rows
    assert spark.read.text(path).count() >= len(rows)


def test_a_split_runs_its_input_once(spark, pairs):
    """One scan and one duplicate shuffle: the rows that reach the input's last step are counted."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    rows = cleaning.clean(pairs)
    n = rows.count()
    split = sampling.train_test_split(rows.mapInPandas(count, rows.schema))
    assert split.groupBy("split").count().count() == 2 and seen.value == n
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "MapInPandas" not in plan


def test_split_then_save_runs_its_input_once(spark, pairs):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    n = pairs.count()
    path = scratch_path(spark, "splits")
    writers.write_splits(sampling.with_full_split(sampling.prepare(pairs.mapInPandas(count, pairs.schema), per_genre=5000)), path)
    assert seen.value == n and spark.read.parquet(path).where("split = 'full'").count() > 0
