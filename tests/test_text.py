from pyspark.sql import functions as F

import pytest

from pairflow import domain
from pairflow.functions import prompts as P
from pairflow.functions import text as X
from pairflow.functions.features import feature_matrix, with_features


def rows(spark, data, cols):
    return spark.createDataFrame(data, cols)


def test_feature_goldens(spark):
    df = rows(spark, [
        (1, "The cat sat on the mat.", "An animal is sitting on something."),
        (2, "The company did not report any profits this quarter.", "The company was profitable."),
        (3, "", ""),
    ], ["id", "premise", "hypothesis"])
    out = {r.id: r for r in with_features(df).collect()}
    a, b, c = out[1], out[2], out[3]
    assert (a.premise_length, a.hypothesis_length, a.combined_length, a.length_ratio, a.char_length) == (6, 6, 12, 1.0, 57)
    assert (a.total_negations, a.shared_words) == (0, 1)
    assert (a.jaccard_similarity, a.lexical_overlap) == (0.1, 0.1)
    assert a.hypothesis_overlap == pytest.approx(1 / 6) and a.premise_coverage == pytest.approx(1 / 5)
    assert (b.premise_length, b.hypothesis_length, b.premise_negations, b.shared_words) == (9, 4, 1, 2)
    assert b.jaccard_similarity == pytest.approx(2 / 11)
    assert (c.premise_length, c.length_ratio, c.jaccard_similarity, c.shared_words) == (0, 0.0, 0.0, 0)


def test_features_replace_existing_columns(spark):
    df = rows(spark, [("a b", "b", 99)], ["premise", "hypothesis", "shared_words"])
    out = with_features(with_features(df))
    assert len(out.columns) == len(set(out.columns)) == 15
    assert out.first().shared_words == 1


def test_feature_matrix_names_missing_columns(spark):
    with pytest.raises(ValueError, match="shared_words"):
        feature_matrix(rows(spark, [(1,)], ["premise_length"]))


def test_negations_count_distinct_words(spark):
    df = rows(spark, [("Not not NEVER no neither nor nothing", "knot")], ["premise", "hypothesis"])
    r = with_features(df).first()
    assert (r.premise_negations, r.hypothesis_negations, r.total_negations) == (5, 0, 5)


def test_jaccard_bounds_and_symmetry(spark, pairs):
    swapped = with_features(pairs.select("pairID", F.col("premise").alias("hypothesis"), F.col("hypothesis").alias("premise")))
    joined = with_features(pairs).select("pairID", "jaccard_similarity").join(
        swapped.select("pairID", F.col("jaccard_similarity").alias("other")), "pairID")
    bad = joined.where((F.col("jaccard_similarity") != F.col("other")) | ~F.col("jaccard_similarity").between(0, 1))
    assert bad.count() == 0


@pytest.mark.parametrize("text,label,last", [
    ("not entailed", "entailment", "entailment"),
    (" NEUTRAL ", "neutral", "neutral"),
    ("", None, None),
    ("neutral, maybe entailment", "entailment", "entailment"),
    ("entailment? no: neutral", "entailment", "neutral"),
    ("these contradict", "contradiction", "contradiction"),
    ("cannot say", None, None),
])
def test_parse_label(spark, text, label, last):
    r = rows(spark, [(text,)], "t string").select(
        X.parse_label("t").alias("a"), X.parse_label("t", "last_mention").alias("b")).first()
    assert (r.a, r.b) == (label, last)


def test_full_tokens(spark):
    r = rows(spark, [("He didn't say \"No!\" (really), it's $5... Can't we? We cannot.",)], ["t"]).select(
        X.full_tokens("t").alias("w")).first()
    assert r.w == ["he", "did", "n't", "say", "``", "no", "!", "''", "(", "really", ")", ",", "it", "'s", "$", "5", "...",
                   "ca", "n't", "we", "?", "we", "can", "not", "."]


# text -> tokens, blank-separated, written by hand from the Treebank conventions.
GOLDENS = {
    "": "", "   ": "", "hello": "hello", "Good Muffins cost $3.88": "good muffins cost $ 3.88",
    "they'll save and invest more.": "they 'll save and invest more .", "hi, my name can't hello,": "hi , my name ca n't hello ,",
    "I don't know.": "i do n't know .", "it's fine": "it 's fine", "we've gone": "we 've gone", "you're right!": "you 're right !",
    "I'm here": "i 'm here", "he'd left": "he 'd left", "the dogs' bones": "the dogs ' bones", "John's book": "john 's book",
    "I cannot go": "i can not go", "gonna leave": "gon na leave", "wanna go": "wan na go", "gimme that": "gim me that",
    "lemme see": "lem me see", "you gotta run": "you got ta run", "'tis late": "'t is late", "'twas late": "'t was late",
    "d'ye know": "d 'ye know", "more'n enough": "more 'n enough", "no--never": "no -- never", "(yes)": "( yes )",
    "[1] {2} <3>": "[ 1 ] { 2 } < 3 >", "at 10:30 sharp": "at 10:30 sharp", "1,000 men": "1,000 men", "yes, no": "yes , no",
    "note: this": "note : this", "the end:": "the end :", "wait... what": "wait ... what", "what?!": "what ? !", "50% off": "50 % off",
    "me@home": "me @ home", "a;b": "a ; b", "#tag": "# tag", "r&d": "r & d", "a*b": "a * b", "well-known fact": "well-known fact",
    '"hello," she said.': "`` hello , '' she said .", 'she said "hello"': "she said `` hello ''", 'he ("x") left': "he ( `` x '' ) left",
    "“so” he said": "“ so ” he said", "«oui» dit-il": "« oui » dit-il", "first. second.": "first . second .",
    "Dr. Smith left. He ran.": "dr. smith left . he ran .", "J. Smith saw Mr. Jones.": "j. smith saw mr. jones .",
    "in the U.S. today": "in the u.s. today", "o'clock": "o'clock", "'90s music": "'90s music", "he is 5'x": "he is 5 ' x",
    "cannot, gonna": "can not , gon na", "scanned cannots": "scanned cannots", "e.g. this": "e.g. this", "a.b.c": "a.b.c",
    "wait.": "wait .", "(see below.)": "( see below . )", "mustn't've": "mustn't 've", "déjà-vu, ça va?": "déjà-vu , ça va ?",
}


def test_full_tokens_of_goldens(spark):
    assert len(GOLDENS) >= 50
    import duckdb

    from checks.oracle import _full_tokens
    got = {r.t: " ".join(r.w) for r in rows(spark, [(t,) for t in GOLDENS], ["t"]).select("t", X.full_tokens("t").alias("w")).collect()}
    assert {t: (got[t], w) for t, w in GOLDENS.items() if got[t] != w} == {}
    con = duckdb.connect()
    for t, w in GOLDENS.items():
        assert " ".join(con.execute(f"SELECT {_full_tokens('t')} FROM (SELECT ?::varchar t)", [t]).fetchone()[0]) == w, t


def test_stopwords_only_matter_in_full_mode(spark):
    df = rows(spark, [("the cat is here", "the dog is here")], ["premise", "hypothesis"])
    assert with_features(df).first().shared_words == 3
    assert with_features(df, mode="full").first().shared_words == 0
    assert with_features(df, mode="full", remove_stopwords=False).first().shared_words == 3


def test_small_scalars(spark):
    r = rows(spark, [("x" * 101, "  \t", " A\n", None)], "a string, b string, c string, d string").select(
        F.length(X.truncate("a", 100)).alias("n"), X.approx_tokens("a").alias("tok"),
        X.has_text("a").alias("has_a"), X.has_text("b").alias("has_b"), X.has_text("d").alias("has_d"),
        X.normalise_label("c").alias("norm"), X.decode_label(F.lit(7)).alias("unknown"),
        X.null_if_text_null(F.lit(" NaN ")).alias("gone"),
        X.label_from_scores(F.array(F.lit(0.1), F.lit(0.7), F.lit(0.7))).alias("best")).first()
    assert (r.n, r.tok, r.has_a, r.has_b, r.has_d) == (103, 26, True, False, False)
    assert (r.norm, r.unknown, r.gone, r.best) == ("a", "unknown", None, "entailment")


def test_strategy_names(spark):
    df = rows(spark, [("Zero_Shot",), ("chain-of-thought",), ("6_SHOT_COT",)], ["s"])
    assert [r.c for r in df.select(X.checked_strategy("s").alias("c")).collect()] == ["zero-shot", "cot", "6-shot-cot"]
    with pytest.raises(Exception, match="Unknown strategy: guess"):
        rows(spark, [("guess",)], ["s"]).select(X.checked_strategy("s")).collect()


def test_plausible_label(spark):
    df = rows(spark, [
        ("1", "dogs run fast today", "dogs run fast"), ("2", "dogs run fast", "dogs never run fast"),
        ("3", "dogs run", "cats sleep"),
    ], ["pairID", "premise", "hypothesis"])
    out = {r.pairID: r.l for r in df.select("pairID", X.plausible_label("premise", "hypothesis").alias("l")).collect()}
    assert out == {"1": "entailment", "2": "contradiction", "3": "neutral"}


def test_prompts(spark):
    df = rows(spark, [(s, "P {x}", "H") for s in domain.STRATEGIES], ["strategy", "premise", "hypothesis"])
    out = {r.strategy: r.prompt for r in P.with_prompt(df).collect()}
    assert all("Premise: P {x}\nHypothesis: H\n" in p for p in out.values())
    assert out["zero-shot"].startswith(domain.SYSTEM_INSTRUCTION) and out["zero-shot"].endswith("Classification:")
    assert out["few-shot"].count("Classification: ") == 5 and out["6-shot"].count("Classification: ") == 6
    assert out["6-shot-cot"].count("Classification: ") == 2 and out["cot"].endswith("step by step:")
    own = df.select(P.few_shot(F.col("premise"), F.col("hypothesis"), [("a", "b", "neutral")], count=0).alias("p")).first().p
    assert "Premise: a\nHypothesis: b\nClassification: neutral\n\nNow" in own
    with pytest.raises(Exception, match="Unknown strategy: 6-shot"):
        df.select(P.managed_prompt("strategy")).collect()
