"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pairflow.catalog import QUERIES  # noqa: E402
from pairflow.session import local_session  # noqa: E402
from pairflow.sources import fixtures  # noqa: E402

HEADLINE = [
    "txt7_all_features", "rte2_rule_distribution", "flt3_keep_first", "flt4_cleaning_report",
    "smp1_stratified_sample", "smp5_train_test_split", "txt19_prompt_by_strategy", "inf1_score_table",
    "inf4_batch_summary", "met9_strategy_comparison", "met8_per_genre", "met13_mcnemar", "met14_crosstab_margins",
    "met24_feature_summary", "met25_correlations", "cst6_pareto", "cst8_token_roi", "jon2_replay",
    "jon4_common_accuracies", "str5_streaming_features", "ml3_coefficients", "ml4_out_of_fold", "snk2_write_csv",
    "adaptive_summary",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session("bench", memory="16g")
    start = time.time()
    n_pairs = fixtures.raw_pairs(spark, sf_dir).count()  # also warms up the session
    warmup = time.time() - start
    seconds: dict[str, float] = {}
    cold: dict[str, float] = {}
    for name in names:
        # First run compiles the plan, second run is the one reported.
        for times in (cold, seconds):
            start = time.time()
            run(QUERIES[name](spark, sf_dir))
            times[name] = round(time.time() - start, 3)
        print(name, cold[name], seconds[name], file=sys.stderr, flush=True)
    line = {
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")), "warmup_sec": round(warmup, 3), "pairs": n_pairs,
        "predictions": n_pairs * len(fixtures.THRESHOLDS),
        "cold_total": round(sum(cold.values()), 3), "cold": cold,
    }
    if "rte2_rule_distribution" in seconds:
        line["features_routing_pairs_per_sec"] = round(n_pairs / seconds["rte2_rule_distribution"])
    if "met8_per_genre" in seconds:
        line["evaluation_rows_per_sec"] = round(line["predictions"] / seconds["met8_per_genre"])
    print(json.dumps(line), flush=True)


if __name__ == "__main__":
    main()
