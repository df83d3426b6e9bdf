"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS
(measured runs after one warm-up, default 2; the median counts), BENCH_QUERIES
(comma list). Every result is computed in full and thrown away.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from catalog import QUERIES
from tabloom.session import build_session

HEADLINE = (
    "profile_table profile_numeric profile_top_values recommend_task "
    "impute_mean impute_median impute_mode impute_ffill impute_ffill_global dedup_first dedup_flag sanitize_labels "
    "corr_filter_pearson corr_filter_spearman variance_filter variance_report guard_zscore_flag guard_iqr_filter "
    "scale_standard scale_robust enc_one_hot enc_label enc_target enc_woe split_random split_stratified "
    "lag_features rolling_features_blocks text_lemma text_tfidf_long text_bigram_count "
    "class_metrics_weighted roc_auc regression_metrics json_flatten stream_guard workflow_audit config_steps "
    "gbt_reg logreg iforest forecast_additive arima"
).split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = os.environ["BENCH_QUERIES"].split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken[1:] or taken), 3)
        print(f"{name:28} {times[name]:8.3f}", file=sys.stderr, flush=True)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline queries, warm median, total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
