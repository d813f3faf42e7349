"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is run to the end through the no-op sink. The first one is run once
before the clock starts, so that JVM start-up is not charged to it.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from dayspan.plans import registry  # noqa: E402
from dayspan.session import build_session  # noqa: E402

HEADLINE = (
    "combine_same_day", "outer_merge_union", "outer_merge_shared", "densify_days", "interpolate_weekly",
    "wide_features", "weekly_panel", "coverage_filter", "people_column_tradeoff", "cluster_median_profile",
    "box_stats", "zscore", "grubbs_outliers", "boxcox", "residualise", "simulate_missing", "imputation_error",
    "corr_matrix", "person_corr", "mean_corr_distance", "pca_by_cluster", "kruskal_wallis", "ks_two_sample",
    "welch_t", "pair_euclid", "pair_dtw", "silhouette", "group_split3", "group_kfold", "ols", "mixed_lm",
    "knn_classify", "classification_metrics", "dt_regressor", "per_person_logistic",
)


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench")
    spark.sparkContext.setLogLevel("OFF")
    every = registry.queries()
    run(registry.flagship(spark, sf))
    times = {}
    start = time.time()
    run(registry.flagship(spark, sf))
    times["flagship"] = round(time.time() - start, 3)
    for name in HEADLINE:
        start = time.time()
        run(every[name](spark, sf))
        times[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
