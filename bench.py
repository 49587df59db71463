"""Time the headline queries and print one JSON line.

Each query runs once to warm up and then BENCH_RUNS times; the median counts.
Results are written to Spark's ``noop`` sink, so every column is computed.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from buildlens.plans.catalogue import QUERIES
from buildlens.session import local_session

HEADLINE = [
    "failing_now", "build_features", "impute_all", "project_summary", "jobs_to_builds",
    "conflicting_duplicates", "num_distinct_authors", "comm_fail_rate_recent",
    "impute_interpolate", "impute_median", "label_encode", "minmax_scale", "label_correlation",
    "online_folds", "train_windows", "test_windows", "border_targets", "metric_entries",
    "metric_rollup", "pr_curve", "minority_knn", "smote_balance", "combine_importance",
    "combine_sources", "scan_project_dir", "online_validation",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", "").split(",")
    names = [n for n in names if n] or HEADLINE
    spark = local_session(cores)

    def once(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in names:
        once(name)
        seconds[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "spark": spark.version,
        "cores": cores,
        "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
