"""Benchmark the headline queries at ``$BENCH_SF_DIR`` (default sf0.1) on
``local[$BENCH_CPUS]``; prints one JSON line.

Each query is executed in full through the ``noop`` sink (nothing is
collected to the driver); seconds are wall-clock per query including the
small driver-side steps (range totals, quantile brackets, cell tables).
Each query runs ``$BENCH_REPEAT`` times (default 2); ``queries`` has the best
time, as single runs on a shared VM vary by up to 2×, and ``first`` the first
run's.
"""
from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "training_table",
    "consistency_report",
    "factor_frequency",
    "market_summary",
    "market_histogram",
    "cohort_stats",
    "risk_percentile",
    "normalized_gini",
    "auto_calibration",
    "post_stratify",
    "poisson_glm_one_factor",
    "diagnosis_report",
    "calibrated_premium",
    "rake_two_margins",
    "poisson_gbm",
]


def main() -> None:
    from riskloom.plans.catalog import QUERIES
    from riskloom.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "8")))
    # Warm the JVM (class loading, codegen caches) outside the timings.
    QUERIES["nominal_clean"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    times, first = {}, {}
    for name in names:
        runs = []
        for _ in range(repeat):
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(round(time.perf_counter() - t0, 3))
        times[name], first[name] = min(runs), runs[0]
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "first": first, "sf": float(m.group(1)) if m else None}))
    spark.stop()


if __name__ == "__main__":
    main()
