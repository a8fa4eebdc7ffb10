"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Each query is computed in full into a sink that drops the rows: once to warm up, and three times more, of
which the median counts.
"""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ripplemark.catalog.queries import QUERIES  # noqa: E402
from ripplemark.session import local_session  # noqa: E402

HEADLINE = (
    "last_tick_bins", "daily_rv", "tick_sanity", "expected_hours_missing",
    "bipower", "realized_kernel", "kernel_own_bandwidth", "variance_by_frequency",
    "forecast_table", "known_totals",
    "wf_mean", "wf_ewma", "wf_har", "wf_shar", "wf_ridge", "wf_models", "wf_custom_rule", "quarterly_slopes",
    "smeared", "ridge_calibration", "ridge_verdict",
    "results_table", "dm_lag_grid", "month_leaders", "head_to_head",
    "data_checks", "autocorrelation",
)


RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    chosen = sys.argv[1:] or HEADLINE
    spark = local_session(cores, shuffle_partitions=8, app="bench")
    # Start the JVM's and Python's workers before the clock runs.
    for name in ("pair_names", "wf_custom_rule"):
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in chosen:
        took = []
        for _ in range(1 + RUNS):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        seconds[name] = round(median(took[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
