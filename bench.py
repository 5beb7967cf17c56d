"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8) and
BENCH_RUNS (default 3 timed runs after one warm-up; the median counts).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "b02_parse_date",
    "b04_dedup_first",
    "b05_impute_median",
    "b12_weighted_index",
    "c01_historical_slice",
    "c06_calendar",
    "c07_compare_wide",
    "c11_actual_vs_predicted",
    "d01_summary",
    "d04_station_coverage",
    "d08_rollup_monthly",
    "d15_parameter_contribution",
    "e01_rolling",
    "e01_rolling_raw_rows",
    "e02_lags",
    "e05_latest_per_station",
    "e09_sliding_windows",
    "e14_gap_fill_last",
    "f01_readings_page_by_date",
    "g02_combine_alerts",
    "h02_forecast_alerts",
    "i11_classification_metrics",
    "i13_regression_metrics",
    "i17_isolation_forest",
    "i19_forecaster",
    "j01_preprocess",
)


def main() -> None:
    from tests.oracle import session
    from workload import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = session(int(os.environ.get("BENCH_CPUS", "8")))
    chosen = [n for n in HEADLINE if not sys.argv[1:] or n in sys.argv[1:]]
    seconds = {}
    for name in chosen:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
        print(name, seconds[name], file=sys.stderr)
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
