"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from vintagekit.plans import load_all
from vintagekit.session import get_session

HEADLINE = (
    "e01_first_print_backtest",
    "p02_as_of_many",
    "p04_first_print",
    "p07_release_coherent_change",
    "p12_as_of_join_orders",
    "f05_historical_features",
    "m05_expanding_baselines",
    "m06_ridge_bridge",
    "m07_kalman_nowcast",
    "m09_empirical_bands",
    "e06_benchmark_backtest",
    "l04_grade_matured",
    "a05_company_bands",
    "a09_sensitivity_top_k",
    "a11_midpoint_estimate",
    "a14_leave_one_out_share",
    "t01_loan_aggregate",
    "t05_duplicate_assets",
    "q01_freshness",
    "q06_scan_text",
    "c04_check_rows",
    "c11_batch_conflicts",
    "k01_batch_hash",
    "r15_extract_html_tables",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = get_session("bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    known = load_all()
    # The first job pays for JVM and Python start-up, which no query should.
    known["c05_check_unique"].run(spark, sf_dir).count()
    spark.range(8).mapInPandas(lambda batches: batches, "id long").count()
    times = {}
    for name in names:
        began = time.perf_counter()
        known[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
