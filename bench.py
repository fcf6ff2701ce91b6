"""Benchmark the headline queries.

Runs each query at $BENCH_SF_DIR (default /root/testdata/sf0.1) on
local[$BENCH_CPUS] and prints ONE JSON line:
{"metric": "total_query_seconds", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Every query is executed to completion through the ``noop`` sink (the whole
plan runs, nothing is collected to the driver). The stage tables (master and
joined, written once per session like the reference's hand-off files) are
built first and timed as ``stage_tables``; the total includes them.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "master_wide", "station_fire_join", "same_year_matches", "impacted_one_month",
    "fire_paired_1yr", "fire_results_long", "scenario_summary", "paired_ttest",
    "model_frame", "median_impute", "hash_split", "class_change",
    "rf_regression", "rf_classifier", "gam_results",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from cinderwell import get_session
    from cinderwell.plans.catalog import QUERIES
    spark = get_session(f"local[{cpus}]", app="cinderwell-bench", shuffle_partitions=2 * cpus,
                        extra_conf={"spark.driver.memory": "16g"})
    names = [n for n in HEADLINE if n in QUERIES]
    if len(sys.argv) > 1:
        names = [n for n in sys.argv[1:] if n in QUERIES]
    # warm-up: JVM class loading and file listing are not query work
    QUERIES["analytes_found"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    timings = {}
    # stage A: readings -> master (dense ids) -> joined, written once per
    # session as the stage tables every later query reads; timed on its own
    from cinderwell.plans.stages import binding_joined
    t0 = time.perf_counter()
    binding_joined(spark, sf_dir)
    timings["stage_tables"] = round(time.perf_counter() - t0, 3)
    failed = {}
    for name in names:
        t0 = time.perf_counter()
        try:
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            timings[name] = round(time.perf_counter() - t0, 3)
        except Exception as e:  # a failing query is reported, the others still run
            failed[name] = f"{type(e).__name__}: {str(e)[:200]}"
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "total_query_seconds", "value": round(sum(timings.values()), 3),
           "unit": "sec", "queries": timings, "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus}
    if failed:
        out["failed"] = failed
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
