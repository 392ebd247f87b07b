"""Benchmark the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is built and materialised with the ``noop`` writer (the whole
plan runs, nothing is collected): one warm-up run, then the median of
``BENCH_RUNS`` timed runs.  ``value`` is the sum of the medians.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quarry.plans.registry import load_all  # noqa: E402
from quarry.session import local_session  # noqa: E402

# One or more queries per SURVEY section: joins, aggregates, windows,
# quality rules, composites, evaluation, splits, series.
HEADLINE = [
    "jn_inner_multi", "ag_group_year_month", "ag_box_stats", "ag_percentile_sorted",
    "win_topn_rows", "win_topn_of_topn", "win_ntile_deciles", "dq_null_profile",
    "dq_rule_violations", "dq_dedup_key", "pl_ticket_hour_profile", "pl_sector_investment",
    "pl_supply_demand_gap", "pl_default_profile", "ev_gain_lift", "ev_cutoff_sweep",
    "ft_stratified_split", "ts_kpss",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = local_session(cpus, shuffle_partitions=max(8, 2 * int(cpus)) if cpus.isdigit() else 16)
    reg = load_all()
    timings: dict[str, float] = {}
    for name in names:
        q = reg[name]
        samples = []
        for i in range(runs + 1):
            t0 = time.perf_counter()
            q.build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i > 0:  # first run warms caches and the Python workers
                samples.append(time.perf_counter() - t0)
        timings[name] = round(statistics.median(samples), 3)
        print(f"{name}: {timings[name]}s", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(timings.values()), 3),
                      "unit": "sec", "queries": timings, "sf": sf, "cpus": cpus, "runs": runs}))
    spark.stop()


if __name__ == "__main__":
    main()
