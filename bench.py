"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and print one
JSON line {"metric", "value", "unit", "queries", "sf", ...}.

Each query is executed fully (``noop`` sink: every row is produced, nothing is collected
to the driver) once to warm up, then timed $BENCH_RUNS times; the per-query figure is the
median. ``value`` is the sum of the medians. Set BENCH_ALL=1 to time every deal-review query.

The state tables (goals, snapshots, actions) are derived from the deals inside every timed run;
with BENCH_STORED=1 they are written as Parquet before and only read in the runs, as in a
deployed review.
"""
from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from dealflow.plans.context import Review  # noqa: E402
from dealflow.plans.registry import operators, queries, run  # noqa: E402
from dealflow.session import local_session, materialize  # noqa: E402

# One or two per operator family: funnel, as-of snapshots, scoring, forecast, pods, wins,
# state merges and composite reports.
HEADLINE = [
    "dim_funnel_market", "funnel_grouping_sets", "tof_funnel", "matrix_bookings_acv",
    "historical_snapshots", "pace_cumulative_arr",
    "open_pipeline_full", "watchlist", "deal_sentiment",
    "forecast_rollup", "forecast_windows", "market_commit_vs_risk",
    "pod_detail", "pod_reviews",
    "wins_kpis", "wins_by_partner",
    "goals_for_quarter", "snapshot_sync", "trend_weekly",
    "exec_summary_tof", "pipeline_coverage", "market_scorecard", "strategic_priorities", "decisions",
]


def run_once(spark, fn, sf_dir) -> float:
    t0 = time.perf_counter()
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def over_stored_state(spark, sf_dir) -> dict:
    """The queries of a review whose state tables are written already."""
    base = Review.from_test_tables(spark, sf_dir)
    stored = Review(spark, base.deals, base.owners, base.sentiment, base.cfg, goals=materialize(base.goals),
                    snapshots=materialize(base.snapshot_store), actions=materialize(base.actions))
    return {name: lambda *_, name=name: run(name, stored) for name in operators()}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cores=cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", cpus)),
                          app="dealflow-bench")
    qs = over_stored_state(spark, sf_dir) if os.environ.get("BENCH_STORED") else queries()
    names = sorted(qs) if os.environ.get("BENCH_ALL") else HEADLINE
    if os.environ.get("BENCH_ONLY"):
        names = os.environ["BENCH_ONLY"].split(",")
    out = {}
    for name in names:
        fn = qs[name]
        run_once(spark, fn, sf_dir)  # warm-up: JIT, codegen cache, file listing
        out[name] = round(statistics.median(run_once(spark, fn, sf_dir) for _ in range(runs)), 4)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total_median",
        "value": round(sum(out.values()), 4),
        "unit": "sec",
        "queries": out,
        "sf": float(m.group(1)) if m else None,
        "cpus": int(cpus) if str(cpus).isdigit() else cpus,
        "runs": runs,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
