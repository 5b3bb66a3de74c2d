"""The whole review from written cells: same rows as the single reports, two passes over the deals."""
import datetime as dt
from functools import reduce

import pytest
from pyspark.sql import functions as F

from dealflow.config import ReviewConfig
from dealflow.operators import cells
from dealflow.plans import whole
from dealflow.plans.context import Review
from dealflow.plans.registry import run
from dealflow.session import written
from tests.conftest import SF_SMALL

#: Reports beyond the two sheets that a whole review answers from its written tables.
MORE = ("funnel_grouping_sets", "funnel_long_market", "funnel_long_gtm", "historical_snapshots", "pace_cumulative_arr", "pace_cumulative_sql",
        "exec_summary_tof", "run_rate", "quarter_health", "market_scorecard", "market_attainment", "strategic_priorities", "pipeline_coverage",
        "exec_forecast", "forecast_movement", "booking_snapshot", "tof_snapshot", "trend_weekly", "decisions", "open_pipeline_full", "watchlist",
        "deal_scoring", "deal_recommendations", "pod_reviews", "pod_top_deals", "strategic_priorities_booking")


def rows(df):
    flat = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(map(flat, r)) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    """A review over stored deals and state."""
    folder = tmp_path_factory.mktemp("whole")
    derived = Review.from_test_tables(spark, SF_SMALL)
    derived.deals.write.parquet(f"{folder}/thedeals")
    derived.sentiment.write.parquet(f"{folder}/calls")
    derived.owners.write.parquet(f"{folder}/owners")
    return Review(spark, spark.read.parquet(f"{folder}/thedeals"), spark.read.parquet(f"{folder}/owners"), spark.read.parquet(f"{folder}/calls"),
                  derived.cfg, goals=written(derived.goals), snapshots=written(derived.snapshot_store), actions=written(derived.actions))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def deal_scans(df):
    df.collect()
    return sum("FileScan parquet" in line and "thedeals" in line for line in plan(df).split("== Initial Plan ==")[0].splitlines())


def test_every_report_is_the_same_and_reads_no_deals(base):
    w = whole.WholeReview(base)
    for name in (*whole.TOF_SHEET, *whole.BOOKING_SHEET, *MORE):
        got, want = run(name, w), run(name, base)
        assert got.columns == want.columns, name
        assert rows(got) == rows(want), name
        assert "thedeals" not in plan(got), name


def test_two_passes_over_the_deals(base):
    assert deal_scans(cells.tof_cells(base.clean, base.cfg)) == 1
    assert deal_scans(base.open_scored) == 1
    assert deal_scans(cells.open_cells(whole.WholeReview(base).open_scored, base.cfg)) == 0


@pytest.mark.parametrize("today", [dt.date(1998, 7, 1), dt.date(1998, 7, 3), dt.date(1998, 8, 2), dt.date(1998, 6, 30), dt.date(1997, 12, 31)])
def test_other_days(spark, base, today):
    """First day of a quarter (the WoW weeks lie before it), a Friday, a Sunday, last days."""
    r = Review(spark, base.deals, base.owners, base.sentiment, ReviewConfig(today=today), goals=base.state["goals"], snapshots=base.state["snapshots"])
    w = whole.WholeReview(r)
    for name in ("tof_funnel", "wow_by_market", "market_scorecard", "exec_summary_tof", "historical_snapshots", "forecast_windows", "wins_kpis",
                 "company_totals", "booking_snapshot", "decisions"):
        assert rows(run(name, w)) == rows(run(name, r)), name


def test_cells_of_parts_merge_to_those_of_the_whole(base):
    part = [F.pmod(F.xxhash64("deal_id"), F.lit(3)) == k for k in range(3)]
    tof = lambda deals: cells.tof_cells(deals, base.cfg)
    assert rows(cells.merge(*[tof(base.clean.where(p)) for p in part])) == rows(cells.merge(tof(base.clean)))
    opened = lambda df: cells.open_cells(df, base.cfg)
    assert rows(cells.merge(*[opened(base.open_scored.where(p)) for p in part])) == rows(opened(base.open_scored))


def test_cells_are_few(base):
    w = whole.WholeReview(base)
    assert w.open_cells.count() < w.open_scored.count()
    assert reduce(max, [r["count"] for r in w.tof_cells.groupBy(*cells.TOF_KEYS).count().collect()], 0) == 1


def test_no_deals(spark, base):
    none = Review(spark, base.deals.limit(0), None, None, base.cfg)
    w = whole.WholeReview(none)
    for name in (*whole.TOF_SHEET, *whole.BOOKING_SHEET):
        assert rows(run(name, w)) == rows(run(name, none)), name
