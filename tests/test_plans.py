"""Plan shape: no Python on the row path, no cartesian / nested-loop joins, top-k as
TakeOrderedAndProject, pruned and pushed scans."""
import pytest

from dealflow.plans.registry import queries
from tests.conftest import SF_SMALL

FORBIDDEN = ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin",
             "PythonUDF", "FlatMapGroupsInPandas", "MapInPandas")


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(queries()))
def test_no_python_no_cross_join(spark, name):
    txt = plan_text(queries()[name](spark, SF_SMALL))
    for bad in FORBIDDEN:
        assert bad not in txt, f"{name}: {bad} in plan"


@pytest.mark.parametrize("name", ["top_red", "wins_by_partner", "pod_reviews"])
def test_top_k_is_take_ordered(spark, name):
    assert "TakeOrderedAndProject" in plan_text(queries()[name](spark, SF_SMALL))


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def deal_scans(plan, path):
    return sum("FileScan parquet" in line and path in line for line in plan.splitlines())


@pytest.fixture(scope="module")
def stored_review(spark, tmp_path_factory):
    """A review over stored deals, goals and snapshots: (review, name of the deals folder)."""
    from dealflow.plans.context import Review
    from dealflow.sources import fixtures
    folder = tmp_path_factory.mktemp("stored")
    base = Review.from_test_tables(spark, SF_SMALL)
    fixtures.deals(spark, SF_SMALL).write.parquet(f"{folder}/thedeals")
    base.goals.write.parquet(f"{folder}/goals")
    base.snapshot_store.write.parquet(f"{folder}/snapshots")
    return Review.from_tables(spark, f"{folder}/thedeals", goals=f"{folder}/goals", snapshots=f"{folder}/snapshots"), "thedeals"


def test_reports_scan_the_deals_once(spark, stored_review):
    """Strategic priorities read the deals once; decisions read the quarter's deals and the open
    deals, and once more to reconstruct the Fridays of the snapshot sync."""
    from dealflow.plans.registry import run
    review, path = stored_review
    assert deal_scans(executed(run("strategic_priorities", review)), path) == 1
    assert deal_scans(executed(run("decisions", review)), path) <= 3


def test_pod_detail_aggregates_by_hash(spark, stored_review):
    from dealflow.plans.registry import run
    assert "SortAggregate" not in executed(run("pod_detail", stored_review[0]))


def test_absent_state_is_empty(spark, stored_review):
    """Without stored state nothing is invented: no plan, no prior week, an empty list."""
    from dealflow.plans.context import Review
    from dealflow.plans.registry import run
    r = Review(spark, stored_review[0].deals, None, None)
    assert {x.attainment_pct for x in run("market_attainment", r).collect()} == {None}
    moved = {x.label: x.last_week_text for x in run("forecast_movement", r).collect()}
    assert all(moved[k] == "— (accrues fwd)" for k in ("Commit", "Best Case", "Weighted", "Total open (Q)"))
    assert [(x.text, x.status) for x in run("actions_list", r).collect()] == [("", "Open")]
    assert run("watchlist", r).where("sentiment <> '—'").count() == 0


def test_row_orders(spark, stored_review):
    from dealflow import config as C
    from dealflow.plans.registry import run
    r = stored_review[0]
    rows = run("open_pipeline_full", r).collect()
    assert rows == sorted(rows, key=lambda x: (x.acv is None, -(x.acv or 0), x.deal_id))
    assert [x.forecast_cat for x in run("forecast_rollup", r).collect()] == list(C.FORECAST_ORDER)
    assert [x.market for x in run("funnel_market_spine", r).collect()] == list(C.MARKET_ORDER)
    assert [x.gtm for x in run("funnel_gtm_spine", r).collect()] == list(C.GTM_ENGINES)
    by_gtm = run("open_by_gtm", r).collect()
    assert by_gtm == sorted(by_gtm, key=lambda x: (-x.acv, x.gtm))
    watch = run("watchlist", r).collect()
    assert watch == sorted(watch, key=lambda x: (x.acv is None, -(x.acv or 0), x.deal_id))


def test_scan_is_pruned(spark):
    txt = plan_text(queries()["dim_funnel_market"](spark, SF_SMALL))
    orders_scan = [l for l in txt.splitlines() if "FileScan parquet" in l and "o_orderkey" in l][0]
    assert "o_clerk" not in orders_scan and "o_comment" not in orders_scan
    cust_scan = [l for l in txt.splitlines() if "FileScan parquet" in l and "c_custkey" in l][0]
    assert "c_name" not in cust_scan and "c_acctbal" not in cust_scan


def test_filters_reach_a_stored_deal_table(spark, tmp_path):
    """On a stored deal table the quarter-touch ranges and the open-pipeline predicates are
    pushed into the Parquet scan, and only the used columns are read."""
    from dealflow.plans.context import Review
    from dealflow.plans.registry import OPERATORS
    from dealflow.sources import fixtures
    path = str(tmp_path / "deals")
    fixtures.deals(spark, SF_SMALL).write.parquet(path)
    r = Review.from_tables(spark, path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        funnel_plan = plan_text(OPERATORS["dim_funnel_market"](r))
        open_plan = plan_text(OPERATORS["open_pipeline_full"](r))
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    scan = [l for l in funnel_plan.splitlines() if "FileScan parquet" in l][0]
    assert "create_d" in scan.split("PushedFilters")[1] and "Or(" in scan
    assert "dealname" in scan and "fcat" not in scan.split("ReadSchema")[1]
    scan = [l for l in open_plan.splitlines() if "FileScan parquet" in l][0]
    pushed = scan.split("PushedFilters")[1]
    assert "is_closed" in pushed and "In(stage_id" in pushed
