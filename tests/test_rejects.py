"""Unusual numbers: NULL in the reports, listed once, counted by the scans."""
import datetime as dt

from pyspark.sql import Observation
from pyspark.sql import functions as F

from dealflow.config import ReviewConfig
from dealflow.plans.context import Review
from dealflow.plans.registry import run
from dealflow.sources import readers
from tests.conftest import SF_SMALL

CFG = ReviewConfig()
BAD = {1: "Infinity", 2: "1e20", 3: "NaN", 4: "n/a", 5: "-1e16", 6: "  "}


def dirty(spark):
    """The deals of the test tables, some amounts replaced."""
    clean = Review.from_test_tables(spark, SF_SMALL)
    n = F.pmod("deal_id", F.lit(97))
    swap = lambda c: F.coalesce(*[F.when(n == k, F.lit(v)) for k, v in BAD.items()], F.col(c))
    deals = clean.deals.withColumns({"arr_raw": swap("arr_raw"), "acv_raw": swap("acv_raw"), "total_arr_raw": swap("total_arr_raw"),
                                     "prob_raw": F.when(n == 1, F.lit("inf")).when(n == 2, F.lit("1e14")).otherwise(F.col("prob_raw")),
                                     "days_to_close_raw": F.when(n == 1, F.lit("Infinity")).otherwise(F.col("days_to_close_raw"))})
    nulled = clean.deals.withColumns({c: F.when(n.between(1, 6), F.lit(None)).otherwise(F.col(c)) for c in ("arr_raw", "acv_raw", "total_arr_raw")}
                                     | {"prob_raw": F.when(n.between(1, 2), F.lit(None)).otherwise(F.col("prob_raw")),
                                        "days_to_close_raw": F.when(n == 1, F.lit(None)).otherwise(F.col("days_to_close_raw"))})
    return deals, nulled, clean


def review(spark, deals, like, **more):
    return Review(spark, deals, like.owners, like.sentiment, CFG, state_by_rule=True, **more)


def test_reports_read_them_as_null(spark):
    deals, nulled, like = dirty(spark)
    got, want = review(spark, deals, like), review(spark, nulled, like)
    for name in ("tof_funnel", "dim_funnel_market", "wins_kpis", "forecast_rollup", "forecast_windows", "pod_summary", "goals_for_quarter",
                 "historical_snapshots", "pipeline_coverage", "exec_summary_tof"):
        rows = [sorted(map(tuple, run(name, r).collect()), key=repr) for r in (got, want)]
        assert rows[0] == rows[1], name


def test_each_value_is_listed_once(spark):
    deals, _, like = dirty(spark)
    base = [(r.deal_id, r.column, r.raw) for r in readers.rejects(like.deals).collect()]
    assert {(c, raw) for _, c, raw in base} == {("arr_raw", "n/a"), ("prob_raw", "bad")}
    got = readers.rejects(deals).collect()
    assert len({(r.deal_id, r.column) for r in got}) == len(got)
    for r in got:
        k = r.deal_id % 97
        if r.column in ("arr_raw", "acv_raw", "total_arr_raw") and k in BAD:
            assert (r.raw, r.reason) == (BAD[k], "no_number" if k in (3, 4) else "does_not_fit") and k != 6
    listed = {(r.deal_id, r.column) for r in got}
    for r in deals.where(F.pmod("deal_id", F.lit(97)).between(1, 5)).select("deal_id").collect():
        assert {(r.deal_id, c) for c in ("arr_raw", "acv_raw", "total_arr_raw")} <= listed


def test_the_scans_count_them_in_the_same_pass(spark):
    deals, _, like = dirty(spark)
    seen = {k: Observation() for k in ("qtd", "open", "won")}
    r = review(spark, deals, like, observations=seen)
    run("company_totals", r).collect()
    run("forecast_rollup", r).collect()
    run("wins_kpis", r).collect()
    rows = {"qtd": readers.qtd_base(deals, CFG), "open": readers.open_deals_scan(deals, CFG), "won": readers.closed_won_scan(deals, CFG)}
    columns = {"qtd": readers.QTD_NUMBERS, "open": readers.OPEN_NUMBERS, "won": readers.WON_NUMBERS}
    for name, frame in rows.items():
        ids = frame.select("deal_id")
        want = readers.rejects(deals.join(ids, "deal_id", "left_semi"), columns[name]).groupBy("column").count().collect()
        assert seen[name].get == dict.fromkeys(columns[name], 0) | {r["column"]: r["count"] for r in want}
        assert name == "won" or sum(seen[name].get.values()) > 0  # few deals are won in the quarter


def test_no_deals_and_all_kinds_of_null(spark):
    like = Review.from_test_tables(spark, SF_SMALL)
    assert readers.rejects(like.deals.limit(0)).count() == 0
    empty = like.deals.limit(3).withColumns({c: F.lit(v).cast("string") for c, v in zip(readers.NUMBERS, (None, "", " ", "\t", "0", "0"), strict=True)})
    assert readers.rejects(empty).count() == 0
    assert run("wins_kpis", Review(spark, empty, None, None, ReviewConfig(today=dt.date(1998, 8, 19)))).count() == 1
