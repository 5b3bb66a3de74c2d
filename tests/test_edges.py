"""Edge rows of FIXTURES.md §5 on literal frames: pod ties and NULL ACV, the P6 condition,
as-of dates at quarter start / on a Friday / quarter starting on a Saturday, horizons around
30 June, prior snapshot values of 0."""
import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from dealflow import config as C
from dealflow.config import ReviewConfig
from dealflow.operators import forecast, pods, state, trends
from dealflow.operators.funnel import enrich_qtd
from dealflow.plans.context import Review
from dealflow.plans.registry import run
from tests.conftest import SF_SMALL

FLAGS = "f_stale boolean, f_single boolean, f_no_next boolean, f_no_eb boolean, f_late boolean"


def scored(spark, rows):
    """rows: (pod, deal_id, dealname, acv, rag, forecast_cat, confidence, first flag or None)."""
    out = []
    for pod, did, name, acv, rag, cat, conf, flag in rows:
        fl = [flag == t for _, t in (("", C.FLAG_STALE), ("", C.FLAG_SINGLE), ("", C.FLAG_NO_NEXT),
                                     ("", C.FLAG_NO_EB), ("", C.FLAG_LATE_WEAK))]
        out.append((pod, did, name, None if acv is None else Decimal(acv), rag, cat, conf, *fl))
    return spark.createDataFrame(out, "pod string, deal_id long, dealname string, acv decimal(18,2), rag string, "
                                      f"forecast_cat string, confidence int, {FLAGS}")


def test_pod_status_ties_and_biggest_deals(spark):
    df = scored(spark, [
        # red = green (1 each), no yellow: not Red (red > green fails), not Yellow (0 >= 1 fails) -> Green
        ("P1", 1, "a", 100, "Red", "Pipeline", 50, C.FLAG_NO_EB),
        ("P1", 2, "b", 100, "Green", "Pipeline", 90, None),
        # yellow = green -> Yellow; ACV tie between two winners -> lowest deal id
        ("P2", 5, "tie-hi-id", 70, "Green", "Pipeline", 90, None),
        ("P2", 4, "tie-lo-id", 70, "Yellow", "Commit", 80, C.FLAG_SINGLE),
        ("P2", 6, "y", 10, "Yellow", "Pipeline", 80, C.FLAG_SINGLE),
        ("P2", 7, "g", 20, "Green", "Pipeline", 95, None),
        # Only ACV is NULL; no winners -> largest among all is the NULL row; Red risk with NULL ACV
        ("P3", 9, "null-acv", None, "Red", "Pipeline", 5, C.FLAG_STALE),
    ])
    got = {r.pod: r for r in pods.pod_detail(df).collect()}
    assert got["P1"].status == "Green" and got["P1"].exec_support == C.SUPPORT_TEXT[C.FLAG_NO_EB]
    assert got["P1"].biggest_win == "b ($0K)" and got["P1"].biggest_risk == "a ($0K)"
    assert got["P2"].status == "Yellow" and got["P2"].biggest_risk == C.DASH
    assert got["P2"].biggest_win == "tie-lo-id ($0K)" and got["P2"].exec_support == C.SUPPORT_NONE
    assert got["P3"].biggest_win == "null-acv (—)" and got["P3"].biggest_risk == "null-acv (—)"
    assert got["P3"].status == "Red" and float(got["P3"].acv) == 0.0
    summary = {r.pod: r for r in pods.pod_summary(df).collect()}
    assert summary["P2"].avg_conf == 86.25 and summary["P3"].red == 1


def test_pod_reviews_keep_all_when_no_pod_is_big(spark):
    cfg = ReviewConfig()
    small = scored(spark, [("A", 1, "a", 5, "Green", "Pipeline", 90, None),
                           ("B", 2, "b", 9, "Green", "Pipeline", 90, None)])
    assert [r.pod for r in pods.pod_reviews(small, cfg).collect()] == ["B", "A"]
    big = small.unionByName(scored(spark, [("C", i, "c", 1, "Red", "Pipeline", 5, C.FLAG_STALE)
                                           for i in range(3, 6)]))
    assert [r.pod for r in pods.pod_reviews(big, cfg).collect()] == ["C"]


def _base(spark, rows):
    return spark.createDataFrame(
        [(i, "NetSuite", None, None, Decimal(10), Decimal(20), c, None, "Yes", None, None, None)
         for i, c in enumerate(rows)],
        "deal_id long, erp string, gtm_raw string, use_case string, arr decimal(18,2), acv decimal(18,2), "
        "create_d date, disco_d date, meeting_happened string, sal_d date, close_d date, won boolean")


def test_as_of_fridays_edges(spark):
    d = dt.date
    # as-of on quarter start (a Wednesday): no Friday yet -> no snapshot rows
    cfg = ReviewConfig(today=d(1998, 7, 1))
    assert trends.historical_snapshots(enrich_qtd(_base(spark, [d(1998, 7, 1)]), cfg), cfg).count() == 0
    # as-of on a Friday: that Friday is included and counts the same-day deal
    cfg = ReviewConfig(today=d(1998, 7, 3))
    rows = trends.historical_snapshots(enrich_qtd(_base(spark, [d(1998, 7, 1), d(1998, 7, 3)]), cfg), cfg) \
                 .where(F.col("metric") == "tof_sql_booked").collect()
    assert [(r.snapshot_date, float(r.value)) for r in rows] == [(d(1998, 7, 3), 2.0)]
    # quarter starting on a Saturday: first Friday is the 7th; a deal on the 1st lands there;
    # a deal after the last Friday <= today is not in any snapshot yet
    cfg = ReviewConfig(today=d(2000, 7, 19))
    base = _base(spark, [d(2000, 7, 1), d(2000, 7, 8), d(2000, 7, 15), d(2000, 7, 19), d(2000, 6, 30)])
    rows = trends.historical_snapshots(enrich_qtd(base, cfg), cfg).where(F.col("metric") == "tof_sql_booked").collect()
    assert sorted((r.snapshot_date, float(r.value)) for r in rows) == \
        [(d(2000, 7, 7), 1.0), (d(2000, 7, 14), 2.0)]


def test_horizons_are_independent_at_month_end(spark):
    # 30 June 1998 is a Tuesday: week end (Sun 5 July) falls after month end = quarter end
    cfg = ReviewConfig(today=dt.date(1998, 6, 30))
    df = spark.createDataFrame(
        [(i, c, Decimal(a), k, Decimal(w)) for i, c, a, k, w in [
            (1, dt.date(1998, 7, 4), 10, "Commit", 5), (2, dt.date(1998, 6, 1), 20, "Best Case", 10),
            (3, None, 40, "Commit", 0), (4, dt.date(1998, 9, 1), 80, "Pipeline", 0)]],
        "deal_id long, close_d date, acv decimal(18,2), forecast_cat string, weighted_acv decimal(18,2)")
    got = {r.horizon: r for r in forecast.forecast_windows(df, cfg).collect()}
    assert got["Week"].end_date == dt.date(1998, 7, 5) and got["Month"].end_date == dt.date(1998, 6, 30)
    assert (got["Week"].deals, float(got["Week"].total), float(got["Week"].commit)) == (2, 30.0, 10.0)
    assert (got["Month"].deals, got["Quarter"].deals) == (1, 1)   # overdue counted, NULL close never


def test_prior_snapshot_zero_gives_no_delta(spark):
    """A stored prior value of 0 (and a metric missing there) gives a NULL snapshot delta."""
    base = Review.from_test_tables(spark, SF_SMALL)
    fridays = [r.snapshot_date for r in base.hist.select("snapshot_date").distinct().collect()]
    zeros = spark.createDataFrame([(f, f"tof_{m}", 0.0) for f in fridays for m in C.FUNNEL_METRICS
                                   if m != "bookings_acv"], "snapshot_date date, metric string, value double")
    r = Review(spark, base.deals, base.owners, base.sentiment, base.cfg, snapshots=zeros)
    got = {x.metric: x.delta_pct for x in run("exec_summary_tof", r).collect()}
    assert all(got[m] is None for m in C.FUNNEL_METRICS if m != "sql_booked")
    assert state.latest_before(zeros, base.cfg.today).where("metric = 'tof_bookings_acv'").count() == 0
