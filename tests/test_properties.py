"""Cross-operator properties."""
import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dealflow import config as C
from dealflow import schema
from dealflow.operators import forecast, funnel, state
from dealflow.plans.context import Review
from tests.conftest import SF_SMALL


def test_funnel_totals_agree_across_dimensions(spark):
    r = Review.from_test_tables(spark, SF_SMALL)
    g = funnel.funnel_grouping_sets(r.enriched)
    sums = g.groupBy("dimension").agg(*[F.sum(m).alias(m) for m in C.FUNNEL_METRICS]).collect()
    by = {row.dimension: tuple(row[m] for m in C.FUNNEL_METRICS) for row in sums}
    assert by["market"] == by["gtm"] == by["product"] == by["total"]


def test_matrix_sums_to_total(spark):
    r = Review.from_test_tables(spark, SF_SMALL)
    m = funnel.product_market_matrix(r.enriched, "bookings_acv")
    total = m.select(sum(F.col(x) for x in C.MARKET_ORDER).alias("t")).agg(F.sum("t")).first()[0]
    assert total == funnel.company_totals(r.enriched).first()["bookings_acv"]


def test_last_friday_equals_funnel_capped(spark):
    r = Review.from_test_tables(spark, SF_SMALL)
    hist = {row.metric: row.value for row in r.hist.where(F.col("snapshot_date") == dt.date(1998, 8, 14)).collect()}
    capped = Review.from_test_tables(spark, SF_SMALL, r.cfg.__class__(today=dt.date(1998, 8, 14)))
    tot = funnel.company_totals(capped.enriched).first()
    for m in C.FUNNEL_METRICS:
        assert float(hist[f"tof_{m}"]) == float(tot[m]), m


def test_rag_counts_add_up(spark):
    r = Review.from_test_tables(spark, SF_SMALL)
    ps = forecast.rag_distribution(r.open_core).agg(F.sum("deals")).first()[0]
    assert ps == r.open_core.count()


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.sampled_from(["a", "b", "c"]), st.floats(-1e6, 1e6)),
                min_size=0, max_size=12))
def test_capture_is_idempotent(spark, data):
    base = dt.date(1998, 8, 7)
    rows = {(base + dt.timedelta(days=7 * d), m): v for d, m, v in data}
    new = spark.createDataFrame([(k[0], k[1], v) for k, v in rows.items()], schema.SNAPSHOTS)
    store = spark.createDataFrame([(base, "a", 1.0), (base, "z", 2.0)], schema.SNAPSHOTS)
    once = state.capture(store, new)
    twice = state.capture(once, new)
    key = lambda df: sorted((r.snapshot_date, r.metric, r.value) for r in df.collect())
    assert key(once) == key(twice)
    assert {(r.snapshot_date, r.metric) for r in once.collect()} >= {(base, "z")}
