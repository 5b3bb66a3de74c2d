"""Kept event sums: after any change they are what a recount gives; only the feed is read."""
import datetime as dt
import os

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dealflow.config import ReviewConfig
from dealflow.operators import history, state, store
from dealflow.operators.funnel import enrich_qtd
from dealflow.operators.trends import historical_snapshots
from dealflow.plans.context import Review
from dealflow.sources.readers import qtd_base
from tests.conftest import SF_SMALL

CFG = ReviewConfig()


def rows(df):
    return sorted(map(tuple, df.collect()))


def recount(deals, cfg=CFG):
    return rows(historical_snapshots(enrich_qtd(qtd_base(deals, cfg), cfg), cfg))


def test_sums_give_the_weekly_values(spark):
    deals = Review.from_test_tables(spark, SF_SMALL).deals
    sums = history.event_sums(deals, CFG)
    for today in (CFG.today, dt.date(1998, 7, 3), dt.date(1998, 7, 2), dt.date(1996, 5, 15)):
        cfg = ReviewConfig(today=today)
        assert rows(history.as_of_fridays(sums, cfg)) == recount(deals, cfg)


def test_changes_touch_only_their_quarters_and_read_only_the_feed(spark, tmp_path):
    r = Review.from_test_tables(spark, SF_SMALL)
    deals = r.deals
    path = str(tmp_path / "events")
    history.save_events(spark, path, history.event_sums(deals, CFG))
    folders = {n: sorted(os.listdir(f"{path}/{n}")) for n in os.listdir(path) if n.startswith("quarter=")}
    one = deals.where("create_d between '1998-07-10' and '1998-07-20' and close_d >= '1998-07-01' and disco_d is null and sal_d is null "
                      "and pipeline_id = 'default'").limit(1)
    image = [x.asDict() for x in one.collect()]
    feed = spark.createDataFrame([image[0] | {"change": "update_before"}, image[0] | {"arr_raw": "1000000", "change": "update_after"}],
                                 deals.withColumn("change", F.lit("x")).schema)
    assert list(history.apply_changes(spark, path, feed, CFG)) == ["1998Q3"]
    after = {n: sorted(os.listdir(f"{path}/{n}")) for n in folders}
    assert [n for n in folders if folders[n] != after[n]] == ["quarter=1998Q3"]
    changed = deals.withColumn("arr_raw", F.when(F.col("deal_id") == image[0]["deal_id"], "1000000").otherwise(F.col("arr_raw")))
    kept = store.stored(spark, path, history.SUMS).where(F.col("quarter") == "1998Q3")
    assert rows(history.as_of_fridays(kept, CFG)) == recount(changed)
    # a feed that takes everything back leaves nothing
    history.apply_changes(spark, path, changed.withColumn("change", F.lit("delete")), CFG)
    assert store.stored(spark, path, history.SUMS).count() == 0


DEAL = st.fixed_dictionaries({
    "deal_id": st.integers(0, 5), "pipeline_id": st.sampled_from(["default", "renewals", None]), "is_won": st.sampled_from([True, False, None]),
    "create_d": st.sampled_from([None, dt.date(1998, 7, 1), dt.date(1998, 7, 10), dt.date(1998, 6, 30)]),
    "disco_d": st.sampled_from([None, dt.date(1998, 7, 11)]), "meeting_happened": st.sampled_from([" YES", "no", None]),
    "sal_d": st.sampled_from([None, dt.date(1998, 8, 14)]), "close_d": st.sampled_from([None, dt.date(1998, 8, 15), dt.date(1998, 7, 3)]),
    "arr_raw": st.sampled_from(["1.25", "x", None, "-3", "1e30"]), "acv_raw": st.sampled_from(["10", None])})
SCHEMA = ("deal_id long, pipeline_id string, is_won boolean, create_d date, disco_d date, meeting_happened string, sal_d date, close_d date, "
          "arr_raw string, acv_raw string")


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(DEAL, max_size=5), st.lists(DEAL, max_size=5))
def test_any_change_equals_a_recount(spark, old, new):
    fill = {"dealname": "d", "source_detail": None, "source_label": None, "erp_raw": None, "gtm_raw": None, "use_case": None}
    frame = lambda deals: spark.createDataFrame(deals, SCHEMA).withColumns({k: F.lit(v).cast("string") for k, v in fill.items()})
    before, after = frame(old), frame(new)
    feed = before.withColumn("change", F.lit("delete")).unionByName(after.withColumn("change", F.lit("insert")))
    sums = history.merged(history.event_sums(before, CFG), history.changed_sums(feed, CFG))
    assert rows(sums) == rows(history.event_sums(after, CFG))
    assert rows(history.as_of_fridays(sums, CFG)) == recount(after)


def test_movement_follows_the_dates(spark):
    d = [dt.date(1998, 8, n) for n in (7, 14, 19)]
    kept = spark.createDataFrame([(d[0], "a", 10.0), (d[1], "a", 15.0), (d[1], "b", 0.0), (d[2], "a", 12.0), (d[2], "b", 4.0), (d[2], "c", 1.0)],
                                 "snapshot_date date, metric string, value double")
    got = {(r.snapshot_date, r.metric): (r.prior_date, r.prior, r.delta, r.delta_pct) for r in state.movement(kept).collect()}
    assert got == {(d[0], "a"): (None, None, None, None), (d[1], "a"): (d[0], 10.0, 5.0, 50.0), (d[1], "b"): (d[0], None, None, None),
                   (d[2], "a"): (d[1], 15.0, -3.0, -20.0), (d[2], "b"): (d[1], 0.0, 4.0, None), (d[2], "c"): (d[1], None, None, None)}
    for day in (*d, dt.date(1998, 9, 1)):
        before = {r.metric: r.value for r in state.latest_before(kept, day).collect()}
        for (date, metric), (_, prior, _, _) in got.items():
            assert date != day or prior == before.get(metric)
