"""S6 optional sources and the owner-dimension rules."""
from pyspark.sql import functions as F

from dealflow.plans.context import Review
from dealflow.sources import fixtures, readers
from tests.conftest import SF_SMALL


def test_absent_owner_and_sentiment_sources(spark):
    """A source configured as absent is an empty lookup of the fixed schema: every open deal is
    unassigned and has no call sentiment (calls 0), and nothing fails."""
    r = Review(spark, fixtures.deals(spark, SF_SMALL), None, None)
    rows = r.open_scored.select("owner_name", "pod", "call_sentiment", "calls").distinct().collect()
    assert [tuple(x) for x in rows] == [("Unassigned", "Unassigned", None, 0)]
    assert readers.owner_dim(None, spark).count() == 0


def test_owner_dimension_rules(spark):
    owners = spark.createDataFrame(
        [("1", None, None, 1), ("2", "  Ann  ", "", 2), ("3", "Bob", "Pod X", 3), ("3", "Cy", None, 9),
         ("4", "", "Pod Y", 4), ("5", "Dee", " ", 5)],
        "owner_id string, full_name string, team string, seq long")
    got = {r.owner_id: (r.owner_name, r.pod) for r in readers.owner_dim(owners).collect()}
    assert got == {"1": ("Unknown", "Unknown"), "2": ("Ann", "Ann"), "3": ("Cy", "Cy"),
                   "4": ("Unknown", "Pod Y"), "5": ("Dee", " ")}


def test_won_cohort_unassigned_and_direct(spark):
    r = Review.from_test_tables(spark, SF_SMALL)
    w = r.won
    assert w.where(F.col("owner_name").isNull()).count() == 0
    assert set(x[0] for x in w.select("partner_disp").distinct().collect()) <= {"Partner A", "Partner B", "Direct"}


def test_review_from_stored_tables(spark, tmp_path):
    """A review over stored tables runs the same operators; stored goals are used as given."""
    from dealflow import schema
    from dealflow.plans.registry import run
    deals_path = str(tmp_path / "deals")
    fixtures.deals(spark, SF_SMALL).write.parquet(deals_path)
    goals_path = str(tmp_path / "goals")
    spark.createDataFrame([("1998Q3", "Sage", "bookings_arr", 1000.0)], schema.GOALS).write.parquet(goals_path)
    r = Review.from_tables(spark, deals_path, goals=goals_path)
    base = Review.from_test_tables(spark, SF_SMALL)
    key = lambda df: sorted(tuple(x) for x in df.collect())
    assert key(run("dim_funnel_market", r)) == key(run("dim_funnel_market", base))
    assert {x.metric: x.goal_total for x in run("goal_totals", r).collect()}["bookings_arr"] == 1000.0
    assert run("open_pipeline_full", r).where(F.col("owner_name") != "Unassigned").count() == 0
