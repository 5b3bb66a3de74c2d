"""Bucketed deals and calls: the same sentiment per deal, without a shuffle."""
from pyspark.sql import functions as F

from dealflow.plans.context import Review
from dealflow.sources import bucketed
from tests.conftest import SF_SMALL


def rows(df):
    flat = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(map(flat, r)) for r in df.collect()), key=repr)


def test_aggregate_and_join_shuffle_nothing(spark, tmp_path):
    r = Review.from_test_tables(spark, SF_SMALL)
    hot = r.deals.agg(F.min("deal_id")).first()[0]  # a third of all calls are of one deal, some of none
    calls = r.sentiment.unionByName(r.sentiment.withColumn("deal_id", F.lit(str(hot)))).unionByName(
        r.sentiment.limit(50).withColumn("deal_id", F.lit(None).cast("string")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        bucketed.save(r.deals, "b_deals", str(tmp_path / "d"), 8)
        bucketed.save(calls, "b_calls", str(tmp_path / "c"), 8)
        got = bucketed.open_deals_with_sentiment(spark, "b_deals", "b_calls", r.cfg)
        columns = ("deal_id", "call_sentiment", "call_trend", "calls")
        want = Review(spark, r.deals, r.owners, calls, r.cfg).open_scored
        assert rows(got.select(*columns)) == rows(want.select(*columns))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert got.where("calls = 0").count() > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS b_deals")
        spark.sql("DROP TABLE IF EXISTS b_calls")
