"""State tables (goals, weekly snapshots, actions log) derived from the deal data.

The review keeps these as small keyed tables; for tests and queries they are built by
fixed rules from the deals so their contents (and the work to build them) follow the data:

* goals: 110% of the same quarter one year earlier, per market and goal metric, rounded to
  whole units; two edge rows by rule: Dynamics has no SQL-Held goal, Other's SAL goal is 0.
* snapshots: the booking snapshot stored on the last Friday before the as-of date and on the
  day before quarter start (a date with booking metrics only), then synced with the
  reconstructed Friday history.
* actions: one item per Red open deal (list = quarter of its create date, Booking meeting
  for late stages else TOF, position = deal id); a deal without a next step gives a blank item.
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealflow import config as C
from dealflow.config import ReviewConfig
from dealflow.functions import dims
from dealflow.functions.pacing import FRIDAY, pacing, weekday_from
from dealflow.functions.quarters import quarter_key
from dealflow.functions.rules import number
from dealflow.operators import state
from dealflow.operators.funnel import happened

MONEY = "decimal(18,2)"


def derived_goals(clean: DataFrame) -> DataFrame:
    one = F.lit(1).cast(MONEY)
    arr = number(F.col("arr_raw"), MONEY)
    won = F.coalesce(F.col("is_won"), F.lit(False))
    ev = [("sql_booked", F.col("create_d"), one),
          ("sql_held", F.when(happened(F.col("meeting_happened")), F.col("disco_d")), one),
          ("sal", F.col("sal_d"), one),
          ("pipeline_arr", F.col("create_d"), arr),
          ("bookings_arr", F.when(won, F.col("close_d")), arr)]
    long = clean.select(dims.market(F.col("erp_raw")).alias("market"), F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), d.alias("d"), v.cast(MONEY).alias("v")) for m, d, v in ev])))
    g = (long.where(F.col("d").isNotNull())
         .groupBy(quarter_key(F.add_months(F.col("d"), 12)).alias("quarter"), "market", "metric")
         .agg(F.coalesce(F.sum("v"), F.lit(0).cast(MONEY)).alias("actual")))
    value = F.when((F.col("market") == "Other") & (F.col("metric") == "sal"), F.lit(0.0)) \
             .otherwise(F.round(F.col("actual") * F.lit(1.1).cast("decimal(3,1)"), 0).cast("double"))
    return g.where(~((F.col("market") == "Dynamics") & (F.col("metric") == "sql_held"))) \
            .select("quarter", "market", "metric", value.alias("value"))


def booking_snapshot_metrics(scored: DataFrame, cfg: ReviewConfig) -> DataFrame:
    """K7: one row with the five booking metrics captured each run."""
    qe = pacing(cfg.today).quarter_end
    acv = F.col("acv")
    z = F.lit(0).cast(MONEY)
    return scored.agg(
        F.coalesce(F.sum(acv), z).alias("bk_open_acv"),
        F.coalesce(F.sum(F.when(F.col("forecast_cat") == "Commit", acv)), z).alias("bk_commit"),
        F.coalesce(F.sum(F.when(F.col("forecast_cat") == "Best Case", acv)), z).alias("bk_best"),
        F.round(F.coalesce(F.sum("weighted_acv"), z), 2).alias("bk_weighted"),
        F.coalesce(F.sum(F.when(F.col("close_d") <= F.lit(qe), acv)), z).alias("bk_q_total"))


def last_friday_before(day: dt.date) -> dt.date:
    return dt.date.fromordinal(weekday_from(day.toordinal() - 7, FRIDAY))


def snapshot_seed(scored: DataFrame, cfg: ReviewConfig) -> DataFrame:
    bk = booking_snapshot_metrics(scored, cfg)
    p = pacing(cfg.today)
    return state.snapshot_rows(bk, last_friday_before(cfg.today), p.quarter_start - dt.timedelta(days=1))


def derived_actions(scored: DataFrame) -> DataFrame:
    status = F.element_at(F.array(*[F.lit(s) for s in C.ACTION_STATUSES]),
                          (F.col("deal_id") % 4 + 1).cast("int"))
    return scored.where(F.col("rag") == "Red").select(
        quarter_key(F.col("create_d")).alias("quarter"),
        F.when(F.col("stage").isin(*C.LATE_STAGES), "Booking").otherwise("TOF").alias("meeting"),
        F.col("deal_id").cast("bigint").alias("pos"),
        F.when(F.col("next_step").isNull(), F.lit("  "))
         .otherwise(F.concat(F.col("action"), F.lit(": "), F.col("dealname"))).alias("text"),
        F.col("owner_name").alias("owner"),
        status.alias("status"),
        F.col("create_d").alias("added"))
