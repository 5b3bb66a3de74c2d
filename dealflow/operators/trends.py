"""J7/A11 weekly as-of snapshots, W1 cumulative pace, W2 weekly trend.

The as-of join "for every Friday F, all events dated in [qs, F]" is not run as an
inequality join (that plans a nested loop over every event). Each deal is unrolled into
its dated events, each event is bucketed to the first Friday on or after its date,
buckets are hash-aggregated (map-side partial, <= 14 Fridays x 7 metrics per task), and a
running sum over the tiny Friday spine turns bucket totals into as-of values.
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dealflow import config as C
from dealflow.config import ReviewConfig
from dealflow.functions.pacing import pacing
from dealflow.functions.weights import tally
from dealflow.operators.funnel import happened

MONEY = "decimal(18,2)"


def fridays(cfg: ReviewConfig) -> list[dt.date]:
    """Every Friday from the first one on/after quarter start through today."""
    first = pacing(cfg.today).first_friday.toordinal()
    return [dt.date.fromordinal(day) for day in range(first, cfg.today.toordinal() + 1, 7)]


def friday_on_or_after(d: Column) -> Column:
    return F.next_day(F.date_sub(d, 1), "Fri")


def funnel_events(enriched: DataFrame, *more: str) -> DataFrame:
    """(metric, d, value, more columns) per deal and dated funnel event (money already NULL -> 0)."""
    one = (F.col("n") if "n" in enriched.columns else F.lit(1)).cast(MONEY)
    won = F.coalesce(F.col("won"), F.lit(False))
    held_d = F.when(happened(F.col("meeting_happened")), F.col("disco_d"))
    book_d = F.when(won, F.col("close_d"))
    ev = [("tof_sql_booked", F.col("create_d"), one),
          ("tof_sql_held", held_d, one),
          ("tof_sal", F.col("sal_d"), one),
          ("tof_pipeline_arr", F.col("create_d"), F.col("arr")),
          ("tof_pipeline_acv", F.col("create_d"), F.col("acv")),
          ("tof_bookings_arr", book_d, F.col("arr")),
          ("tof_bookings_acv", book_d, F.col("acv"))]
    return enriched.select(*more, F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), d.alias("d"), v.cast(MONEY).alias("value")) for m, d, v in ev])))


def historical_snapshots(enriched: DataFrame, cfg: ReviewConfig) -> DataFrame:
    """Long (snapshot_date, metric, value) for every Friday of the quarter to date;
    each value is the QTD metric capped at that Friday (counts and money)."""
    return as_of(funnel_events(enriched), cfg, fridays(cfg))


def as_of(events: DataFrame, cfg: ReviewConfig, days: list[dt.date]) -> DataFrame:
    """The running value of every funnel metric on each Friday of ``days``, from events (metric, d, value)."""
    spark = events.sparkSession
    if not days:
        return spark.createDataFrame([], "snapshot_date date, metric string, value decimal(38,2)")
    buckets = (events
               .where(F.col("d").between(F.lit(pacing(cfg.today).quarter_start), F.lit(days[-1])))
               .groupBy(friday_on_or_after(F.col("d")).alias("snapshot_date"), "metric")
               .agg(F.sum("value").alias("v")))
    spine = spark.createDataFrame([(f, m) for f in days for m in _TOF_METRICS],
                                  "snapshot_date date, metric string")
    w = (Window.partitionBy("metric").orderBy("snapshot_date")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # buckets are bounded by construction (<= 14 Fridays x 7 metrics): the broadcast side
    j = spine.join(F.broadcast(buckets), ["snapshot_date", "metric"], "left")
    return j.select("snapshot_date", "metric",
                    F.sum(F.coalesce(F.col("v"), F.lit(0).cast(MONEY))).over(w).alias("value"))


_TOF_METRICS = tuple(f"tof_{m}" for m in C.FUNNEL_METRICS)


def day_spine(spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
    """One row per day in [start, end] (bounded by a quarter: <= 92 rows)."""
    return spark.range(1).select(
        F.explode(F.sequence(F.lit(start), F.lit(end), F.expr("INTERVAL 1 DAY"))).alias("day"))


def pace_cumulative(enriched: DataFrame, goal: Column, metric: str, cfg: ReviewConfig) -> DataFrame:
    """Cumulative daily actual through today beside a linear target for every day of the
    quarter: goal * i / (qe - qs).days, i = 0.. (reaches the goal on the last day); no target
    without a goal. ``metric`` is 'bookings_arr' (ARR by close date) or 'sql_booked' (count
    by create date). ``goal`` is a scalar (e.g. a scalar subquery over the goals table)."""
    p = pacing(cfg.today)
    if metric == "bookings_arr":
        daily = (enriched.where("is_book").groupBy(F.col("close_d").alias("day"))
                 .agg(F.sum("arr").alias("v")))
    else:
        daily = (enriched.where("is_sql").groupBy(F.col("create_d").alias("day"))
                 .agg(tally(enriched).cast(MONEY).alias("v")))
    spark = enriched.sparkSession
    days = day_spine(spark, p.quarter_start, p.quarter_end)
    total_days = (p.quarter_end - p.quarter_start).days or 1
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # daily totals are bounded by the days of the quarter (the flags restrict the dates)
    j = (days.join(F.broadcast(daily), "day", "left")
         .withColumn("cum", F.sum(F.coalesce(F.col("v"), F.lit(0).cast(MONEY))).over(w)))
    idx = F.datediff(F.col("day"), F.lit(p.quarter_start))
    return j.select(
        "day",
        F.when(F.col("day") <= F.lit(cfg.today), F.col("cum")).alias("actual_cum"),
        F.when(F.coalesce(goal, F.lit(0.0)) != 0, F.round(goal * idx / total_days, 6)).alias("target"))


def trend_weekly(history: DataFrame) -> DataFrame:
    """W2 + R4 + P7: one row per snapshot date with SQL-Booked, SQL-Held, SAL and Bookings
    ARR; dates lacking SQL-Booked are dropped; previous week's SQL-Booked beside each."""
    wanted = ["tof_sql_booked", "tof_sql_held", "tof_sal", "tof_bookings_arr"]
    wide = history.groupBy("snapshot_date").pivot("metric", wanted).agg(F.max("value"))
    wide = wide.select("snapshot_date", *[F.col(m).alias(m[4:]) for m in wanted]) \
               .where(F.col("sql_booked").isNotNull())
    w = Window.orderBy("snapshot_date")
    return wide.withColumn("prev_sql_booked", F.lag("sql_booked", 1).over(w))
