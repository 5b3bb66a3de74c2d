"""J7/A11/U6 kept up to date: sums of the funnel events by day, changed by what changed.

``event_sums`` adds up, over all clean deals, each funnel metric by the day of its event. A change
feed has the images of changed deals, marked as from before or after the change; ``changed_sums``
turns it into differences (before images are taken back), ``merged`` adds those to the kept sums, and
``as_of_fridays`` reads the weekly as-of values off them. No deal that did not change is read
again. The sums are exact decimals, so any order of changes gives what a recount would give.

``save_events`` and ``apply_changes`` keep the sums as a stored table with a folder per quarter, of
which only the quarters that a feed touches are rewritten.
"""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealflow.config import ReviewConfig
from dealflow.functions.quarters import quarter_key
from dealflow.operators import store
from dealflow.operators.hygiene import hygiene
from dealflow.operators.state import groups_of
from dealflow.operators.trends import as_of, fridays, funnel_events
from dealflow.sources.readers import money_col

#: Images of a deal that a change feed takes back; all others (insert, update_after) are added.
TAKEN_BACK = ("delete", "update_before")
KEY = ["quarter", "day", "metric"]
SUMS = T.StructType([
    T.StructField("quarter", T.StringType(), False),
    T.StructField("day", T.DateType(), False),
    T.StructField("metric", T.StringType(), False),
    T.StructField("value", T.DecimalType(38, 2)),
    T.StructField("events", T.LongType()),
])


def _sums(deals: DataFrame, cfg: ReviewConfig, sign: Column) -> DataFrame:
    zero = F.lit(0).cast("decimal(18,2)")
    clean = deals.where(hygiene(cfg)).select(
        "create_d", "disco_d", "meeting_happened", "sal_d", "close_d", F.col("is_won").alias("won"),
        F.coalesce(money_col("arr_raw"), zero).alias("arr"), F.coalesce(money_col("acv_raw"), zero).alias("acv"),
        sign.alias("sign"))
    return funnel_events(clean, "sign").where(F.col("d").isNotNull()) \
        .groupBy(quarter_key(F.col("d")).alias("quarter"), F.to_date("d").alias("day"), "metric") \
        .agg(F.sum(F.col("value") * F.col("sign")).cast("decimal(38,2)").alias("value"), F.sum("sign").alias("events"))


def event_sums(deals: DataFrame, cfg: ReviewConfig) -> DataFrame:
    """quarter, day, metric, value (counts and money), events: over all clean deals."""
    return _sums(deals, cfg, F.lit(1))


def changed_sums(feed: DataFrame, cfg: ReviewConfig) -> DataFrame:
    """The differences that a change feed makes: deal images with ``change``, one of 'insert',
    'update_before', 'update_after' and 'delete'."""
    return _sums(feed, cfg, F.when(F.col("change").isin(*TAKEN_BACK), -1).otherwise(1))


def merged(*sums: DataFrame) -> DataFrame:
    """Sums and differences added up; days on which no event is left disappear."""
    both = sums[0]
    for other in sums[1:]:
        both = both.unionByName(other)
    return both.groupBy(*KEY).agg(F.sum("value").cast("decimal(38,2)").alias("value"), F.sum("events").alias("events")) \
               .where(F.col("events") != 0)


def as_of_fridays(sums: DataFrame, cfg: ReviewConfig) -> DataFrame:
    """The values of ``trends.historical_snapshots``, from the kept sums of the quarter."""
    return as_of(sums.select("metric", F.col("day").alias("d"), "value"), cfg, fridays(cfg))


# ---- stored ------------------------------------------------------------------------------

def save_events(spark: SparkSession, path: str, sums: DataFrame) -> None:
    """Store the sums of a first count."""
    store.rewrite(spark, path, SUMS, "quarter", groups_of(sums, "quarter"), lambda _: sums)


def apply_changes(spark: SparkSession, path: str, feed: DataFrame, cfg: ReviewConfig) -> Iterable[str]:
    """Add a feed's differences to the stored sums; returns the quarters that were rewritten."""
    changes = changed_sums(feed, cfg)
    touched = groups_of(changes, "quarter")
    store.rewrite(spark, path, SUMS, "quarter", touched, lambda kept: merged(kept, changes))
    return touched
