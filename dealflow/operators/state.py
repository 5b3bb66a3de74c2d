"""Goals, weekly snapshots and the actions log as keyed DataFrame
merges, plus sinks that rewrite only the touched groups of a stored table.

A merge is "existing rows whose key is not in the update" ∪ "the update": a left-anti
join on the key plus ``unionByName`` (no per-row Python). Inside one batch the row with the
highest ``seq`` of a key wins; without ``seq`` a key that comes twice is an error.
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dealflow import config as C
from dealflow import schema
from dealflow.functions.text import strip
from dealflow.operators.store import rewrite, stored

GOAL_KEY = ["quarter", "market", "metric"]
SNAPSHOT_KEY = ["snapshot_date", "metric"]
ACTION_KEY = ["quarter", "meeting"]


def last_wins(updates: DataFrame, key: list[str]) -> DataFrame:
    """One row per key: that with the highest ``seq``; a batch without ``seq`` must not repeat a key."""
    rest = [c for c in updates.columns if c not in (*key, "seq")]
    if "seq" in updates.columns:
        best = updates.groupBy(*key).agg(F.max_by(F.struct(*rest), "seq").alias("_r"))
        return best.select(*key, "_r.*")
    one = updates.groupBy(*key).agg(F.any_value(F.struct(*rest)).alias("_r"), F.count(F.lit(1)).alias("_n"))
    row = F.when(F.col("_n") > 1, F.raise_error("a key comes twice in one batch: give the rows a seq")) \
           .otherwise(F.col("_r"))
    return one.select(*key, row.alias("_r")).select(*key, "_r.*")


def upsert(existing: DataFrame, updates: DataFrame, key: list[str]) -> DataFrame:
    """Keyed union where the update wins (R5), and its last row inside a batch."""
    updates = last_wins(updates, key)
    return existing.join(updates.select(*key), key, "left_anti") \
                   .unionByName(updates.select(*existing.columns))


# ---- goals (S7, U1, U2, A29) ---------------------------------------------------------

def goals_for_quarter(goals: DataFrame, quarter: str) -> DataFrame:
    """All goals of one quarter."""
    return goals.where(F.col("quarter") == quarter)


def goal_for(goals: DataFrame, quarter: str, market: str, metric: str) -> Column:
    """One goal as a scalar (NULL when it is not set)."""
    return goals.where((F.col("quarter") == quarter) & (F.col("market") == market) & (F.col("metric") == metric)) \
                .agg(F.max("value").alias("g")).scalar()


def set_goals(goals: DataFrame, updates: DataFrame) -> DataFrame:
    """Set individual goals (upsert on quarter, market, metric)."""
    return upsert(goals, updates, GOAL_KEY)


def replace_quarter_goals(goals: DataFrame, quarter: str, new_goals: DataFrame) -> DataFrame:
    """Replace every goal of one quarter by ``new_goals``; a row of another quarter is an error."""
    same = F.when(F.col("quarter") == quarter, F.col("quarter")).otherwise(
        F.raise_error(F.concat(F.lit(f"a goal outside {quarter}: "), F.coalesce(F.col("quarter"), F.lit("none")))))
    new_goals = last_wins(new_goals.withColumn("quarter", same), GOAL_KEY)
    return goals.where(F.col("quarter") != quarter).unionByName(new_goals.select(*goals.columns))


def goal_totals(goals: DataFrame, quarter: str) -> DataFrame:
    """Per goal metric, the sum over the four markets; missing goals count 0."""
    spark = goals.sparkSession
    metrics = spark.createDataFrame([(m, i) for i, m in enumerate(C.GOAL_METRICS)], "metric string, ord int")
    q = goals.where((F.col("quarter") == quarter) & F.col("market").isin(*C.MARKET_ORDER)
                    & F.col("metric").isin(*C.GOAL_METRICS))
    per = q.groupBy("metric").agg(F.sum("value").alias("goal"))  # at most a row per goal metric
    return metrics.join(F.broadcast(per), "metric", "left") \
            .select("metric", "ord", F.coalesce(F.col("goal"), F.lit(0.0)).alias("goal_total"))


def goal_total(goals: DataFrame, quarter: str, metric: str) -> Column:
    """One metric's total goal as a scalar subquery (evaluated once, then a literal)."""
    q = goals.where((F.col("quarter") == quarter) & (F.col("metric") == metric)
                    & F.col("market").isin(*C.MARKET_ORDER))
    return q.agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("g")).scalar()


# ---- snapshots (S9, U3-U6, J8) -------------------------------------------------------

def snapshot_rows(metrics: DataFrame, *snapshot_dates: dt.date) -> DataFrame:
    """One-row metrics frame (one column per metric) -> long snapshot rows for each given
    date, from the single aggregate (no re-scan per date)."""
    cols = metrics.columns
    return metrics.select(F.inline(F.array(*[
        F.struct(F.lit(d).alias("snapshot_date"), F.lit(c).alias("metric"),
                 F.col(c).cast("double").alias("value")) for d in snapshot_dates for c in cols])))


def capture(store: DataFrame, rows: DataFrame) -> DataFrame:
    """Merge one date's metrics; other metrics of that date survive; idempotent."""
    return upsert(store, rows, SNAPSHOT_KEY)


def backfill(store: DataFrame, batch: DataFrame) -> DataFrame:
    """U4: merge many dates; the incoming value wins per (date, metric)."""
    return upsert(store, batch, SNAPSHOT_KEY)


def missing_dates(store: DataFrame, batch: DataFrame) -> DataFrame:
    """Dates of the batch not yet stored (none missing <=> 'has all dates')."""
    return batch.select("snapshot_date").distinct() \
                .join(store.select("snapshot_date").distinct(), "snapshot_date", "left_anti")


def sync(store: DataFrame, batch: DataFrame) -> DataFrame:
    """Backfill only when some batch date is missing; then the whole batch is written
    (dates already stored are rewritten too). The gate is a scalar subquery."""
    return backfill(store, batch.where(missing_dates(store, batch).exists()))


def latest_before(store: DataFrame, day: dt.date) -> DataFrame:
    """The rows of the newest snapshot strictly before ``day`` (a metric absent there
    stays absent, even if an older snapshot has it)."""
    before = store.where(F.col("snapshot_date") < F.lit(day))
    newest = before.agg(F.max("snapshot_date")).scalar()
    return before.where(F.col("snapshot_date") == newest)


def movement(store: DataFrame) -> DataFrame:
    """K6/F25 for every stored date at once: each metric beside its value on the newest date stored
    before (NULL if the metric is absent there, even if an older date has it), the difference and
    the difference in per cent (NULL for a prior of 0).

    The dates are put in order once and each carries the one before it; the window runs over
    one row per stored date, the values are joined by date and metric."""
    dates = store.select("snapshot_date").distinct() \
                 .withColumn("prior_date", F.lag("snapshot_date").over(Window.orderBy("snapshot_date")))
    prior = store.select(F.col("snapshot_date").alias("prior_date"), "metric", F.col("value").alias("prior"))
    delta = F.col("value") - F.col("prior")
    return store.join(dates, "snapshot_date").join(prior, ["prior_date", "metric"], "left").select(
        "snapshot_date", "metric", "value", "prior_date", "prior", F.round(delta, 2).alias("delta"),
        F.round(100 * delta / F.nullif(F.col("prior"), F.lit(0.0)), 6).alias("delta_pct"))


def history(store: DataFrame) -> DataFrame:
    """All snapshot rows ordered by date."""
    return store.orderBy("snapshot_date", "metric")


# ---- actions (S8, U7-U9) -------------------------------------------------------------

def actions_list(actions: DataFrame, quarter: str, meeting: str, today: dt.date) -> DataFrame:
    """The items of one (quarter, meeting), in list order; an empty list reads as one blank
    Open item (U9)."""
    rows = actions.where((F.col("quarter") == quarter) & (F.col("meeting") == meeting))
    blank = {"quarter": F.lit(quarter), "meeting": F.lit(meeting), "pos": F.lit(1).cast("bigint"), "text": F.lit(""),
             "owner": F.lit(""), "status": F.lit("Open"), "added": F.lit(today)}
    seed = actions.sparkSession.range(1).select(*[blank[c].alias(c) for c in actions.columns]).where(~rows.exists())
    return rows.unionByName(seed).orderBy("pos")


def actions_add(actions: DataFrame, quarter: str, meeting: str, items: DataFrame, added: dt.date) -> DataFrame:
    """Append items (seq, text, owner[, status]) to the list of (quarter, meeting) after its
    current last position, in the order of ``seq`` (1, 2, ...); status defaults to Open; stamped with
    ``added`` (a parameter, not the wall clock). The last position is a scalar subquery."""
    if "seq" not in items.columns:
        raise ValueError("items need a seq (1, 2, ...) that gives their order")
    if "status" not in items.columns:
        items = items.withColumn("status", F.lit("Open"))
    last = actions.where((F.col("quarter") == quarter) & (F.col("meeting") == meeting)) \
                  .agg(F.coalesce(F.max("pos"), F.lit(0)).alias("p")).scalar()
    new = items.withColumns({"pos": (last + F.col("seq")).cast("bigint"), "quarter": F.lit(quarter),
                             "meeting": F.lit(meeting), "added": F.lit(added)})
    return actions.unionByName(new.select(*actions.columns))


def _blank_text() -> Column:
    return strip(F.coalesce(F.col("text"), F.lit(""))) == ""


def _known_status() -> Column:
    return F.col("status").isNull() | F.col("status").isin(*C.ACTION_STATUSES)


def save_rule(items: DataFrame) -> DataFrame:
    """Rows with blank text are not saved; a missing status is Open. Rows with an unknown
    status are not saved either: ``rejected_items`` returns them."""
    return items.where(~_blank_text() & _known_status()).withColumn("status", F.coalesce("status", F.lit("Open")))


def rejected_items(items: DataFrame) -> DataFrame:
    """Rows that ``save_rule`` refuses although they have text: their status is none of the four."""
    return items.where(~_blank_text() & ~_known_status())


def actions_replace(actions: DataFrame, quarter: str, meeting: str, items: DataFrame) -> DataFrame:
    """U8 + U9: replace the list of (quarter, meeting) by the saved items."""
    keep = actions.where(~((F.col("quarter") == quarter) & (F.col("meeting") == meeting)))
    new = save_rule(items).withColumn("quarter", F.lit(quarter)).withColumn("meeting", F.lit(meeting))
    return keep.unionByName(new.select(*actions.columns))


# ---- sinks (stored tables; only the touched groups are rewritten, see ``store``) ----------

def groups_of(df: DataFrame, column: str) -> list:
    """The groups that a batch touches (quarters or dates of one write)."""
    return [r[0] for r in df.select(column).distinct().collect()]


def save_goals(spark: SparkSession, path: str, updates: DataFrame) -> None:
    """U1 on a stored table: only the quarters of ``updates`` are rewritten."""
    rewrite(spark, path, schema.GOALS, "quarter", groups_of(updates, "quarter"), lambda goals: set_goals(goals, updates))


def save_quarter_goals(spark: SparkSession, path: str, quarter: str, new_goals: DataFrame) -> None:
    """U2 on a stored table: only this quarter is rewritten; without new goals it has none."""
    rewrite(spark, path, schema.GOALS, "quarter", [quarter], lambda goals: replace_quarter_goals(goals, quarter, new_goals))


def save_snapshots(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """U3/U4 on a stored table: only the dates of ``rows`` are rewritten."""
    rewrite(spark, path, schema.SNAPSHOTS, "snapshot_date", groups_of(rows, "snapshot_date"), lambda store: backfill(store, rows))


def sync_snapshots(spark: SparkSession, path: str, batch: DataFrame) -> None:
    """U6 on a stored table: nothing is written when no date of ``batch`` is missing."""
    save_snapshots(spark, path, batch.where(missing_dates(stored(spark, path, schema.SNAPSHOTS), batch).exists()))


def save_added_actions(spark: SparkSession, path: str, quarter: str, meeting: str, items: DataFrame, added: dt.date) -> None:
    """U7 on a stored table: the items follow whatever the list holds when the write begins."""
    rewrite(spark, path, schema.ACTIONS, "quarter", [quarter], lambda actions: actions_add(actions, quarter, meeting, items, added))


def save_replaced_actions(spark: SparkSession, path: str, quarter: str, meeting: str, items: DataFrame) -> None:
    """U8 on a stored table: the list holds the saved items alone, none if there are none."""
    rewrite(spark, path, schema.ACTIONS, "quarter", [quarter], lambda actions: actions_replace(actions, quarter, meeting, items))


def save_actions(spark: SparkSession, path: str, quarter: str, merged: DataFrame) -> None:
    """U7/U8 with a result of ``actions_add`` or ``actions_replace`` made before: this quarter's rows
    of ``merged`` replace the stored ones. Read and merge happen outside the lock; two writers of one
    quarter use ``save_added_actions`` and ``save_replaced_actions`` instead."""
    rewrite(spark, path, schema.ACTIONS, "quarter", [quarter], lambda _: merged.where(F.col("quarter") == quarter))
