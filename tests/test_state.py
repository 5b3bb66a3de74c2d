"""State merges (goals, snapshots, actions) and the writer of single groups."""
import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from dealflow import schema
from dealflow.operators import state
from dealflow.operators.store import rewrite

D1, D2, D3 = dt.date(1998, 8, 7), dt.date(1998, 8, 14), dt.date(1998, 8, 19)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def snaps(spark, data):
    return spark.createDataFrame(data, schema.SNAPSHOTS)


def test_capture_keeps_other_metrics_and_is_idempotent(spark):
    store = snaps(spark, [(D2, "a", 1.0), (D2, "b", 2.0)])
    new = snaps(spark, [(D2, "b", 5.0), (D2, "c", 3.0)])
    once = state.capture(store, new)
    assert rows(once, "snapshot_date", "metric", "value") == [(D2, "a", 1.0), (D2, "b", 5.0), (D2, "c", 3.0)]
    assert rows(state.capture(once, new), "snapshot_date", "metric", "value") == \
        rows(once, "snapshot_date", "metric", "value")


def test_sync_gate_all_or_nothing(spark):
    batch = snaps(spark, [(D1, "a", 10.0), (D2, "a", 20.0)])
    # every batch date present -> the store is unchanged, even where values differ
    full = snaps(spark, [(D1, "a", 1.0), (D2, "b", 2.0)])
    assert rows(state.missing_dates(full, batch), "snapshot_date") == []
    assert rows(state.sync(full, batch), "snapshot_date", "metric", "value") == [(D1, "a", 1.0), (D2, "b", 2.0)]
    # one date missing -> the whole batch is written, including the date already stored
    part = snaps(spark, [(D1, "a", 1.0), (D1, "z", 9.0)])
    assert rows(state.missing_dates(part, batch), "snapshot_date") == [(D2,)]
    assert rows(state.sync(part, batch), "snapshot_date", "metric", "value") == \
        [(D1, "a", 10.0), (D1, "z", 9.0), (D2, "a", 20.0)]
    # empty batch: vacuously all present
    assert rows(state.missing_dates(part, batch.limit(0)), "snapshot_date") == []


def test_latest_before_is_strict_and_metric_sparse(spark):
    store = snaps(spark, [(D1, "a", 1.0), (D1, "b", 2.0), (D2, "a", 3.0), (D3, "a", 4.0)])
    got = state.latest_before(store, D3)
    assert rows(got, "snapshot_date", "metric", "value") == [(D2, "a", 3.0)]
    # a metric missing on the newest prior date is absent, even though an older date has it
    assert got.where("metric = 'b'").count() == 0
    assert rows(state.latest_before(store, D1), "metric") == []


def test_goal_upsert_and_replace(spark):
    goals = spark.createDataFrame([("1998Q3", "Sage", "sal", 5.0), ("1998Q3", "Other", "sal", 0.0),
                                   ("1998Q2", "Sage", "sal", 7.0)], schema.GOALS)
    upd = spark.createDataFrame([("1998Q3", "Sage", "sal", 9.0), ("1998Q3", "Dynamics", "sql_held", 4.0)], schema.GOALS)
    assert rows(state.set_goals(goals, upd), "quarter", "market", "metric", "value") == [
        ("1998Q2", "Sage", "sal", 7.0), ("1998Q3", "Dynamics", "sql_held", 4.0),
        ("1998Q3", "Other", "sal", 0.0), ("1998Q3", "Sage", "sal", 9.0)]
    assert rows(state.replace_quarter_goals(goals, "1998Q3", upd.limit(1)), "quarter", "market", "value") == [
        ("1998Q2", "Sage", 7.0), ("1998Q3", "Sage", 9.0)]
    tot = {r.metric: r.goal_total for r in state.goal_totals(goals, "1998Q3").collect()}
    assert tot == {"sql_booked": 0.0, "sql_held": 0.0, "sal": 5.0, "pipeline_arr": 0.0, "bookings_arr": 0.0}


def test_actions_add_and_replace(spark):
    acts = spark.createDataFrame([("Q", "TOF", 3, "x", "o", "Open", D1), ("Q", "TOF", 7, "y", "o", "Done", D1),
                                  ("Q", "Booking", 1, "z", "o", "Open", D1)], schema.ACTIONS)
    items = spark.createDataFrame([(2, "newer", "me"), (1, "newest last by name", "me")], "seq int, text string, owner string")
    with pytest.raises(ValueError):
        state.actions_add(acts, "Q", "TOF", items.drop("seq"), D3)
    added = state.actions_add(acts, "Q", "TOF", items, D3)
    got = rows(added.where("text like 'new%'"), "quarter", "pos", "status", "added")
    assert got == [("Q", 8, "Open", D3), ("Q", 9, "Open", D3)]
    first = state.actions_add(acts, "P", "TOF", items.where("seq = 1"), D3)
    assert rows(first.where("quarter = 'P'"), "pos", "text") == [(1, "newest last by name")]
    assert [r.text for r in state.actions_list(added, "Q", "TOF", D3).collect()] == ["x", "y", "newest last by name", "newer"]
    assert rows(state.actions_list(added, "Q2", "TOF", D3), "pos", "text", "owner", "status", "added") == [(1, "", "", "Open", D3)]
    new = spark.createDataFrame([(1, "keep", "a", "Open", D3), (2, "  ", "b", "Open", D3),
                                 (3, "bad status", "c", "Later", D3), (4, "no status", "d", None, D3)],
                                "pos long, text string, owner string, status string, added date")
    rep = state.actions_replace(acts, "Q", "TOF", new)
    assert rows(rep, "meeting", "text", "status") == [("Booking", "z", "Open"), ("TOF", "keep", "Open"), ("TOF", "no status", "Open")]
    assert rows(state.rejected_items(new), "text") == [("bad status",)]


def test_last_row_of_a_batch_wins(spark):
    goals = spark.createDataFrame([("Q", "Sage", "sal", 1.0)], schema.GOALS)
    batch = [("Q", "Sage", "sal", 2.0, 1), ("Q", "Sage", "sal", 3.0, 3), ("Q", "Sage", "sal", 9.0, 2), ("Q", "Other", "sal", 5.0, 4)]
    df = spark.createDataFrame(batch, "quarter string, market string, metric string, value double, seq int")
    assert rows(state.set_goals(goals, df), "market", "value") == [("Other", 5.0), ("Sage", 3.0)]
    assert rows(state.replace_quarter_goals(goals, "Q", df), "market", "value") == [("Other", 5.0), ("Sage", 3.0)]
    with pytest.raises(PySparkException, match="comes twice"):
        state.set_goals(goals, df.drop("seq")).collect()
    with pytest.raises(PySparkException, match="outside P"):
        state.replace_quarter_goals(goals, "P", df).collect()
    got = spark.range(1).select(state.goal_for(goals, "Q", "Sage", "sal").alias("a"), state.goal_for(goals, "Q", "X", "sal").alias("b")).first()
    assert (got.a, got.b) == (1.0, None)


def test_sinks_rewrite_only_touched_partitions_and_are_idempotent(spark, tmp_path):
    path = str(tmp_path / "snapshots")
    for _ in range(2):
        state.save_snapshots(spark, path, snaps(spark, [(D1, "a", 1.0), (D2, "a", 2.0)]))
    kept = sorted((tmp_path / "snapshots" / f"snapshot_date={D1}").iterdir())
    for _ in range(2):
        state.save_snapshots(spark, path, snaps(spark, [(D2, "b", 5.0), (D3, "a", 7.0)]))
        assert rows(state.stored(spark, path, schema.SNAPSHOTS), "snapshot_date", "metric", "value") == [
            (D1, "a", 1.0), (D2, "a", 2.0), (D2, "b", 5.0), (D3, "a", 7.0)]
    assert sorted((tmp_path / "snapshots" / f"snapshot_date={D1}").iterdir()) == kept
    state.sync_snapshots(spark, path, snaps(spark, [(D1, "a", 99.0)]))  # no date is missing: nothing changes
    assert (D1, "a", 1.0) in rows(state.stored(spark, path, schema.SNAPSHOTS), "snapshot_date", "metric", "value")
    goals = str(tmp_path / "goals")
    for _ in range(2):
        state.save_goals(spark, goals, spark.createDataFrame([("Q1", "Sage", "sal", 1.0), ("Q2", "Sage", "sal", 2.0)], schema.GOALS))
        state.save_goals(spark, goals, spark.createDataFrame([("Q2", "Other", "sal", 3.0)], schema.GOALS))
        state.save_quarter_goals(spark, goals, "Q3", spark.createDataFrame([("Q3", "Other", "sal", 4.0)], schema.GOALS))
        assert rows(state.stored(spark, goals, schema.GOALS), "quarter", "market", "value") == [
            ("Q1", "Sage", 1.0), ("Q2", "Other", 3.0), ("Q2", "Sage", 2.0), ("Q3", "Other", 4.0)]
    acts = str(tmp_path / "actions")
    one = spark.createDataFrame([(1, "x", "o")], "seq int, text string, owner string")
    for n in (1, 2):
        merged = state.actions_add(state.stored(spark, acts, schema.ACTIONS), "Q1", "TOF", one, D3)
        state.save_actions(spark, acts, "Q1", merged)
        assert rows(state.stored(spark, acts, schema.ACTIONS), "pos", "text") == [(i + 1, "x") for i in range(n)]


def test_partition_overwrite_writer(spark, tmp_path):
    path = str(tmp_path / "snapshots")
    write = lambda df, *dates: rewrite(spark, path, schema.SNAPSHOTS, "snapshot_date", dates, lambda _: df)
    write(snaps(spark, [(D1, "a", 1.0), (D2, "a", 2.0)]), D1, D2)
    write(snaps(spark, [(D2, "a", 5.0)]), D2)
    back = spark.read.parquet(path).select(F.col("snapshot_date").cast("date"), "metric", "value")
    assert rows(back, "snapshot_date", "metric", "value") == [(D1, "a", 1.0), (D2, "a", 5.0)]
