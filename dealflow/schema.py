"""Fixed schemas at the boundaries: state tables and optional sources."""
from __future__ import annotations

from pyspark.sql import types as T

OWNER_DIM = T.StructType([
    T.StructField("owner_id", T.StringType()),
    T.StructField("owner_name", T.StringType()),
    T.StructField("pod", T.StringType()),
])

DEAL_SENTIMENT = T.StructType([
    T.StructField("deal_id", T.StringType()),
    T.StructField("call_sentiment", T.DoubleType()),
    T.StructField("call_trend", T.DoubleType()),
    T.StructField("calls", T.LongType()),
])

GOALS = T.StructType([
    T.StructField("quarter", T.StringType(), False),
    T.StructField("market", T.StringType(), False),
    T.StructField("metric", T.StringType(), False),
    T.StructField("value", T.DoubleType()),
])

SNAPSHOTS = T.StructType([
    T.StructField("snapshot_date", T.DateType(), False),
    T.StructField("metric", T.StringType(), False),
    T.StructField("value", T.DoubleType()),
])

ACTIONS = T.StructType([
    T.StructField("quarter", T.StringType(), False),
    T.StructField("meeting", T.StringType(), False),
    T.StructField("pos", T.LongType(), False),
    T.StructField("text", T.StringType()),
    T.StructField("owner", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("added", T.DateType()),
])
