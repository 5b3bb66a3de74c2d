"""J1/J2 at scale: deals and calls in buckets of the deal key.

Both tables are written in the same number of buckets of the deal's id as text, each bucket sorted, so
that the calls are averaged per deal and joined to the deals where they lie: neither side is
shuffled again, however often the review runs. Absent deal ids share a bucket and join nothing.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealflow.config import ReviewConfig
from dealflow.operators.scoring import with_sentiment
from dealflow.sources import readers

KEY = "deal_key"


def save(df: DataFrame, table: str, path: str, buckets: int = 256) -> None:
    """Store deals or calls (with ``deal_id``) as a table of the catalog, its files under ``path``."""
    (df.withColumn(KEY, F.col("deal_id").cast("string")).repartition(buckets, KEY)
       .write.bucketBy(buckets, KEY).sortBy(KEY).option("path", path).saveAsTable(table))


def open_deals_with_sentiment(spark: SparkSession, deals: str, calls: str, cfg: ReviewConfig) -> DataFrame:
    """S2 + A10 + J2 over two such tables: the open deals (with ``deal_key``) and their call sentiment."""
    table = spark.table(deals)
    opened = readers.open_deals_scan(table, cfg, more=(KEY,))
    spoken = readers.deal_sentiment(spark.table(calls).drop("deal_id").withColumnRenamed(KEY, "deal_id"))
    return with_sentiment(opened, spoken, F.col(KEY))
