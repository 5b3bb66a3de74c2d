"""T6 at scale: a result written once in its order, with a directory of its files.

``write_ordered`` range-partitions and sorts the rows and writes one folder per range, each with the
rows' positions in it; the directory has the first position and the number of rows of every
range. ``page`` looks its positions up in the directory and reads the folders that hold them, so a
page costs one or two folders, however long the result is. Pages are numbered from 0 and joined
give the sorted whole. Ties in the order must be broken by its last columns; rows equal in all
of them come in any order.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ROWS, COLUMNS, DIRECTORY = "rows", "columns", "directory"


def write_ordered(df: DataFrame, path: str, order: list[Column], ranges: int | None = None) -> None:
    """Write ``df`` under ``path`` in the given order, in about ``ranges`` ranges (by default one per
    shuffle partition)."""
    spread = df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)
    place = F.monotonically_increasing_id()  # range number << 33 | position in it
    placed = spread.sortWithinPartitions(*order).withColumn("_place", place)
    placed.select("*", F.shiftright("_place", 33).alias("_range"), F.col("_place").bitwiseAND((1 << 33) - 1).alias("_at")) \
          .drop("_place").write.partitionBy("_range").parquet(f"{path}/{ROWS}")
    df.limit(0).write.parquet(f"{path}/{COLUMNS}")  # the columns, should there be no rows
    counted = _rows(df.sparkSession, path).groupBy("_range").agg(F.count(F.lit(1)).alias("n_rows"))
    # one row per range
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counted.select(F.col("_range").cast("long").alias("range"), "n_rows") \
           .withColumn("first_row", F.coalesce(F.sum("n_rows").over(before), F.lit(0))) \
           .coalesce(1).write.parquet(f"{path}/{DIRECTORY}")


def _rows(spark: SparkSession, path: str, ranges: list[int] | None = None) -> DataFrame:
    kind = spark.read.parquet(f"{path}/{COLUMNS}").schema.add("_at", "long").add("_range", "long")
    folders = [f"{path}/{ROWS}"] if ranges is None else [f"{path}/{ROWS}/_range={r}" for r in ranges]
    return spark.read.schema(kind).option("basePath", f"{path}/{ROWS}").parquet(*folders)


def directory(spark: SparkSession, path: str) -> DataFrame:
    """range, n_rows, first_row of every range."""
    return spark.read.schema("range long, n_rows long, first_row long").parquet(f"{path}/{DIRECTORY}")


def page(spark: SparkSession, path: str, number: int, size: int) -> DataFrame:
    """Rows ``number * size`` to ``(number + 1) * size - 1`` of the written order, in that order; a page
    beyond the end is empty."""
    first, behind = number * size, (number + 1) * size
    held = directory(spark, path).where((F.col("first_row") < behind) & (F.col("first_row") + F.col("n_rows") > first)) \
                                 .orderBy("range").collect()  # the ranges that a page touches
    if not held:
        return spark.read.parquet(f"{path}/{COLUMNS}")
    part = _rows(spark, path, [r.range for r in held])
    start = F.coalesce(*[F.when(F.col("_range") == r.range, F.lit(r.first_row)) for r in held])
    return part.withColumn("_row", start + F.col("_at")).where((F.col("_row") >= first) & (F.col("_row") < behind)) \
               .orderBy("_row").drop("_range", "_at", "_row")
