"""Shared pieces: word expressions, document keys, written intermediate tables, global ranks."""
from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dealflow.session import ensure_checkpoint_dir

#: Buckets of text hashes that tell rows worth a join from the rest.
BUCKETS = 1 << 20
GAPS = " \t\n\x0b\x0c\r"
GAP = f"[{GAPS}]+"

def words(text: Column) -> Column:
    """Maximal runs of characters other than space, tab, newline, VT, FF, CR; null has none."""
    text = F.btrim(F.coalesce(text, F.lit("")), F.lit(GAPS))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, GAP))


def text_key(text: Column) -> Column:
    """64-bit hash of a text; with the id it addresses a document (null and '' differ)."""
    return F.xxhash64(text.isNull(), text)


def same_doc(left: DataFrame, right: DataFrame) -> Column:
    """Join condition on the document key; null ids equal each other."""
    return (left["_th"] == right["_th"]) & left["doc_id"].eqNullSafe(right["doc_id"])


def restrict(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """The rows of ``docs`` with (``left_semi``) or without (``left_anti``) their key in ``keys`` (written
    already), as they came, whatever their columns are called.

    Only rows that share a bucket with some key are joined: the texts of the others are not shuffled."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id",
                       text_key(F.col("text")).alias("_th"))
    near = in_buckets(rows, keys)
    kept = near.join(keys, same_doc(near, keys), how).select("_row")
    if how == "left_anti":
        kept = kept.union(in_buckets(rows, keys, "left_anti").select("_row"))
    return kept.select("_row.*")


def in_buckets(rows: DataFrame, keys: DataFrame, how: str = "left_semi") -> DataFrame:
    """``rows`` whose text hash falls into the bucket of some key (or, ``left_anti``, of none). However many
    keys there are, at most ``BUCKETS`` numbers are broadcast."""
    bucket = lambda df: F.pmod(df["_th"], F.lit(BUCKETS)).cast("int")
    held = F.broadcast(keys.select(bucket(keys).alias("_bucket")).distinct())
    return rows.join(held, bucket(rows) == held["_bucket"], how)


def of_pairs(table: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of ``table`` (node, ...) whose node falls into the bucket of a node of ``pairs`` (a, b; written
    already). However many pairs there are, at most ``BUCKETS`` numbers are broadcast."""
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")
    held = F.broadcast(pairs.select(F.explode(F.array(bucket("a"), bucket("b"))).alias("_bucket")).distinct())
    return table.join(held, bucket(table["node"]) == held["_bucket"], "left_semi")


# ---- written intermediate tables -------------------------------------------------------

def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared checkpoint folder and read it back.

    The files survive the loss of any executor, the reader knows their real size (so a join
    with a small table is broadcast and a large one is not), and a join over them is dealt
    anew, which lets Spark split a hot key."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def uncut(*tables: DataFrame) -> None:
    """Delete tables made by ``cut`` that no later step reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._cut_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def is_empty(df: DataFrame) -> bool:
    return df.limit(1).count() == 0


# ---- global ranks ----------------------------------------------------------------------

def ranked(df: DataFrame, *order: Column, name: str = "_rank") -> DataFrame:
    """``df`` with each row's 0-based position in the total order, without one task seeing
    all rows: range-partition, sort, number rows inside each partition, write the table,
    then add the number of rows in the partitions before (one row per partition)."""
    mid = F.monotonically_increasing_id()  # partition number << 33 | position in it
    table = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_mid", mid))
    parts = table.groupBy(F.shiftright("_mid", 33).alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = table.withColumn("_part", F.shiftright("_mid", 33))
    # one row per range partition of the sort above, so bounded by the shuffle partitions
    return (place.join(F.broadcast(starts), "_part")
            .withColumn(name, F.col("_start") + F.col("_mid").bitwiseAND((1 << 33) - 1))
            .drop("_part", "_mid", "_start"))


def ship(spark: SparkSession) -> None:
    """Make this package importable by the Python workers of every executor (once per context)."""
    context = spark.sparkContext
    if getattr(context, "_dealflow_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="dealflow-package-")  # the driver serves the file from here
    context.addPyFile(shutil.make_archive(f"{folder}/dealflow-package", "zip", package.parent, package.name))
    context._dealflow_shipped = True


def groups(sizes: Iterable[int], most: int) -> Iterator[slice]:
    """Consecutive runs whose sizes add up to ``most`` at most (or one larger size alone)."""
    first = total = stop = 0
    for k, size in enumerate(sizes):
        if k > first and total + size > most:
            yield slice(first, k)
            first, total = k, 0
        total, stop = total + size, k + 1
    if stop > first:
        yield slice(first, stop)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
