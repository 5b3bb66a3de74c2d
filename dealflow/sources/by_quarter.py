"""P2 at scale: the deals laid out by the quarters they touch.

The quarter base asks for deals of which any of four dates lies in the quarter to date, a condition
that no single partition column serves. ``write`` puts a deal once into the folder of every
quarter that one of its dates falls into (create, discovery, SAL, and close if won), at most four
times in all, with the columns of the funnel. ``qtd_base`` then reads the folder of one quarter
and applies the same conditions as on the deal table.

Deals none of whose dates is set are in no folder, as they are in no quarter base. Repeated rows
stay repeated.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealflow.config import ReviewConfig
from dealflow.functions.pacing import pacing
from dealflow.functions.quarters import quarter_key
from dealflow.sources import readers

#: What the hygiene filter and the funnel read of a deal.
COLUMNS = ("deal_id", "dealname", "pipeline_id", "source_detail", "source_label", "erp_raw", "gtm_raw", "use_case", "arr_raw", "acv_raw",
           "create_d", "disco_d", "meeting_happened", "sal_d", "close_d", "is_won")


def touched(deals: DataFrame) -> DataFrame:
    """The deals' funnel columns with ``quarter``, a row for each quarter a deal touches."""
    dates = [F.col("create_d"), F.col("disco_d"), F.col("sal_d"), F.when(F.col("is_won"), F.col("close_d"))]
    quarters = F.array_distinct(F.array_compact(F.array(*map(quarter_key, dates))))
    return deals.select(*COLUMNS, F.explode(quarters).alias("quarter"))


def write(deals: DataFrame, path: str) -> None:
    """Lay the deals out under ``path``, a folder per quarter. Rows of one quarter come together before they
    are written, spread over several files by their ids, so that no quarter is one task's."""
    spread = F.pmod(F.xxhash64("deal_id"), F.lit(16))
    touched(deals).repartition("quarter", spread).write.partitionBy("quarter").parquet(path)


def qtd_base(spark: SparkSession, path: str, cfg: ReviewConfig) -> DataFrame:
    """S1 + P1 + P2 from the folder of the quarter: the rows of ``readers.qtd_base`` over the deal table."""
    deals = spark.read.parquet(path).where(F.col("quarter") == pacing(cfg.today).quarter_key)
    return readers.qtd_base(deals, cfg)
