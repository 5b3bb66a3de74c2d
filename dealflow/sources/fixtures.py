"""Deal-review inputs derived from the shared test tables (FIXTURES.md §3).

The test tables hold no CRM deals, so every input is a deterministic function of them:
one deal per order (``orders ⋈ customer``), owners from ``supplier``, call sentiment from
``events``. All derivations are narrow per-row projections after one equi-join, so they
scale with the tables; the only join is left to Catalyst/AQE (sort-merge at scale,
broadcast when the measured customer side is small).
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed anchor of the synthetic dates (the default as-of date of the review).
FIXTURE_ANCHOR = dt.date(1998, 8, 19)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(key: str, *values: str | None) -> str:
    """values[key] for key in 0..len-1, NULL for a None entry or any other key."""
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values) if v is not None) + " END"


def deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One CRM-like deal per order (FIXTURES.md §1 schema); k is the order key. The columns are SQL
    text, which the driver hands over in one call instead of one per operator."""
    o = _table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS k", "o_custkey", "o_orderstatus = 'F' AS f", "o_totalprice AS price", "to_date(o_orderdate) AS create_d",
        "o_orderpriority")
    c = _table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    anchor = f"DATE '{FIXTURE_ANCHOR}'"
    return o.join(c, o.o_custkey == c.c_custkey, "inner").selectExpr(
        "k AS deal_id",
        "IF(k % 1009 = 0, 'Test Deal A', concat('Deal ', string(k))) AS dealname",
        "IF(k % 41 = 0, 'renewals', 'default') AS pipeline_id",
        _pick("k % 59", "LegacyApp sync", "Bulk Data load", "Web form") + " AS source_detail",
        "CASE WHEN k % 53 < 6 THEN 'IMPORT' WHEN k % 53 < 9 THEN 'INTEGRATION' WHEN k % 53 < 45 THEN 'CRM_UI' END AS source_label",
        "IF(k % 67 = 0, NULL, string(o_custkey % 31)) AS owner_id",
        "CASE c_mktsegment WHEN 'MACHINERY' THEN 'Netsuite' WHEN 'BUILDING' THEN 'Sage Intacct' "
        "WHEN 'AUTOMOBILE' THEN 'Microsoft Dynamics 365' WHEN 'FURNITURE' THEN 'Acumatica' END AS erp_raw",
        _pick("try_cast(substring(o_orderpriority, 1, 1) AS int) - 1", "Channel Partner", "Inbound Web", "SDR Outbound", "Account Exec")
        + " AS gtm_raw",
        _pick("k % 9", "AR", "AP", "AR;AP", "Expense Management", "Corporate Cards, ar", "FX", "  ", "nan") + " AS use_case",
        "CASE WHEN k % 47 = 0 THEN 'n/a' WHEN k % 47 = 1 THEN NULL ELSE string(bigint(floor(price / 10))) END AS arr_raw",
        "IF(k % 71 = 0, NULL, string(CAST(price AS decimal(18,2)))) AS acv_raw",
        "string(bigint(floor(price / 10)) + k % 100) AS total_arr_raw",
        "create_d",
        "IF(k % 5 = 0, NULL, date_add(create_d, int(k % 20))) AS disco_d",
        "CASE WHEN k % 61 < 30 THEN 'Yes' WHEN k % 61 < 35 THEN ' YES ' WHEN k % 61 < 50 THEN 'No' END AS meeting_happened",
        "IF(k % 3 = 0, NULL, date_add(create_d, int(20 + k % 30))) AS sal_d",
        f"CASE WHEN f THEN date_add(create_d, int(45 + k % 45)) WHEN k % 73 = 0 THEN NULL "
        f"ELSE date_add({anchor}, int(k % 120 - 20)) END AS close_d",
        "IF(k % 79 = 0, NULL, f) AS is_closed",
        "IF(k % 83 = 0, NULL, f AND k % 2 = 0) AS is_won",
        _pick("k % 4", "s_sql", "s_sal", "s_prop", "s_neg") + " AS stage_id",
        _pick("k % 7", "COMMIT", "BEST_CASE", "PIPELINE", "OMIT", "", "CLOSED_WON") + " AS fcat",
        _pick("(k % 43) % 5", None, "0.2", "60", "1", "bad") + " AS prob_raw",
        "IF(k % 13 = 12, NULL, bigint((k % 13) % 4)) AS n_contacts",
        "CASE WHEN k % 11 < 8 THEN 'Send quote' WHEN k % 11 = 8 THEN 'No' WHEN k % 11 = 9 THEN '' END AS next_step",
        f"IF(k % 37 = 0, NULL, date_sub({anchor}, int(((k % 37) % 30) * ((k % 37) % 3)))) AS last_contact_d",
        _pick("(k % 31) % 4", "Partner A", "Partner B", "No") + " AS partner",
        "IF(k % 17 < 12, 'ROI', NULL) AS m_metrics",
        "IF(k % 19 < 13, 'Board', NULL) AS d_process",
        "IF(k % 23 < 16, 'Manual', NULL) AS i_pain",
        "IF(k % 29 < 15, 'Rival', NULL) AS c_compet",
        _pick("k % 3", "Yes", "identified") + " AS e_buyer",
        "string(NULL) AS champion",
        "IF(k % 89 = 0, NULL, string((k % 89) % 60)) AS days_to_close_raw",
        "string(NULL) AS rev_range",
        "string(NULL) AS win_reason")


def owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owner dimension rows (with duplicate ids once there are more than 23 suppliers)."""
    s = _table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    return s.select(
        (key % 23).cast("string").alias("owner_id"),
        F.when(key % 7 == 0, F.lit(None).cast("string")).otherwise(F.col("s_name")).alias("full_name"),
        F.when(key % 5 == 0, F.lit(None).cast("string")).when(key % 5 == 1, F.lit(""))
         .otherwise(F.concat(F.lit("Pod "), (F.col("s_nationkey") % 4).cast("string"))).alias("team"),
        key.alias("seq"),  # "last row wins" order for duplicate ids
    )


def sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-call sentiment rows, several per deal, keyed by the deal id as text."""
    e = _table(spark, sf_dir, "events").select("event_id", "value", "user_id")
    eid = F.col("event_id")
    return e.select(
        (eid - eid % 3).cast("string").alias("deal_id"),
        (F.col("value") / 100).alias("sentiment"),
        ((F.col("value") - 50) / 100).alias("trend"),
        (F.col("user_id") % 20).cast("bigint").alias("call_count"),
    )
