"""The deal scans (hygiene filter + projection + lenient casts at the edge), the
owner dimension and per-deal sentiment.

Lenient numbers use ``try_cast`` (Spark 4 runs ANSI mode, where ``cast`` would throw).
Money is carried as DECIMAL(18,2) so sums are exact and independent of row order; text that is
no number and an amount of 10^16 or more are NULL. ``rejects`` lists these values, and a scan that
is given an ``Observation`` counts those of its own rows in the same pass.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from dealflow import schema
from dealflow.config import ReviewConfig
from dealflow.functions import dims
from dealflow.functions.pacing import pacing
from dealflow.functions.rules import PROBABILITY, number, reject_reason
from dealflow.functions.text import strip
from dealflow.operators.hygiene import hygiene, is_open, touches_quarter, won_between

MONEY = "decimal(18,2)"
#: What the lenient columns are read as, and those that each scan reads.
NUMBERS = {"arr_raw": MONEY, "acv_raw": MONEY, "total_arr_raw": MONEY, "prob_raw": PROBABILITY, "n_contacts": "bigint",
           "days_to_close_raw": "double"}
QTD_NUMBERS = ("arr_raw", "acv_raw")
OPEN_NUMBERS = ("arr_raw", "acv_raw", "prob_raw", "n_contacts")
WON_NUMBERS = ("total_arr_raw", "acv_raw", "days_to_close_raw")


def money_col(name: str):
    return number(F.col(name), MONEY)


def rejects(deals: DataFrame, columns: tuple[str, ...] = tuple(NUMBERS)) -> DataFrame:
    """deal_id, column, raw, reason of every value of the lenient ``columns`` that is read as NULL
    although it holds something; one row a value, in one pass over the deals."""
    values = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("raw"),
                                reject_reason(F.col(c), NUMBERS[c]).alias("reason")) for c in columns])
    return deals.select("deal_id", F.inline(values)).where(F.col("reason").isNotNull())


def counting_rejects(deals: DataFrame, seen: Observation | None, columns: tuple[str, ...]) -> DataFrame:
    """``deals`` as they are; once they have been read, ``seen`` holds the number of rejected values
    of each of the ``columns``."""
    if seen is None:
        return deals
    return deals.observe(seen, *[F.count(reject_reason(F.col(c), NUMBERS[c])).alias(c) for c in columns])


def qtd_base(deals: DataFrame, cfg: ReviewConfig, with_wow_window: bool = False, seen: Observation | None = None) -> DataFrame:
    """S1 + P1 + P2: deals touching the quarter to date, with the funnel columns.

    ``with_wow_window`` also keeps deals created in the last two weeks (this week and the
    previous full week), so one scan feeds both the funnel and the WoW counts; the funnel
    flags are false on the extra rows, so funnel sums are unchanged."""
    p = pacing(cfg.today)
    keep = touches_quarter(p.quarter_start, cfg.today)
    if with_wow_window:
        keep = keep | F.col("create_d").between(F.lit(p.last_week_start), F.lit(cfg.today))
    return (counting_rejects(deals.where(hygiene(cfg) & keep), seen, QTD_NUMBERS)
            .select("deal_id",
                    dims.eco_label(F.col("erp_raw")).alias("erp"),
                    "gtm_raw", "use_case",
                    money_col("arr_raw").alias("arr"),
                    money_col("acv_raw").alias("acv"),
                    F.to_date("create_d").alias("create_d"),
                    F.to_date("disco_d").alias("disco_d"),
                    "meeting_happened",
                    F.to_date("sal_d").alias("sal_d"),
                    F.to_date("close_d").alias("close_d"),
                    F.col("is_won").alias("won")))


def clean_deals(deals: DataFrame, cfg: ReviewConfig) -> DataFrame:
    """P1 only: every clean deal, for the all-deals TOF funnel and the weekly counts."""
    return deals.where(hygiene(cfg))


def open_deals_scan(deals: DataFrame, cfg: ReviewConfig, seen: Observation | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """S2 + P1 + P3: the open pipeline columns, and ``more``."""
    return (counting_rejects(deals.where(hygiene(cfg) & is_open(cfg)), seen, OPEN_NUMBERS)
            .select("deal_id", "dealname", "owner_id", "gtm_raw", "use_case", "erp_raw",
                    money_col("arr_raw").alias("arr"),
                    money_col("acv_raw").alias("acv"),
                    "stage_id",
                    F.to_date("create_d").alias("create_d"),
                    F.to_date("close_d").alias("close_d"),
                    "fcat", "prob_raw",
                    number(F.col("n_contacts"), NUMBERS["n_contacts"]).alias("n_contacts"),
                    "next_step",
                    F.to_date("last_contact_d").alias("last_contact_d"),
                    "partner", "m_metrics", "e_buyer", "d_process", "i_pain", "c_compet", "champion", *more))


def closed_won_scan(deals: DataFrame, cfg: ReviewConfig, seen: Observation | None = None) -> DataFrame:
    """S3 + P1 + P4: the quarter's closed-won cohort; ARR is the *total* ARR field."""
    p = pacing(cfg.today)
    return (counting_rejects(deals.where(hygiene(cfg) & won_between(p.quarter_start, cfg.today)), seen, WON_NUMBERS)
            .select("deal_id", "dealname", "owner_id", "erp_raw", "use_case",
                    money_col("total_arr_raw").alias("arr"),
                    money_col("acv_raw").alias("acv"),
                    number(F.col("days_to_close_raw"), "double").alias("days_to_close"),
                    "partner", "rev_range", "win_reason",
                    F.to_date("close_d").alias("close_d")))


def owner_dim(owners: DataFrame | None, spark: SparkSession | None = None) -> DataFrame:
    """S4 + J1 prep: one row per owner id (last row by ``seq`` wins); name NULL/'' -> 'Unknown'
    (then stripped); pod = team unless NULL/'' -> name.  ``owners=None`` is an absent source (S6):
    an empty dimension of the fixed schema, so every deal reads as unassigned."""
    if owners is None:
        return spark.createDataFrame([], schema.OWNER_DIM)
    last = (owners.groupBy("owner_id")
            .agg(F.max_by(F.struct("full_name", "team"), F.col("seq")).alias("o")))
    full = F.col("o.full_name")
    name = strip(F.when(full.isNull() | (full == ""), F.lit("Unknown")).otherwise(full))
    team = F.col("o.team")
    return last.select(
        F.col("owner_id"),
        name.alias("owner_name"),
        F.when(team.isNull() | (team == ""), name).otherwise(team).alias("pod"))


def deal_sentiment(sentiment: DataFrame | None, spark: SparkSession | None = None) -> DataFrame:
    """S5 + A10: per deal, average sentiment and trend and the largest call count.
    Partial aggregation collapses a hot deal id map-side before the shuffle."""
    if sentiment is None:
        return spark.createDataFrame([], schema.DEAL_SENTIMENT)
    return (sentiment.groupBy(F.col("deal_id").cast("string").alias("deal_id"))
            .agg(F.avg("sentiment").alias("call_sentiment"),
                 F.avg("trend").alias("call_trend"),
                 F.max("call_count").alias("calls")))
