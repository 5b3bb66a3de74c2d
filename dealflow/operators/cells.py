"""Mergeable aggregates of a review: cells of deals with sums and counts.

``tof_cells`` condenses one pass over the clean deals to the funnel events by ERP label, market,
engine, product and day, ``open_cells`` the scored open deals by every category of the booking
views. The number of cells is bounded by the categories (and the days of a quarter, the partners,
the pods), not by the deals, and ``merge`` adds cells of separate parts of the deals up to those of
the whole. A cell has ``n``, the number of its deals; the review's aggregates run on cells as they
do on rows (functions/weights.py).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealflow.config import ReviewConfig
from dealflow.functions import dims, rules
from dealflow.functions.pacing import pacing
from dealflow.operators.funnel import happened, held_as_stored
from dealflow.operators.hygiene import in_range, touches_quarter
from dealflow.sources.readers import money_col

TOF_KEYS = ("erp", "market", "gtm", "product", "kind", "day", "partner_disp")
TOF_SUMS = ("n", "arr", "acv", "days_to_close", "n_days")
OPEN_KEYS = ("market", "gtm", "product", "forecast_cat", "is_forecasted", "rag", "pod", "close_d", "has_sentiment")
OPEN_SUMS = ("n", "arr", "acv", "weighted_acv", "confidence", "meddpicc")


def tof_cells(clean: DataFrame, cfg: ReviewConfig) -> DataFrame:
    """Cells of the events of all clean deals. Kinds: 'deal' (any deal, no day), 'touch' (deals of the
    quarter base, no day), 'sql' (created in the quarter to date or the two WoW weeks), 'held' and
    'held_as_stored' (the two meeting tests), 'sal', 'book' and 'win' (the latter with total ARR,
    partner and days to close)."""
    p, today = pacing(cfg.today), cfg.today
    zero = F.lit(0).cast("decimal(18,2)")
    money = lambda c: F.coalesce(money_col(c), zero)
    in_quarter = lambda c: in_range(F.col(c), p.quarter_start, today)
    rows = dims.with_buckets(clean.withColumn("erp", dims.eco_label(F.col("erp_raw"))), erp=None, eco="erp")
    days = F.nullif(rules.number(F.col("days_to_close_raw"), "double"), F.lit(0.0))
    won = F.coalesce(F.col("is_won"), F.lit(False)) & in_quarter("close_d")

    def event(holds: Column, kind: str, day: str | None = None, arr: Column = zero, acv: Column = zero, win: bool = False) -> Column:
        none = F.lit(None)
        return F.when(holds, F.struct(
            F.lit(kind).alias("kind"), (F.to_date(day) if day else none.cast("date")).alias("day"),
            (rules.partner_display(F.col("partner"), "Direct") if win else none.cast("string")).alias("partner_disp"),
            arr.alias("arr"), acv.alias("acv"), (days if win else none.cast("double")).alias("days_to_close")))

    arr, acv, total = (money(c) for c in ("arr_raw", "acv_raw", "total_arr_raw"))
    events = [event(F.lit(True), "deal"),
              event(touches_quarter(p.quarter_start, today), "touch"),
              event(in_range(F.col("create_d"), min(p.quarter_start, p.last_week_start), today), "sql", "create_d", arr, acv),
              event(in_quarter("disco_d") & happened(F.col("meeting_happened")), "held", "disco_d"),
              event(in_quarter("disco_d") & held_as_stored(F.col("meeting_happened")), "held_as_stored", "disco_d"),
              event(in_quarter("sal_d"), "sal", "sal_d"),
              event(won, "book", "close_d", arr, acv),
              event(won, "win", "close_d", total, acv, win=True)]
    long = rows.select("erp", "market", "gtm", "product", F.inline(F.array_compact(F.array(*events))))
    return long.groupBy(*TOF_KEYS).agg(
        F.count(F.lit(1)).alias("n"), F.sum("arr").alias("arr"), F.sum("acv").alias("acv"),
        F.sum("days_to_close").alias("days_to_close"), F.count("days_to_close").alias("n_days"))


def open_cells(scored: DataFrame, cfg: ReviewConfig) -> DataFrame:
    """Cells of the scored open deals (with call sentiment). ``close_d`` is the first end of week, month
    or quarter that the close date does not exceed, NULL if it exceeds all or is absent: the
    horizons ask no more of it."""
    p = pacing(cfg.today)
    end = None
    for day in sorted({p.week_end, p.month_end, p.quarter_end}):
        holds = F.col("close_d") <= F.lit(day)
        end = F.when(holds, F.lit(day)) if end is None else end.when(holds, F.lit(day))
    rows = scored.withColumns({"close_d": end, "has_sentiment": F.col("call_sentiment").isNotNull(), "n": F.lit(1).cast("bigint")})
    return rows.groupBy(*OPEN_KEYS).agg(*[F.sum(c).alias(c) for c in OPEN_SUMS])


def merge(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Cells of separate deals added up (all of one kind)."""
    keys, sums = (TOF_KEYS, TOF_SUMS) if "kind" in first.columns else (OPEN_KEYS, OPEN_SUMS)
    both = first
    for cells in others:
        both = both.unionByName(cells)
    return both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


# ---- what the funnel and wins aggregates read of the cells -----------------------------------

def enriched(cells: DataFrame, cfg: ReviewConfig, with_wow_window: bool = False) -> DataFrame:
    """The cells as enriched deals: at most one event flag and one date set in each."""
    quarter = F.col("day") >= F.lit(pacing(cfg.today).quarter_start)
    rows = cells.where(F.col("kind").isin("touch", "sql", "held", "sal", "book"))
    if not with_wow_window:
        rows = rows.where((F.col("kind") != "sql") | quarter)
    is_ = lambda kind: F.col("kind") == kind
    return rows.select(
        "market", "gtm", "product", "erp", "n", "arr", "acv",
        (is_("sql") & quarter).alias("is_sql"), is_("held").alias("is_held"), is_("sal").alias("is_sal"), is_("book").alias("is_book"),
        F.when(is_("sql"), F.col("day")).alias("create_d"), F.when(is_("held"), F.col("day")).alias("disco_d"),
        F.when(is_("sal"), F.col("day")).alias("sal_d"), F.when(is_("book"), F.col("day")).alias("close_d"),
        F.when(is_("held"), "yes").alias("meeting_happened"), is_("book").alias("won"))


def tof_rows(cells: DataFrame, cfg: ReviewConfig) -> DataFrame:
    """The cells as the rows of A1 and A2."""
    quarter = F.col("day") >= F.lit(pacing(cfg.today).quarter_start)
    is_ = lambda kind: F.col("kind") == kind
    return cells.where(F.col("kind").isin("deal", "sql", "held_as_stored", "sal", "book")).select(
        "erp", "n", "arr", "acv", F.when(is_("sql"), F.col("day")).alias("create_d"),
        (is_("sql") & F.coalesce(quarter, F.lit(False))).alias("is_sql"), is_("held_as_stored").alias("is_held"),
        is_("sal").alias("is_sal"), is_("book").alias("is_book"))


def won(cells: DataFrame) -> DataFrame:
    """The cells of the quarter's wins."""
    return cells.where(F.col("kind") == "win")
