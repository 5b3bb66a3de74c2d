"""P8 funnel flags and the top-of-funnel aggregates.

Every aggregate is one scan with conditional sums (``count_if`` / ``sum(when)``), so the
partial (map-side) aggregation reduces each task to at most one row per group before the
only shuffle; heavy groups ('Other', 'Unknown') cost nothing extra. Category spines are
literal frames of at most five rows, so broadcasting them is bounded by construction.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dealflow import config as C
from dealflow.config import ReviewConfig
from dealflow.functions import dims
from dealflow.functions.pacing import pacing
from dealflow.functions.rules import number
from dealflow.functions.text import strip
from dealflow.functions.weights import tally
from dealflow.operators.hygiene import in_range

def zero() -> Column:
    return F.lit(0).cast("decimal(18,2)")


def happened(meeting: Column) -> Column:
    """SQL-Held needs the meeting to have happened: stripped, lower-cased value is 'yes'."""
    return F.coalesce(F.lower(strip(meeting)) == "yes", F.lit(False))


def enrich_qtd(base: DataFrame, cfg: ReviewConfig) -> DataFrame:
    """Market / GTM / product buckets and the four funnel event flags."""
    qs, td = pacing(cfg.today).quarter_start, cfg.today
    return dims.with_buckets(base, erp=None, eco="erp").withColumns({
        "arr": F.coalesce(F.col("arr"), zero()),
        "acv": F.coalesce(F.col("acv"), zero()),
        "is_sql": in_range(F.col("create_d"), qs, td),
        "is_held": in_range(F.col("disco_d"), qs, td) & happened(F.col("meeting_happened")),
        "is_sal": in_range(F.col("sal_d"), qs, td),
        "is_book": F.coalesce(F.col("won"), F.lit(False)) & in_range(F.col("close_d"), qs, td),
    })


def funnel_aggs(enriched: DataFrame) -> list[Column]:
    """The seven QTD funnel metrics as conditional aggregates over enriched rows."""
    def msum(flag: str, money: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col(flag), F.col(money))), zero())
    return [
        tally(enriched, "is_sql").alias("sql_booked"),
        tally(enriched, "is_held").alias("sql_held"),
        tally(enriched, "is_sal").alias("sal"),
        msum("is_sql", "arr").alias("pipeline_arr"),
        msum("is_sql", "acv").alias("pipeline_acv"),
        msum("is_book", "arr").alias("bookings_arr"),
        msum("is_book", "acv").alias("bookings_acv"),
    ]


def dim_funnel(enriched: DataFrame, dim: str) -> DataFrame:
    """A3: the seven metrics per value of one dimension (only values present in the base)."""
    return enriched.groupBy(dim).agg(*funnel_aggs(enriched))


def company_totals(enriched: DataFrame) -> DataFrame:
    """A4: one row of company totals."""
    return enriched.agg(*funnel_aggs(enriched))


def funnel_grouping_sets(enriched: DataFrame) -> DataFrame:
    """A3 x 3 + A4 in one pass: GROUPING SETS ((market), (gtm), (product), ())."""
    g = enriched.groupingSets([["market"], ["gtm"], ["product"], []], "market", "gtm", "product") \
                .agg(F.grouping_id().alias("gid"), *funnel_aggs(enriched))
    # grouping_id bits (market, gtm, product): 0b011 market set, 0b101 gtm, 0b110 product, 0b111 total
    dim = (F.when(F.col("gid") == 3, "market").when(F.col("gid") == 5, "gtm")
           .when(F.col("gid") == 6, "product").otherwise("total"))
    val = F.coalesce(F.col("market"), F.col("gtm"), F.col("product"), F.lit("Total"))
    return g.select(dim.alias("dimension"), val.alias("value"), *C.FUNNEL_METRICS)


def spine(spark: SparkSession, name: str, labels) -> DataFrame:
    """Fixed category order as a tiny literal frame (label, ord)."""
    return spark.createDataFrame([(lab, i) for i, lab in enumerate(labels)], f"{name} string, ord int")


def with_spine(agg: DataFrame, dim: str, labels, fill_cols) -> DataFrame:
    """Force every category in fixed order, filling absent ones with 0."""
    sp = spine(agg.sparkSession, dim, labels)
    # a left join can only broadcast its right side; the aggregate is bounded by the bucket
    # rule (at most five categories), so it is the broadcast side
    joined = sp.join(F.broadcast(agg), dim, "left")
    return joined.select(dim, "ord", *[F.coalesce(F.col(c), F.lit(0).cast(agg.schema[c].dataType)).alias(c)
                                       for c in fill_cols]).orderBy("ord")


def market_spine_funnel(enriched: DataFrame) -> DataFrame:
    return with_spine(dim_funnel(enriched, "market"), "market", C.MARKET_ORDER, C.FUNNEL_METRICS)


def gtm_spine_funnel(enriched: DataFrame) -> DataFrame:
    return with_spine(dim_funnel(enriched, "gtm"), "gtm", C.GTM_ENGINES, C.FUNNEL_METRICS)


def funnel_long(spined: DataFrame, dim: str) -> DataFrame:
    """Wide -> long of the three count stages with display labels."""
    long = spined.unpivot([dim, "ord"], list(C.COUNT_METRICS), "metric", "count")
    label = F.create_map(*[x for m in C.COUNT_METRICS for x in (F.lit(m), F.lit(C.METRIC_LABELS[m]))])
    return long.select(dim, "ord", label[F.col("metric")].alias("stage"), F.col("count").cast("bigint"))


def gtm_conversion(enriched: DataFrame) -> DataFrame:
    """GTM spine with held % = held/booked and SAL % = SAL/held, rounded half-even;
    NULL on a zero denominator."""
    g = gtm_spine_funnel(enriched)
    def rate(num, den):
        return F.bround(F.col(num) / F.nullif(F.col(den), F.lit(0)) * 100, 0).cast("double")
    return g.select("gtm", "ord", "sql_booked", "sql_held", "sal",
                    rate("sql_held", "sql_booked").alias("held_rate"),
                    rate("sal", "sql_held").alias("sal_rate"))


def first_max(df: DataFrame, label: str, value: str) -> Column:
    """Label of the largest value; ties go to the first label in fixed order."""
    return F.max_by(F.col(label), F.struct(F.col(value), -F.col("ord")))


def top_engine(enriched: DataFrame) -> DataFrame:
    """W3 (K3): engine with most SQL-Booked (ties -> first in engine order) and Channel's count."""
    g = gtm_spine_funnel(enriched)
    return g.agg(first_max(g, "gtm", "sql_booked").alias("top_engine"),
                 F.max("sql_booked").alias("top_sql_booked"),
                 F.sum(F.when(F.col("gtm") == "Channels", F.col("sql_booked")).otherwise(0))
                 .alias("channel_sql_booked"))


def market_lead_lag(enriched: DataFrame) -> DataFrame:
    """W3 (K2): market leading bookings ARR (over all four, ties -> market order) and the
    softest strategic market (min over the three primaries, ties -> market order)."""
    m = market_spine_funnel(enriched)
    prim = F.col("market").isin(*C.PRIMARY_MARKETS)
    lag_key = F.when(prim, F.struct(-F.col("bookings_arr"), -F.col("ord")))
    return m.agg(first_max(m, "market", "bookings_arr").alias("lead_market"),
                 F.max("bookings_arr").alias("lead_bookings_arr"),
                 F.max_by(F.col("market"), lag_key).alias("lag_market"),
                 F.min(F.when(prim, F.col("bookings_arr"))).alias("lag_bookings_arr"))


def funnel_steps(enriched: DataFrame) -> DataFrame:
    """SQL-Booked -> SQL-Held -> SAL -> Won with % of the first step."""
    t = enriched.agg(*[tally(enriched, flag).alias(f"s{i}") for i, flag in enumerate(("is_sql", "is_held", "is_sal", "is_book"))])
    st = t.select(F.col("s0").alias("first"), F.inline(F.array(
        *[F.struct(F.lit(lab).alias("step"), F.lit(i).alias("ord"), F.col(f"s{i}").alias("value"))
          for i, lab in enumerate(["SQL-Booked", "SQL-Held", "SAL", "Won"])])))
    return st.select("step", "ord", "value",
                     F.round(F.col("value") / F.nullif(F.col("first"), F.lit(0)) * 100, 6)
                     .alias("pct_of_initial"))


def share(c: str) -> Column:
    """Share of the column's total over the (already aggregated, bounded) frame."""
    total = F.sum(F.col(c)).over(Window.partitionBy())
    return F.round(F.col(c).cast("double") / F.nullif(total.cast("double"), F.lit(0.0)), 6)


def product_mix_qtd(enriched: DataFrame) -> DataFrame:
    """Pipeline ACV mix and bookings ACV by product (QTD)."""
    p = dim_funnel(enriched, "product")
    return p.select("product", "pipeline_acv", share("pipeline_acv").alias("pipeline_acv_share"),
                    "bookings_acv")


MATRIX_VALUES = {"bookings_acv": ("is_book", "acv"), "bookings_arr": ("is_book", "arr"),
                 "pipeline_acv": ("is_sql", "acv"), "pipeline_arr": ("is_sql", "arr")}


def product_market_matrix(enriched: DataFrame, value: str) -> DataFrame:
    """A5: product x market pivot of one funnel money metric over rows passing its flag;
    explicit pivot values (no extra distinct job), absent cells 0."""
    flag, money = MATRIX_VALUES[value]
    pv = (enriched.where(F.col(flag)).groupBy("product")
          .pivot("market", list(C.MARKET_ORDER)).agg(F.sum(money)))
    return pv.select("product", *[F.coalesce(F.col(m), zero()).alias(m) for m in C.MARKET_ORDER])


def held_as_stored(meeting: Column) -> Column:
    """A1's meeting test: lower-cased but not stripped."""
    return F.coalesce(F.lower(meeting) == "yes", F.lit(False))


def tof_rows(clean: DataFrame, cfg: ReviewConfig) -> DataFrame:
    """The rows that A1 and A2 add up: ERP label, create date, event flags and amounts of all clean deals."""
    qs, td = pacing(cfg.today).quarter_start, cfg.today
    return clean.select(
        dims.eco_label(F.col("erp_raw")).alias("erp"), "create_d",
        in_range(F.col("create_d"), qs, td).alias("is_sql"),
        (in_range(F.col("disco_d"), qs, td) & held_as_stored(F.col("meeting_happened"))).alias("is_held"),
        in_range(F.col("sal_d"), qs, td).alias("is_sal"),
        F.coalesce(F.col("is_won") & in_range(F.col("close_d"), qs, td), F.lit(False)).alias("is_book"),
        number(F.col("arr_raw"), "decimal(18,2)").alias("arr"), number(F.col("acv_raw"), "decimal(18,2)").alias("acv"))


def tof_funnel(rows: DataFrame) -> DataFrame:
    """A1: funnel straight from all clean deals by ERP label, money rounded to whole units
    per ERP (half away from zero) before the market re-sum; zero-activity groups stay."""
    def rsum(flag: str, money: str) -> Column:
        return F.coalesce(F.round(F.sum(F.when(F.col(flag), F.col(money)).otherwise(zero())), 0), F.lit(0))
    per_erp = rows.groupBy("erp").agg(
        tally(rows, "is_sql").alias("sql_booked"), tally(rows, "is_held").alias("sql_held"), tally(rows, "is_sal").alias("sal"),
        rsum("is_sql", "arr").alias("pipeline_arr"), rsum("is_sql", "acv").alias("pipeline_acv"),
        rsum("is_book", "arr").alias("bookings_arr"), rsum("is_book", "acv").alias("bookings_acv"))
    return (per_erp.groupBy(dims.market_of_eco(F.col("erp")).alias("market"))
            .agg(*[F.sum(m).alias(m) for m in C.FUNNEL_METRICS]))


def wow_by_market(rows: DataFrame, cfg: ReviewConfig) -> DataFrame:
    """A2: SQL-Booked this week (Monday..today) vs last full week (Monday..Sunday) by market,
    with WoW % (NULL when last week is 0). A partial week is compared with a full one.

    Every market with a clean deal appears (zero counts included), which needs the whole table."""
    per_erp = rows.groupBy("erp").agg(*wow_aggs(rows, cfg))
    m = (per_erp.groupBy(dims.market_of_eco(F.col("erp")).alias("market"))
         .agg(F.sum("this_week").alias("this_week"), F.sum("last_week").alias("last_week")))
    return m.withColumn("wow_pct", wow(F.col("this_week"), F.col("last_week")))


def wow_aggs(rows: DataFrame, cfg: ReviewConfig) -> list[Column]:
    """SQL-Booked this week and last full week as conditional counts (to sit beside the
    funnel aggregates in one pass)."""
    p = pacing(cfg.today)
    return [tally(rows, in_range(F.col("create_d"), p.week_start, cfg.today)).alias("this_week"),
            tally(rows, in_range(F.col("create_d"), p.last_week_start, p.last_week_end)).alias("last_week")]


def wow(this_week: Column, last_week: Column) -> Column:
    """100 * (this - last) / last, NULL when last is 0."""
    return F.round(100 * (this_week - last_week) / F.nullif(last_week, F.lit(0)).cast("double"), 6)
