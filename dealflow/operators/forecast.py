"""Forecast views of the scored open pipeline.

Each view is one conditional aggregation over the scored deals (map-side partial
aggregation, then a shuffle of at most a few rows per task); horizons and categories are
stacked with ``inline`` instead of one scan per horizon.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dealflow import config as C
from dealflow.config import ReviewConfig
from dealflow.functions.pacing import pacing
from dealflow.functions.weights import mean, tally
from dealflow.operators.funnel import spine


def _zsum(c: Column) -> Column:
    """pandas-style sum: no rows / all NULL -> 0."""
    return F.coalesce(F.sum(c), F.lit(0))


def forecast_rollup(scored: DataFrame) -> DataFrame:
    """Deals, ACV and weighted ACV per forecast category, in fixed category order."""
    g = scored.groupBy("forecast_cat").agg(
        tally(scored).alias("deals"), _zsum(F.col("acv")).alias("acv"),
        _zsum(F.col("weighted_acv")).alias("weighted_acv"))
    sp = spine(scored.sparkSession, "forecast_cat", C.FORECAST_ORDER)
    return g.join(F.broadcast(sp), "forecast_cat", "inner") \
            .select("forecast_cat", "ord", "deals", "acv", F.round("weighted_acv", 2).alias("weighted_acv")) \
            .orderBy("ord")


def forecast_windows(scored: DataFrame, cfg: ReviewConfig) -> DataFrame:
    """Open deals expected to close by the end of this week (Sunday), month and quarter.
    No lower bound, so overdue deals count in every horizon; NULL close dates count in none.
    The three horizons are computed independently (week end can fall after month end)."""
    p = pacing(cfg.today)
    ends = [("Week", p.week_end), ("Month", p.month_end), ("Quarter", p.quarter_end)]
    aggs = []
    for i, (_, end) in enumerate(ends):
        inside = F.col("close_d") <= F.lit(end)
        aggs += [tally(scored, inside).alias(f"deals{i}"),
                 _zsum(F.when(inside, F.col("acv"))).alias(f"total{i}"),
                 _zsum(F.when(inside & (F.col("forecast_cat") == "Commit"), F.col("acv"))).alias(f"commit{i}"),
                 _zsum(F.when(inside & (F.col("forecast_cat") == "Best Case"), F.col("acv"))).alias(f"best{i}"),
                 _zsum(F.when(inside, F.col("weighted_acv"))).alias(f"weighted{i}")]
    one = scored.agg(*aggs)
    rows = [F.struct(F.lit(name).alias("horizon"), F.lit(i).alias("ord"), F.lit(end).alias("end_date"),
                     F.col(f"deals{i}").alias("deals"), F.col(f"total{i}").cast("decimal(38,2)").alias("total"),
                     F.col(f"commit{i}").cast("decimal(38,2)").alias("commit"),
                     F.col(f"best{i}").cast("decimal(38,2)").alias("best"),
                     F.round(F.col(f"weighted{i}"), 2).cast("decimal(38,2)").alias("weighted"))
            for i, (name, end) in enumerate(ends)]
    return one.select(F.inline(F.array(*rows)))


def forecast_hygiene(scored: DataFrame, cfg: ReviewConfig) -> DataFrame:
    """How many open deals carry a rep category; ACV left uncategorised; discipline %."""
    one = scored.agg(
        tally(scored).alias("open_deals"),
        tally(scored, "is_forecasted").alias("categorized"),
        tally(scored, F.col("forecast_cat").isin("Commit", "Best Case")).alias("commit_best_deals"),
        _zsum(F.when(~F.col("is_forecasted"), F.col("acv"))).alias("uncategorized_acv"))
    pct = F.when(F.col("open_deals") > 0, 100 * F.col("categorized") / F.col("open_deals")).otherwise(F.lit(0.0))
    return one.withColumn("discipline_pct", F.round(pct, 6)).withColumn(
        "discipline_status",
        F.when(F.col("discipline_pct") >= cfg.discipline_green, "Green")
         .when(F.col("discipline_pct") >= cfg.discipline_yellow, "Yellow").otherwise("Red"))


def category_by(scored: DataFrame, dim: str) -> DataFrame:
    """Open ACV per dimension value x (Commit, Best Case, Pipeline), long form."""
    cats = ("Commit", "Best Case", "Pipeline")
    g = scored.groupBy(dim).agg(*[_zsum(F.when(F.col("forecast_cat") == c, F.col("acv"))).alias(f"c{i}")
                                  for i, c in enumerate(cats)])
    return g.select(dim, F.inline(F.array(*[
        F.struct(F.lit(c).alias("category"), F.col(f"c{i}").alias("acv")) for i, c in enumerate(cats)])))


def open_by_market(scored: DataFrame) -> DataFrame:
    """Open ACV and deals by market in fixed order; markets without deals are dropped."""
    g = scored.groupBy("market").agg(_zsum(F.col("acv")).alias("acv"), tally(scored).alias("deals"))
    sp = spine(scored.sparkSession, "market", C.MARKET_ORDER)
    return g.join(F.broadcast(sp), "market", "inner").select("market", "ord", "acv", "deals").orderBy("ord")


def open_by_gtm(scored: DataFrame) -> DataFrame:
    """Open ACV and deals by engine, largest ACV first (ties by name)."""
    return scored.groupBy("gtm").agg(_zsum(F.col("acv")).alias("acv"), tally(scored).alias("deals")) \
                 .orderBy(F.col("acv").desc(), "gtm")


def with_share(df: DataFrame, col: str, name: str = "share") -> DataFrame:
    """Share of total over an already-aggregated (bounded) frame."""
    total = F.sum(F.col(col)).over(Window.partitionBy())
    return df.withColumn(name, F.round(F.col(col).cast("double") / F.nullif(total.cast("double"), F.lit(0.0)), 6))


def open_mix_product(scored: DataFrame) -> DataFrame:
    """A18."""
    return with_share(scored.groupBy("product").agg(_zsum(F.col("acv")).alias("acv")), "acv")


def open_matrix(scored: DataFrame) -> DataFrame:
    """Product x market open ACV, explicit pivot values, absent cells 0."""
    pv = scored.groupBy("product").pivot("market", list(C.MARKET_ORDER)).agg(F.sum("acv"))
    return pv.select("product", *[F.coalesce(F.col(m), F.lit(0).cast("decimal(18,2)")).alias(m)
                                  for m in C.MARKET_ORDER])


def market_commit_vs_risk(scored: DataFrame) -> DataFrame:
    """Commit ACV and Red ACV by market, flagging the market holding the most of each
    (ties -> alphabetically first market)."""
    kind = F.when(F.col("forecast_cat") == "Commit", F.array(F.lit("commit"))).otherwise(F.array())
    kind = F.concat(kind, F.when(F.col("rag") == "Red", F.array(F.lit("red"))).otherwise(F.array()))
    long = scored.select("market", "acv", F.explode(kind).alias("measure"))
    g = long.groupBy("measure", "market").agg(_zsum(F.col("acv")).alias("acv"))
    w = Window.partitionBy("measure").orderBy(F.col("acv").desc(), F.col("market"))
    return g.withColumn("is_top", F.row_number().over(w) == 1)


def rag_distribution(scored: DataFrame) -> DataFrame:
    """A28."""
    return scored.groupBy("rag").agg(tally(scored).alias("deals"))


def open_quality_stats(scored: DataFrame) -> DataFrame:
    """Open deals, mean MEDDPICC score, deals with call sentiment."""
    heard = F.col("has_sentiment") if "has_sentiment" in scored.columns else F.col("call_sentiment").isNotNull()
    return scored.agg(tally(scored).alias("open_deals"),
                      F.round(mean(scored, "meddpicc"), 6).alias("avg_meddpicc"),
                      tally(scored, heard).alias("sentiment_coverage"))
