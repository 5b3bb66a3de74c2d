"""Pod summaries and review cards.

One ``groupBy(pod)`` per view. The biggest win and the biggest risk come from a window with a rank
limit that carries the deal's fields, and every task passes on one row per pod and lane: a pod
holding a third of all deals costs three rows per task.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dealflow import config as C
from dealflow.config import ReviewConfig
from dealflow.functions.rules import FLAG_COLUMNS, first_flag, support_ask
from dealflow.functions.text import money_or_dash
from dealflow.functions.weights import mean, tally


def _status(red: Column, yellow: Column, green: Column) -> Column:
    return F.when(red > green, "Red").when(yellow >= green, "Yellow").otherwise("Green")


def pod_counts(scored: DataFrame, *more: Column) -> DataFrame:
    """Deals, ACV and RAG counts of every pod."""
    rags = [tally(scored, F.col("rag") == rag).alias(rag.lower()) for rag in ("Red", "Yellow", "Green")]
    return scored.groupBy("pod").agg(tally(scored).alias("deals"), F.coalesce(F.sum("acv"), F.lit(0)).alias("acv"), *rags, *more)


def pod_summary(scored: DataFrame) -> DataFrame:
    """Deals, ACV, RAG counts, mean confidence and status per pod, largest ACV first."""
    g = pod_counts(scored, F.round(mean(scored, "confidence"), 6).alias("avg_conf"))
    return g.withColumn("status", _status(F.col("red"), F.col("yellow"), F.col("green"))).orderBy(F.col("acv").desc(), "pod")


#: What the pod views read of a scored deal.
COLUMNS = ("pod", "deal_id", "dealname", "acv", "rag", "forecast_cat", "confidence", *[name for name, _ in FLAG_COLUMNS])


def _lanes() -> dict[str, Column]:
    """The rankings of a pod's deals: Commit-or-Green ones, all, Red ones."""
    return {"winner": (F.col("forecast_cat") == "Commit") | (F.col("rag") == "Green"),
            "any": F.lit(True), "risk": F.col("rag") == "Red"}


def top_deals(scored: DataFrame, k: int) -> DataFrame:
    """The ``k`` largest deals of every pod and lane (ACV present first, larger ACV, then lowest
    deal id): pod, lane, place (1 to k), deal_id, dealname, acv, first_flag.

    A rank limit over a window, so every task passes on at most k deals of a pod and lane,
    however many of the deals one pod holds."""
    lane = F.explode(F.array_compact(F.array(*[F.when(holds, F.lit(name)) for name, holds in _lanes().items()])))
    order = Window.partitionBy("pod", "lane").orderBy(F.col("acv").desc_nulls_last(), F.col("deal_id"))
    return scored.select("pod", lane.alias("lane"), "deal_id", "dealname", "acv", first_flag().alias("first_flag")) \
                 .withColumn("place", F.row_number().over(order)).where(F.col("place") <= k) \
                 .select("pod", "lane", "place", "deal_id", "dealname", "acv", "first_flag")


def _deal_label(d: Column) -> Column:
    """'<name up to 34 chars> ($12K)', '—' when there is no such deal."""
    return F.when(d.isNull(), F.lit(C.DASH)).otherwise(F.concat(
        F.coalesce(F.substring(d["dealname"], 1, 34), F.lit("")), F.lit(" ("),
        money_or_dash(d["acv"]), F.lit(")")))


def pod_detail(scored: DataFrame) -> DataFrame:
    """Pod card fields: status, biggest win (largest ACV among Commit-or-Green deals, else
    among all), biggest risk (largest ACV among Red) and the exec-support ask named by the
    first risk flag of that deal. Largest total ACV first.

    ``scored`` is read twice, for the counts and for the largest deals; pass rows that are written
    (``Review.pod_rows``) so that the scores are derived once."""
    return pod_cards(pod_counts(scored), top_deals(scored, 1))


def pod_cards(counts: DataFrame, tops: DataFrame) -> DataFrame:
    """A9 from the counts of the pods and their largest deals."""
    # a row per lane of a pod, so the lists hold three deals at most
    deal = F.map_from_entries(F.collect_list(F.struct("lane", F.struct("dealname", "acv", "first_flag"))))
    g = counts.join(tops.where(F.col("place") == 1).groupBy("pod").agg(deal.alias("_deals")), "pod", "left")
    at = lambda lane: F.try_element_at("_deals", F.lit(lane))
    g = g.withColumns({"win": F.coalesce(at("winner"), at("any")), "risk": at("risk")})
    return g.select(
        "pod", "deals", "acv", _status(F.col("red"), F.col("yellow"), F.col("green")).alias("status"),
        "red", "yellow", "green",
        _deal_label(F.col("win")).alias("biggest_win"),
        _deal_label(F.col("risk")).alias("biggest_risk"),
        F.when(F.col("risk").isNull(), F.lit(C.SUPPORT_NONE))
         .otherwise(support_ask(F.col("risk.first_flag"))).alias("exec_support")).orderBy(F.col("acv").desc(), "pod")


def pod_reviews(scored: DataFrame, cfg: ReviewConfig) -> DataFrame:
    """K8 (T2 + P6): keep pods with >= 3 deals when any pod has that many, else all; the
    first 8 by ACV. Pods with enough deals come first in the top-k, so whether there is one shows
    among the cards themselves; the window runs over these."""
    return first_cards(pod_detail(scored), cfg)


def first_cards(detail: DataFrame, cfg: ReviewConfig) -> DataFrame:
    """T2 + P6 over the cards of all pods."""
    d = detail.withColumn("_big", F.col("deals") >= cfg.pod_min_deals)
    top = d.orderBy(F.col("_big").desc(), F.col("acv").desc(), F.col("pod")).limit(cfg.pod_cards)
    some = F.max("_big").over(Window.partitionBy())
    return top.withColumn("_some", some).where(F.col("_big") | ~F.col("_some")).drop("_big", "_some") \
              .orderBy(F.col("acv").desc(), F.col("pod"))
