"""The whole review from two passes over the deals.

``WholeReview`` reads the clean deals once and writes the funnel cells, reads the open deals once and
writes them scored, and condenses those to the booking cells. All reports then read these three
tables: aggregates the cells, lists of deals the scored ones. Every operator of the registry runs on
it as on any review and gives the same rows.
"""
from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealflow import config as C
from dealflow.operators import cells, pods
from dealflow.plans.context import Review
from dealflow.session import written

#: Reports of the sheets: label columns, figure columns.
Spec = Mapping[str, tuple[tuple[str, ...], tuple[str, ...]]]

_FUNNEL = C.FUNNEL_METRICS
TOF_SHEET: Spec = {
    "tof_funnel": (("market",), _FUNNEL),
    "wow_by_market": (("market",), ("this_week", "last_week", "wow_pct")),
    "dim_funnel_market": (("market",), _FUNNEL), "dim_funnel_gtm": (("gtm",), _FUNNEL), "dim_funnel_product": (("product",), _FUNNEL),
    "company_totals": ((), _FUNNEL),
    "matrix_bookings_acv": (("product",), C.MARKET_ORDER), "matrix_bookings_arr": (("product",), C.MARKET_ORDER),
    "matrix_pipeline_acv": (("product",), C.MARKET_ORDER), "matrix_pipeline_arr": (("product",), C.MARKET_ORDER),
    "funnel_market_spine": (("market",), _FUNNEL), "funnel_gtm_spine": (("gtm",), _FUNNEL),
    "gtm_conversion": (("gtm",), ("sql_booked", "sql_held", "sal", "held_rate", "sal_rate")),
    "top_engine": (("top_engine",), ("top_sql_booked", "channel_sql_booked")),
    "market_lead_lag": (("lead_market", "lag_market"), ("lead_bookings_arr", "lag_bookings_arr")),
    "funnel_steps": (("step",), ("value", "pct_of_initial")),
    "product_mix_qtd": (("product",), ("pipeline_acv", "pipeline_acv_share", "bookings_acv")),
    "wins_kpis": ((), ("wins", "total_acv", "total_arr", "avg_acv", "avg_cycle_days")),
    "wins_by_market": (("market",), ("acv",)), "wins_by_product": (("product",), ("acv", "share")),
    "wins_by_partner": (("partner_disp",), ("acv",)),
}
BOOKING_SHEET: Spec = {
    "forecast_rollup": (("forecast_cat",), ("deals", "acv", "weighted_acv")),
    "forecast_windows": (("horizon",), ("deals", "total", "commit", "best", "weighted")),
    "forecast_hygiene": (("discipline_status",), ("open_deals", "categorized", "commit_best_deals", "uncategorized_acv", "discipline_pct")),
    "market_forecast": (("market", "category"), ("acv",)), "product_forecast": (("product", "category"), ("acv",)),
    "open_by_market": (("market",), ("acv", "deals")), "open_by_gtm": (("gtm",), ("acv", "deals")),
    "open_mix_product": (("product",), ("acv", "share")), "open_matrix": (("product",), C.MARKET_ORDER),
    "market_commit_vs_risk": (("measure", "market"), ("acv",)), "rag_distribution": (("rag",), ("deals",)),
    "open_quality_stats": ((), ("open_deals", "avg_meddpicc", "sentiment_coverage")),
    "pod_summary": (("pod", "status"), ("deals", "acv", "red", "yellow", "green", "avg_conf")),
    "pod_detail": (("pod", "status", "biggest_win", "biggest_risk", "exec_support"), ("deals", "acv", "red", "yellow", "green")),
    "top_red": (("dealname", "stage", "owner_name"), ("deal_id", "acv", "risk_count", "meddpicc")),
}


class WholeReview(Review):
    """A review whose figures come from written cells and written scored deals."""

    def __init__(self, review: Review):
        super().__init__(review.spark, review.deals, review.owners, review.sentiment, review.cfg,
                         **review.state, state_by_rule=review.state_by_rule, observations=review.observations)
        self._review = review

    @cached_property
    def tof_cells(self) -> DataFrame:
        return written(cells.tof_cells(self._review.clean, self.cfg))

    @cached_property
    def open_scored(self) -> DataFrame:
        return written(self._review.open_scored)

    @cached_property
    def open_cells(self) -> DataFrame:
        return written(cells.open_cells(self.open_scored, self.cfg))

    @property
    def quality_cells(self) -> DataFrame:
        return self.open_cells

    @property
    def open_core(self) -> DataFrame:
        return self.open_scored.drop("call_sentiment", "call_trend", "calls")

    @property
    def pod_rows(self) -> DataFrame:
        return self.open_scored

    @cached_property
    def pod_detail(self) -> DataFrame:
        return pods.pod_cards(pods.pod_counts(self.open_cells), pods.top_deals(self.open_scored, 1))

    @cached_property
    def enriched(self) -> DataFrame:
        return cells.enriched(self.tof_cells, self.cfg)

    @cached_property
    def enriched_wow(self) -> DataFrame:
        return cells.enriched(self.tof_cells, self.cfg, with_wow_window=True)

    @cached_property
    def tof_rows(self) -> DataFrame:
        return cells.tof_rows(self.tof_cells, self.cfg)

    @property
    def won_cells(self) -> DataFrame:
        return cells.won(self.tof_cells)


def sheet(review: Review, spec: Spec, operators: Mapping[str, Callable[[Review], DataFrame]]) -> DataFrame:
    """The figures of several reports as one long table: report, label, metric, value."""
    def figures(name: str) -> DataFrame:
        labels, metrics = spec[name]
        return operators[name](review).select(
            F.lit(name).alias("report"), F.concat_ws("|", *labels).alias("label") if labels else F.lit("").alias("label"),
            F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])))
    return reduce(DataFrame.unionByName, map(figures, spec))
