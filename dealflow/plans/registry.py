"""

Each entry is ``fn(spark, sf_dir) -> DataFrame``; it derives the review inputs from the
tables under ``sf_dir`` and returns the operator's result (money as DOUBLE).
"""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dealflow import config as C
from dealflow import schema
from dealflow.config import DEFAULT_CONFIG, ReviewConfig
from dealflow.functions import dims
from dealflow.functions.quarters import pacing_columns
from dealflow.functions.rules import reject_reason
from dealflow.functions.text import money_or_dash, signed
from dealflow.operators import forecast, funnel, history, paging, pods, scoring, state, store, trends, wins
from dealflow.operators.hygiene import hygiene
from dealflow.plans import reports, whole
from dealflow.plans.context import Review, to_output
from dealflow.session import ensure_checkpoint_dir
from dealflow.sources import bucketed, by_quarter, readers

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, QueryFn] = {}
OPERATORS: dict[str, Callable[[Review], DataFrame]] = {}


def query(name: str):
    def deco(fn: Callable[[Review], DataFrame]) -> Callable[[Review], DataFrame]:
        def run(spark: SparkSession, sf_dir: str, cfg: ReviewConfig = DEFAULT_CONFIG) -> DataFrame:
            return to_output(fn(Review.from_test_tables(spark, sf_dir, cfg)))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        REGISTRY[name] = run
        OPERATORS[name] = fn
        return fn
    return deco


def run(name: str, review: Review) -> DataFrame:
    """Run one named operator on any review (e.g. ``Review.from_tables(...)`` over stored
    CRM tables); money is returned as DOUBLE."""
    return to_output(OPERATORS[name](review))


def operators() -> dict[str, Callable[[Review], DataFrame]]:
    return dict(OPERATORS)


# ---- Sources, hygiene, buckets (S1, P1, P2, P8, F1-F4, F21) -------------------------

@query("hygiene_filter")
def _hygiene_filter(r: Review) -> DataFrame:
    """P1 over every deal."""
    return r.deals.where(hygiene(r.cfg)).select("deal_id", "dealname", "pipeline_id", "source_label")


@query("qtd_base")
def _qtd_base(r: Review) -> DataFrame:
    """S1 + P1 + P2."""
    return r.qtd_base


@query("qtd_base_by_quarter")
def _qtd_base_by_quarter(r: Review) -> DataFrame:
    """S1 + P2 from deals laid out by the quarters they touch: one folder is read."""
    path = _scratch(r, "by-quarter")
    by_quarter.write(r.deals, path)
    return by_quarter.qtd_base(r.spark, path, r.cfg)


@query("numeric_rejects")
def _numeric_rejects(r: Review) -> DataFrame:
    """Every value of a number column of the clean deals that is read as NULL (or 0)."""
    return readers.rejects(r.clean)


@query("numeric_reject_counts")
def _numeric_reject_counts(r: Review) -> DataFrame:
    """Rejected values by column and reason, with the deals they belong to in each market."""
    named = r.clean.select("deal_id", dims.market(F.col("erp_raw")).alias("market"), *readers.NUMBERS)
    values = F.array(*[F.struct(F.lit(c).alias("column"), reject_reason(F.col(c), kind).alias("reason"))
                       for c, kind in readers.NUMBERS.items()])
    long = named.select("market", F.inline(values)).where(F.col("reason").isNotNull())
    return long.groupBy("column", "reason", "market").agg(F.count(F.lit(1)).alias("values"))


@query("enrich_qtd")
def _enrich_qtd(r: Review) -> DataFrame:
    """P8."""
    return r.enriched.select("deal_id", "market", "gtm", "product", "arr", "acv",
                             "is_sql", "is_held", "is_sal", "is_book")


@query("dim_buckets")
def _dim_buckets(r: Review) -> DataFrame:
    """F1-F4 over every deal (no hygiene)."""
    d = r.deals.select("deal_id", dims.eco_label(F.col("erp_raw")).alias("eco"), "gtm_raw", "use_case")
    return dims.with_buckets(d, erp=None, eco="eco").select("deal_id", "eco", "market", "gtm", "product")


@query("pacing")
def _pacing(r: Review) -> DataFrame:
    """F21 for every deal's create date (the as-of pacing is the same rule on one date)."""
    return r.deals.select("deal_id", F.col("create_d").alias("as_of"),
                          *[c.alias(n) for n, c in pacing_columns(F.col("create_d")).items()])


# ---- Top-of-funnel aggregates (A1-A5, A24-A26, J5, R1, W3) ----------------------------

@query("dim_funnel_market")
def _dim_funnel_market(r: Review) -> DataFrame:
    return funnel.dim_funnel(r.enriched, "market")


@query("dim_funnel_gtm")
def _dim_funnel_gtm(r: Review) -> DataFrame:
    return funnel.dim_funnel(r.enriched, "gtm")


@query("dim_funnel_product")
def _dim_funnel_product(r: Review) -> DataFrame:
    return funnel.dim_funnel(r.enriched, "product")


@query("company_totals")
def _company_totals(r: Review) -> DataFrame:
    return funnel.company_totals(r.enriched)


@query("funnel_grouping_sets")
def _funnel_grouping_sets(r: Review) -> DataFrame:
    return funnel.funnel_grouping_sets(r.enriched)


@query("tof_funnel")
def _tof_funnel(r: Review) -> DataFrame:
    return funnel.tof_funnel(r.tof_rows)


@query("wow_by_market")
def _wow_by_market(r: Review) -> DataFrame:
    return funnel.wow_by_market(r.tof_rows, r.cfg)


for _value in funnel.MATRIX_VALUES:
    def _matrix(r: Review, _v=_value) -> DataFrame:
        return funnel.product_market_matrix(r.enriched, _v)
    query(f"matrix_{_value}")(_matrix)


@query("funnel_market_spine")
def _funnel_market_spine(r: Review) -> DataFrame:
    return funnel.market_spine_funnel(r.enriched)


@query("funnel_gtm_spine")
def _funnel_gtm_spine(r: Review) -> DataFrame:
    return funnel.gtm_spine_funnel(r.enriched)


@query("funnel_long_market")
def _funnel_long_market(r: Review) -> DataFrame:
    return funnel.funnel_long(funnel.market_spine_funnel(r.enriched), "market")


@query("funnel_long_gtm")
def _funnel_long_gtm(r: Review) -> DataFrame:
    return funnel.funnel_long(funnel.gtm_spine_funnel(r.enriched), "gtm")


@query("gtm_conversion")
def _gtm_conversion(r: Review) -> DataFrame:
    return funnel.gtm_conversion(r.enriched)


@query("top_engine")
def _top_engine(r: Review) -> DataFrame:
    return funnel.top_engine(r.enriched)


@query("market_lead_lag")
def _market_lead_lag(r: Review) -> DataFrame:
    return funnel.market_lead_lag(r.enriched)


@query("funnel_steps")
def _funnel_steps(r: Review) -> DataFrame:
    return funnel.funnel_steps(r.enriched)


@query("product_mix_qtd")
def _product_mix_qtd(r: Review) -> DataFrame:
    return funnel.product_mix_qtd(r.enriched)


# ---- Booking review: open pipeline scoring (S2, S4, S5, J1, J2, F5-F20) ---------------


@query("open_deals")
def _open_deals(r: Review) -> DataFrame:
    """S2 + P1 + P3 + F20."""
    from dealflow.sources.readers import open_deals_scan
    return scoring.with_stage(open_deals_scan(r.deals, r.cfg), r.cfg)


@query("owner_dim")
def _owner_dim(r: Review) -> DataFrame:
    """S4."""
    return r.owner_dim


@query("deal_sentiment")
def _deal_sentiment(r: Review) -> DataFrame:
    """S5 + A10."""
    return r.deal_sentiment.select("deal_id", F.round("call_sentiment", 6).alias("call_sentiment"),
                                   F.round("call_trend", 6).alias("call_trend"), "calls")


@query("deals_with_owner")
def _deals_with_owner(r: Review) -> DataFrame:
    """J1."""
    return r.open_core.select("deal_id", "owner_id", "owner_name", "pod")


@query("deals_with_sentiment")
def _deals_with_sentiment(r: Review) -> DataFrame:
    """J2."""
    return r.open_scored.select("deal_id", F.round("call_sentiment", 6).alias("call_sentiment"),
                                F.round("call_trend", 6).alias("call_trend"), "calls")


@query("deals_with_sentiment_bucketed")
def _deals_with_sentiment_bucketed(r: Review) -> DataFrame:
    """J2 over deals and calls stored in buckets of the deal key."""
    names = {}
    for kind, df in (("deals", r.deals), ("calls", r.sentiment)):
        path = _scratch(r, kind)
        names[kind] = path.rsplit("/", 1)[1].replace("-", "_")
        bucketed.save(df, names[kind], path, buckets=16)
    spoken = bucketed.open_deals_with_sentiment(r.spark, names["deals"], names["calls"], r.cfg)
    return spoken.select("deal_id", F.round("call_sentiment", 6).alias("call_sentiment"),
                         F.round("call_trend", 6).alias("call_trend"), "calls")


@query("forecast_fields")
def _forecast_fields(r: Review) -> DataFrame:
    """F5-F8."""
    return r.open_core.select("deal_id", "forecast_cat", "is_forecasted", "fcat_disp", "prob",
                                "weighted_acv", "market", "product", "gtm")


@query("deal_scoring")
def _deal_scoring(r: Review) -> DataFrame:
    """F9-F15."""
    return r.open_core.select("deal_id", "days_since_contact", "has_M", "has_E", "has_D", "has_I",
                                "has_C", "has_Champ", "meddpicc",
                                scoring.flags_text().alias("risk_flags"),
                                "risk_count", "rag", "confidence")


@query("deal_recommendations")
def _deal_recommendations(r: Review) -> DataFrame:
    """F16-F19."""
    return r.open_core.select("deal_id", "rec_category", "rec_reason", "action",
                                "partner_disp", "partner_flag")


@query("open_pipeline_full")
def _open_pipeline_full(r: Review) -> DataFrame:
    """The full open pipeline with the 15 review columns, largest ACV first (NULL ACV last,
    ties by deal id)."""
    return r.open_core.orderBy(F.col("acv").desc_nulls_last(), "deal_id").select("deal_id", "dealname", "stage", "forecast_cat", "rec_category", "market",
                                "product", "gtm", "acv", "owner_name", "pod", "meddpicc", "rag",
                                "confidence", "days_since_contact", "action")


def _top_deals(scored: DataFrame, n: int) -> DataFrame:
    """Global top-n by ACV (NULL ACV last; ties -> lowest deal id): TakeOrderedAndProject."""
    return scored.orderBy(F.col("acv").desc_nulls_last(), F.col("deal_id")).limit(n)


@query("watchlist")
def _watchlist(r: Review) -> DataFrame:
    """T3 + F29: top 12 Red/Yellow deals by ACV with the 16 display columns."""
    # top-N first (the order needs no sentiment), then sentiment aggregated for those N deals
    # only instead of for every deal
    top = _top_deals(r.open_core.where(F.col("rag").isin("Red", "Yellow")), r.cfg.watchlist_n)
    top = scoring.with_sentiment(top, r.sentiment_for(top)).orderBy(F.col("acv").desc_nulls_last(), "deal_id")
    url = F.replace(F.lit(r.cfg.deal_url_template), F.lit("{deal_id}"), F.col("deal_id").cast("string"))
    return top.select(
        "deal_id", F.col("dealname").alias("deal"), F.col("owner_name").alias("owner"), "acv",
        money_or_dash(F.col("acv")).alias("acv_text"), "stage",
        F.date_format("close_d", "MMM dd").alias("close"),
        F.col("forecast_cat").alias("rep_category"), F.col("rec_category").alias("recommended"),
        F.col("rec_reason").alias("why"), F.col("confidence").cast("string").alias("conf"), "rag",
        F.concat(F.col("meddpicc").cast("string"), F.lit("/5")).alias("meddpicc"),
        F.when(F.col("call_sentiment").isNull(), F.lit(C.DASH))
         .otherwise(signed(F.col("call_sentiment"), 2)).alias("sentiment"),
        scoring.flags_text().alias("risk_flags"),
        F.col("partner_disp").alias("partner"), "action", url.alias("deal_url"))


@query("top_red")
def _top_red(r: Review) -> DataFrame:
    """T5: the five largest Red deals."""
    return _top_deals(r.open_core.where(F.col("rag") == "Red"), r.cfg.top_red_n) \
        .select("deal_id", "dealname", "stage", "acv", "owner_name", "risk_count", "meddpicc")


# ---- Forecast views (A6, A7, A12, A14-A19, A27, A28) ----------------------------------

@query("forecast_rollup")
def _forecast_rollup(r: Review) -> DataFrame:
    return forecast.forecast_rollup(r.open_cells)


@query("forecast_windows")
def _forecast_windows(r: Review) -> DataFrame:
    return forecast.forecast_windows(r.open_cells, r.cfg)


@query("forecast_hygiene")
def _forecast_hygiene(r: Review) -> DataFrame:
    return forecast.forecast_hygiene(r.open_cells, r.cfg)


@query("market_forecast")
def _market_forecast(r: Review) -> DataFrame:
    return forecast.category_by(r.open_cells, "market")


@query("product_forecast")
def _product_forecast(r: Review) -> DataFrame:
    return forecast.category_by(r.open_cells, "product")


@query("open_by_market")
def _open_by_market(r: Review) -> DataFrame:
    return forecast.open_by_market(r.open_cells)


@query("open_by_gtm")
def _open_by_gtm(r: Review) -> DataFrame:
    return forecast.open_by_gtm(r.open_cells)


@query("open_mix_product")
def _open_mix_product(r: Review) -> DataFrame:
    return forecast.open_mix_product(r.open_cells)


@query("open_matrix")
def _open_matrix(r: Review) -> DataFrame:
    return forecast.open_matrix(r.open_cells)


@query("market_commit_vs_risk")
def _market_commit_vs_risk(r: Review) -> DataFrame:
    return forecast.market_commit_vs_risk(r.open_cells)


@query("rag_distribution")
def _rag_distribution(r: Review) -> DataFrame:
    return forecast.rag_distribution(r.open_cells)


@query("open_quality_stats")
def _open_quality_stats(r: Review) -> DataFrame:
    return forecast.open_quality_stats(r.quality_cells)


# ---- Pods (A8, A9, K8) ---------------------------------------------------------------

@query("pod_summary")
def _pod_summary(r: Review) -> DataFrame:
    return pods.pod_summary(r.open_cells)


@query("pod_detail")
def _pod_detail(r: Review) -> DataFrame:
    return r.pod_detail


@query("pod_top_deals")
def _pod_top_deals(r: Review) -> DataFrame:
    """The three largest deals of every pod, of its Commit-or-Green ones and of its Red ones."""
    return pods.top_deals(r.open_core, 3)


@query("pod_reviews")
def _pod_reviews(r: Review) -> DataFrame:
    """K8: the pod cards, with 'what changed' pointing at the movement table once a prior
    weekly snapshot exists."""
    return pods.first_cards(r.pod_detail, r.cfg).withColumn(
        "what_changed", F.when(r.has_prior_snapshot, F.lit("see Movement")).otherwise(F.lit("WoW from snapshots (next week)")))


# ---- Wins (S3, A20-A23) --------------------------------------------------------------

@query("closed_won")
def _closed_won(r: Review) -> DataFrame:
    return r.won.select("deal_id", "dealname", "owner_name", "market", "product", "arr", "acv",
                        "days_to_close", "partner_disp", "close_d")


@query("wins_kpis")
def _wins_kpis(r: Review) -> DataFrame:
    return wins.wins_kpis(r.won_cells)


@query("wins_by_market")
def _wins_by_market(r: Review) -> DataFrame:
    return wins.wins_by(r.won_cells, "market")


@query("wins_by_product")
def _wins_by_product(r: Review) -> DataFrame:
    return wins.wins_by_product(r.won_cells)


@query("wins_by_partner")
def _wins_by_partner(r: Review) -> DataFrame:
    return wins.wins_by_partner(r.won_cells, r.cfg)


# ---- Time: as-of snapshots, pace, trend (J7/A11, W1, W2) ------------------------------


@query("historical_snapshots")
def _historical_snapshots(r: Review) -> DataFrame:
    """J7 + A11: QTD metrics as of every Friday of the quarter to date."""
    return r.hist


@query("pace_cumulative_arr")
def _pace_cumulative_arr(r: Review) -> DataFrame:
    """Cumulative Bookings ARR by close date vs the linear plan target."""
    return trends.pace_cumulative(r.enriched, state.goal_total(r.goals, r.pacing.quarter_key, "bookings_arr"),
                                  "bookings_arr", r.cfg)


@query("pace_cumulative_sql")
def _pace_cumulative_sql(r: Review) -> DataFrame:
    """Cumulative SQL-Booked by create date vs the linear plan target."""
    return trends.pace_cumulative(r.enriched, state.goal_total(r.goals, r.pacing.quarter_key, "sql_booked"),
                                  "sql_booked", r.cfg)


@query("trend_weekly")
def _trend_weekly(r: Review) -> DataFrame:
    """W2 + R4 + P7."""
    return reports.trend(r)


# ---- State: goals, snapshots, actions (S7-S9, U1-U9, J8) -------------------------------

@query("goals_for_quarter")
def _goals_for_quarter(r: Review) -> DataFrame:
    """S7."""
    return state.goals_for_quarter(r.goals, r.pacing.quarter_key)


@query("goal_for")
def _goal_for(r: Review) -> DataFrame:
    """One goal, beside one that is not set."""
    q = r.pacing.quarter_key
    return r.spark.range(1).select(state.goal_for(r.goals, q, "Sage", "bookings_arr").alias("sage_bookings_arr"),
                                   state.goal_for(r.goals, q, "Dynamics", "sql_held").alias("dynamics_sql_held"))


def _qtd_goal_rows(r: Review, metrics, factor: int) -> DataFrame:
    """Goal rows for the current quarter set to ``factor`` x the QTD actual per market."""
    m = funnel.market_spine_funnel(r.enriched)
    long = m.unpivot(["market"], list(metrics), "metric", "actual")
    return long.select(F.lit(r.pacing.quarter_key).alias("quarter"), "market", "metric",
                       F.round(F.col("actual").cast("double") * factor, 0).alias("value"))


@query("goals_upsert")
def _goals_upsert(r: Review) -> DataFrame:
    """Set the SQL-Held goal of every market (one was missing) to 2x its QTD actual."""
    return state.set_goals(r.goals, _qtd_goal_rows(r, ["sql_held"], 2))


@query("goals_replace_quarter")
def _goals_replace_quarter(r: Review) -> DataFrame:
    """Replace all goals of the current quarter by 2x the QTD actuals."""
    return state.replace_quarter_goals(r.goals, r.pacing.quarter_key, _qtd_goal_rows(r, C.GOAL_METRICS, 2))


@query("goal_totals")
def _goal_totals(r: Review) -> DataFrame:
    """A29."""
    return reports.goal_totals(r)


@query("market_attainment")
def _market_attainment(r: Review) -> DataFrame:
    """J3 + F22 + F23."""
    return reports.market_attainment(r)


@query("snapshot_history")
def _snapshot_history(r: Review) -> DataFrame:
    """S9 over the synced store."""
    return state.history(r.snapshot_store)


@query("snapshot_capture")
def _snapshot_capture(r: Review) -> DataFrame:
    """Capture today's TOF totals into the store."""
    return state.capture(r.snapshot_store, reports.tof_snapshot(r))


@query("snapshot_backfill")
def _snapshot_backfill(r: Review) -> DataFrame:
    """U4: merge the reconstructed Friday history into the seed store."""
    return state.backfill(r.snapshot_seed, r.hist)


@query("snapshot_missing_dates")
def _snapshot_missing_dates(r: Review) -> DataFrame:
    """U5."""
    return state.missing_dates(r.snapshot_seed, r.hist)


@query("snapshot_sync")
def _snapshot_sync(r: Review) -> DataFrame:
    """Gate + backfill."""
    return state.sync(r.snapshot_seed, r.hist)


@query("snapshot_latest_before")
def _snapshot_latest_before(r: Review) -> DataFrame:
    """J8."""
    return state.latest_before(r.snapshot_store, r.cfg.today)


@query("actions_list")
def _actions_list(r: Review) -> DataFrame:
    """The Booking list of the current quarter."""
    return state.actions_list(r.actions, r.pacing.quarter_key, "Booking", r.cfg.today)


@query("actions_add")
def _actions_add(r: Review) -> DataFrame:
    """Add a follow-up for the largest Red deal to the current quarter's Booking list."""
    top = r.open_core.where(F.col("rag") == "Red") \
                       .orderBy(F.col("acv").desc_nulls_last(), F.col("deal_id")).limit(1)
    items = top.select(F.lit(1).alias("seq"), F.concat(F.lit("Review "), F.col("dealname")).alias("text"),
                       F.col("owner_name").alias("owner"))
    return state.actions_add(r.actions, r.pacing.quarter_key, "Booking", items, r.cfg.today)


@query("actions_replace")
def _actions_replace(r: Review) -> DataFrame:
    """U8 + U9: replace the current quarter's Booking list by one item per pod review card
    (a pod with nothing to ask gives a blank item, which the save rule drops). The positions come
    from a window over the cards, which are limited to ``cfg.pod_cards``."""
    pd_ = pods.first_cards(r.pod_detail, r.cfg)
    items = pd_.select(
        F.dense_rank().over(Window.orderBy("pod")).cast("bigint").alias("pos"),
        F.when(F.col("exec_support") == C.SUPPORT_NONE, F.lit(""))
         .otherwise(F.concat(F.col("pod"), F.lit(": "), F.col("exec_support"))).alias("text"),
        F.col("pod").alias("owner"), F.lit("Open").alias("status"), F.lit(r.cfg.today).alias("added"))
    return state.actions_replace(r.actions, r.pacing.quarter_key, "Booking", items)


def _scratch(r: Review, name: str) -> str:
    """A new folder for a stored table, in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(r.spark)}/{name}-{uuid.uuid4().hex}"


@query("stored_goals_emptied")
def _stored_goals_emptied(r: Review) -> DataFrame:
    """U1 + U2 on a stored table: all goals are saved, then the current quarter is replaced by no
    goals; the rows that the table holds afterwards."""
    path = _scratch(r, "goals")
    state.save_goals(r.spark, path, r.goals)
    state.save_quarter_goals(r.spark, path, r.pacing.quarter_key, r.goals.limit(0))
    return state.stored(r.spark, path, schema.GOALS)


@query("stored_actions_emptied")
def _stored_actions_emptied(r: Review) -> DataFrame:
    """U8 + U9 on a stored table: all actions are saved, then the current Booking list is replaced by
    one blank item; the rows that the table holds afterwards."""
    path = _scratch(r, "actions")
    store.rewrite(r.spark, path, schema.ACTIONS, "quarter", state.groups_of(r.actions, "quarter"), lambda _: r.actions)
    blank = r.spark.range(1).select(F.lit(1).cast("bigint").alias("pos"), F.lit(" ").alias("text"), F.lit("").alias("owner"),
                                    F.lit("Open").alias("status"), F.lit(r.cfg.today).alias("added"))
    state.save_replaced_actions(r.spark, path, r.pacing.quarter_key, "Booking", blank)
    return state.stored(r.spark, path, schema.ACTIONS)


@query("stored_snapshots_captured")
def _stored_snapshots_captured(r: Review) -> DataFrame:
    """U3 + U6 on a stored table: the seed snapshots are saved, the reconstructed Fridays synced, today's
    totals captured; the rows that the table holds afterwards."""
    path = _scratch(r, "snapshots")
    state.save_snapshots(r.spark, path, r.snapshot_seed)
    state.sync_snapshots(r.spark, path, r.hist)
    state.save_snapshots(r.spark, path, reports.tof_snapshot(r))
    return state.stored(r.spark, path, schema.SNAPSHOTS)


@query("snapshot_movement")
def _snapshot_movement(r: Review) -> DataFrame:
    """J8 + K6 for every stored date beside the one before."""
    return state.movement(r.snapshot_store)


@query("history_after_changes")
def _history_after_changes(r: Review) -> DataFrame:
    """J7/A11/U6 from kept sums: the sums of an earlier state of the deals are stored, a feed brings
    them to the present state, and the Fridays are read off. The earlier state, by rule: deals with
    an id of 5 modulo 11 are not there yet, those of 2 modulo 7 have other dates, amounts and outcomes,
    and every deal of 1 modulo 13 has a twin that is deleted since."""
    new, other, twin = F.col("deal_id") % 11 == 5, F.col("deal_id") % 7 == 2, F.col("deal_id") % 13 == 1
    mark = lambda df, name: df.withColumn("change", F.lit(name))
    was = {"create_d": F.date_sub("create_d", 9), "sal_d": F.coalesce(F.date_add("sal_d", 4), F.col("create_d")),
           "close_d": F.date_sub("close_d", 30), "arr_raw": F.lit("77"), "is_won": ~F.col("is_won"),
           "meeting_happened": F.lit("yes"), "pipeline_id": F.when(F.col("deal_id") % 3 == 0, F.lit("renewals")).otherwise("default")}
    before = r.deals.where(other & ~new).withColumns(was)
    twins = r.deals.where(twin).withColumn("deal_id", -F.col("deal_id"))
    earlier = r.deals.where(~new & ~other).unionByName(before).unionByName(twins)
    feed = mark(before, "update_before").unionByName(mark(r.deals.where(other & ~new), "update_after")) \
        .unionByName(mark(r.deals.where(new), "insert")).unionByName(mark(twins, "delete"))
    path = _scratch(r, "events")
    history.save_events(r.spark, path, history.event_sums(earlier, r.cfg))
    history.apply_changes(r.spark, path, feed, r.cfg)
    kept = state.stored(r.spark, path, history.SUMS).where(F.col("quarter") == r.pacing.quarter_key)
    return history.as_of_fridays(kept, r.cfg)


@query("open_pipeline_page")
def _open_pipeline_page(r: Review) -> DataFrame:
    """The full open pipeline written in its order; the third page of 50 rows."""
    path = _scratch(r, "pages")
    paging.write_ordered(to_output(_open_pipeline_full(r)), path, [F.col("acv").desc_nulls_last(), F.col("deal_id")])
    return paging.page(r.spark, path, 2, 50)


# ---- The whole review from two passes over the deals (plans/whole.py) --------------------

@query("whole_tof_review")
def _whole_tof_review(r: Review) -> DataFrame:
    """The top-of-funnel and wins figures in one long table."""
    return whole.sheet(whole.WholeReview(r), whole.TOF_SHEET, OPERATORS)


@query("whole_booking_review")
def _whole_booking_review(r: Review) -> DataFrame:
    """The booking figures in one long table."""
    return whole.sheet(whole.WholeReview(r), whole.BOOKING_SHEET, OPERATORS)


# ---- Composite reports (A13, F26, K1-K9) -----------------------------------------------

for _name in ("exec_summary_tof", "run_rate", "quarter_health", "market_scorecard", "strategic_priorities",
              "strategic_priorities_booking",
              "pipeline_coverage", "exec_forecast", "booking_snapshot", "tof_snapshot", "forecast_movement",
              "decisions"):
    query(_name)(getattr(reports, _name))


def queries() -> dict[str, QueryFn]:
    return dict(REGISTRY)
