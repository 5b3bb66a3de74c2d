"""The open-pipeline scoring chain.

One projection chain of native expressions (whole-stage codegen, no Python) plus two left
joins. The owner side is an aggregate bounded by the number of owners, so AQE turns it into
a broadcast once its measured size is under the threshold and keeps a shuffle join above
it. The sentiment side is one row per deal (as large as the deals at scale): it is
partial-aggregated by deal id, and the join reuses that hash partitioning.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealflow import config as C
from dealflow.config import ReviewConfig
from dealflow.functions import dims, rules


def stage_label(stage_id, cfg: ReviewConfig):
    """stage id -> label (NULL for an unknown id)."""
    m = F.create_map(*[x for k, v in cfg.stage_labels for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(m, stage_id)


def with_stage(open_scan: DataFrame, cfg: ReviewConfig) -> DataFrame:
    return open_scan.withColumn("stage", stage_label(F.col("stage_id"), cfg))


def with_owner(df: DataFrame, owner_dim: DataFrame, missing_pod: str = "Unassigned") -> DataFrame:
    """Owner name and pod per deal; a deal without an owner row is unassigned."""
    j = df.join(owner_dim, "owner_id", "left")
    return j.withColumns({
        "owner_name": F.coalesce(F.col("owner_name"), F.lit("Unassigned")),
        "pod": F.coalesce(F.col("pod"), F.lit(missing_pod)),
    })


def with_sentiment(df: DataFrame, deal_sentiment: DataFrame, key: Column | None = None) -> DataFrame:
    """Sentiment, trend and call count; a deal without calls gets (NULL, NULL, 0). ``key`` is the
    deal's id as text, if a column has it already."""
    s = deal_sentiment.withColumnRenamed("deal_id", "_spoken_of")
    key = F.col("deal_id").cast("string") if key is None else key
    j = df.join(s, key == F.col("_spoken_of"), "left").drop("_spoken_of")
    return j.withColumn("calls", F.coalesce(F.col("calls"), F.lit(0).cast("bigint")))


def forecast_fields(df: DataFrame) -> DataFrame:
    """F5-F8."""
    prob = rules.probability(F.col("prob_raw"))
    return df.withColumns({
        "forecast_cat": rules.forecast_cat(F.col("fcat")),
        "is_forecasted": rules.is_forecasted(F.col("fcat")),
        "fcat_disp": rules.fcat_display(F.col("fcat")),
        "prob": prob,
    }).withColumn("weighted_acv", F.col("acv") * F.col("prob"))


def qualification(df: DataFrame, cfg: ReviewConfig) -> DataFrame:
    """Recency, MEDDPICC elements and score, risk flags, RAG, confidence."""
    d = df.withColumns({
        "days_since_contact": rules.days_since(F.col("last_contact_d"), cfg.today),
        "has_M": rules.has(F.col("m_metrics")),
        "has_E": rules.yes(F.col("e_buyer")),
        "has_D": rules.has(F.col("d_process")),
        "has_I": rules.has(F.col("i_pain")),
        "has_C": rules.has(F.col("c_compet")),
        "has_Champ": rules.yes(F.col("champion")),
    })
    d = d.withColumn("meddpicc", sum(F.col(c).cast("int") for c in ("has_M", "has_E", "has_D", "has_I", "has_C")))
    d = d.withColumns(rules.risk_flag_columns(
        F.col("days_since_contact"), F.col("n_contacts"), F.col("next_step"), F.col("has_E"),
        F.col("stage"), F.col("meddpicc"), cfg))
    d = d.withColumn("risk_count", rules.risk_count())
    d = d.withColumns({
        "risk_flags": rules.risk_flags(),
        "rag": rules.rag(F.col("risk_count"), F.col("meddpicc"), cfg),
        "confidence": rules.confidence(F.col("risk_count"), F.col("meddpicc"),
                                       F.col("days_since_contact"), cfg),
    })
    return d


def recommendations(df: DataFrame, cfg: ReviewConfig) -> DataFrame:
    """F16-F19."""
    return df.withColumns({
        "partner_flag": rules.has(F.col("partner")),
        "action": rules.recommended_action(),
        "rec_category": rules.recommended_category(F.col("forecast_cat"), F.col("rag"),
                                                   F.col("meddpicc"), F.col("risk_count"), cfg),
        "rec_reason": rules.recommended_reason(F.col("rag"), F.col("meddpicc"), cfg),
        "partner_disp": rules.partner_display(F.col("partner"), C.DASH),
    })


def score_open_deals(open_scan: DataFrame, owner_dim: DataFrame, cfg: ReviewConfig) -> DataFrame:
    """The enriched open pipeline without call sentiment: buckets, forecast fields, owner,
    score, flags, RAG, confidence and the recommendation columns, one row per open deal."""
    d = dims.with_buckets(with_stage(open_scan, cfg))
    d = forecast_fields(d)
    d = with_owner(d, owner_dim)
    d = qualification(d, cfg)
    return recommendations(d, cfg)


def finish_scoring(core: DataFrame, deal_sentiment: DataFrame, cfg: ReviewConfig) -> DataFrame:
    """J2 on the scored deals."""
    return with_sentiment(core, deal_sentiment)


def flags_text() -> F.Column:
    """Risk flags as one comma-separated text ('—' when none), for reports and the oracle."""
    return rules.flags_text()
