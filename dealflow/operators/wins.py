"""S3 enrichment and A20-A23: the quarter's closed-won cohort and its views."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealflow.config import ReviewConfig
from dealflow.functions import dims, rules
from dealflow.functions.weights import tally
from dealflow.operators.forecast import with_share


def closed_won(won_scan: DataFrame, owner_dim: DataFrame) -> DataFrame:
    """Wins with market, product, owner name ('Unassigned' when unknown), partner or
    'Direct', and money filled with 0."""
    j = won_scan.join(owner_dim.select("owner_id", "owner_name"), "owner_id", "left")
    return dims.with_buckets(j, gtm_src=None).withColumns({
        "owner_name": F.coalesce(F.col("owner_name"), F.lit("Unassigned")),
        "partner_disp": rules.partner_display(F.col("partner"), "Direct"),
        "arr": F.coalesce(F.col("arr"), F.lit(0).cast("decimal(18,2)")),
        "acv": F.coalesce(F.col("acv"), F.lit(0).cast("decimal(18,2)")),
    })


def wins_kpis(won: DataFrame) -> DataFrame:
    """Count, total ACV and ARR, mean ACV, mean days to close ignoring NULL and 0."""
    days = F.nullif(F.col("days_to_close"), F.lit(0.0))
    if "n" in won.columns:  # cells: the days and the number of deals that have any
        cycle = F.sum("days_to_close") / F.nullif(F.sum("n_days"), F.lit(0))
    else:
        cycle = F.avg(days)
    return won.agg(
        tally(won).alias("wins"),
        F.coalesce(F.sum("acv"), F.lit(0)).alias("total_acv"),
        F.coalesce(F.sum("arr"), F.lit(0)).alias("total_arr"),
        F.round(F.sum("acv").cast("double") / F.nullif(tally(won), F.lit(0)), 6).alias("avg_acv"),
        F.round(cycle, 6).alias("avg_cycle_days"))


def wins_by(won: DataFrame, dim: str) -> DataFrame:
    """Won ACV per dimension value."""
    return won.groupBy(dim).agg(F.sum("acv").alias("acv"))


def wins_by_product(won: DataFrame) -> DataFrame:
    """Won ACV mix by product."""
    return with_share(wins_by(won, "product"), "acv")


def wins_by_partner(won: DataFrame, cfg: ReviewConfig) -> DataFrame:
    """Won ACV by partner or 'Direct', the top 8."""
    return wins_by(won, "partner_disp").orderBy(F.col("acv").desc(), F.col("partner_disp")) \
                                       .limit(cfg.top_partners)
