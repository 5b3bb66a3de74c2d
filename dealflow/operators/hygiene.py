"""The hygiene filter applied to every deal scan and the population predicates.

All of them are plain Column predicates over scan columns, so Catalyst pushes the
comparisons into the Parquet scan (``PushedFilters``) and prunes the read schema.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from dealflow.config import ReviewConfig


def hygiene(cfg: ReviewConfig) -> Column:
    """Sales pipeline only; no test deals (a NULL name is dropped, as by SQL NOT IN);
    no migration sources; machine-made sources only when a discovery call exists."""
    detail = F.lower(F.coalesce(F.col("source_detail"), F.lit("")))
    label = F.coalesce(F.col("source_label"), F.lit(""))
    conds = [
        F.col("pipeline_id") == cfg.pipeline_id,
        ~F.col("dealname").isin(*cfg.test_deal_names),
        *[~detail.contains(s) for s in cfg.excluded_source_substrings],
        ~label.isin(*cfg.machine_source_labels) | F.col("disco_d").isNotNull(),
    ]
    return reduce(lambda a, b: a & b, conds)


def in_range(d: Column, start, end) -> Column:
    """NULL-safe ``d BETWEEN start AND end`` (a NULL date is simply false)."""
    return F.coalesce(d.between(F.lit(start), F.lit(end)), F.lit(False))


def touches_quarter(qs, today) -> Column:
    """Created, discovered or SAL'd in [qs, today], or won with close in range.
    Plain range predicates (a NULL drops the row in a filter just as FALSE does), so the
    OR of ranges is pushed into the Parquet scan and prunes row groups by date statistics."""
    def rng(c: str) -> Column:
        return F.col(c).between(F.lit(qs), F.lit(today))
    return (rng("create_d") | rng("disco_d") | rng("sal_d")
            | ((F.col("is_won") == F.lit(True)) & rng("close_d")))


def is_open(cfg: ReviewConfig) -> Column:
    """Not closed (NULL dropped) and in a stage beyond SQL."""
    return (F.col("is_closed") == F.lit(False)) & F.col("stage_id").isin(*cfg.open_stage_ids)


def won_between(qs, today) -> Column:
    """Won (TRUE only) with close date in [qs, today]."""
    return (F.col("is_won") == F.lit(True)) & F.col("close_d").between(F.lit(qs), F.lit(today))
