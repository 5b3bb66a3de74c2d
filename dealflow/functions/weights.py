"""Counts over rows that stand for one deal each, or over cells that stand for ``n`` deals.

The review's aggregates run on both: rows have no column ``n``; a cell's amounts are sums already."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tally(df: DataFrame, holds: Column | str | None = None) -> Column:
    """Number of deals, or of those for which ``holds`` is true."""
    holds = F.col(holds) if isinstance(holds, str) else holds
    if "n" not in df.columns:
        return F.count(F.lit(1)) if holds is None else F.count_if(holds)
    return F.coalesce(F.sum(F.col("n") if holds is None else F.when(holds, F.col("n"))), F.lit(0))


def mean(df: DataFrame, column: str) -> Column:
    """Mean of a column that is never NULL."""
    return F.avg(column) if "n" not in df.columns else F.sum(column) / F.nullif(F.sum("n"), F.lit(0))
