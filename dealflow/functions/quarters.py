"""F21 as Column expressions: quarter key, bounds and pacing of any date column.

The driver-side ``pacing()`` turns the as-of parameter into literals; these builders
apply the same calendar rules row-wise (e.g. to bucket events into quarters).
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quarter_key(d: Column) -> Column:
    return F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string"))


def quarter_label(d: Column) -> Column:
    return F.concat(F.lit("Q"), F.quarter(d).cast("string"), F.lit(" "), F.year(d).cast("string"))


def quarter_start(d: Column) -> Column:
    return F.trunc(d, "quarter")


def pacing_columns(d: Column) -> dict[str, Column]:
    qs = quarter_start(d)
    days_in = F.datediff(F.add_months(qs, 3), qs)
    into = F.datediff(d, qs)
    return {
        "quarter_key": quarter_key(d),
        "quarter_start": qs,
        "quarter_label": quarter_label(d),
        "days_in_quarter": days_in,
        "days_into_quarter": into,
        "days_remaining": days_in - into,
        "pct_elapsed": F.round(100 * into / days_in, 1),
    }
