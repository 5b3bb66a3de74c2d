"""Text helpers as native Column expressions (no UDFs).

Number text follows Python's ``format`` (half-even on the binary value); Spark's
``format_number`` rounds the same way, ``format_string`` does not, so only the former is used.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Python's whitespace set (the characters for which ``str.isspace()`` is true), by rule.
PY_WHITESPACE = "".join(ch for ch in map(chr, range(0x110000)) if ch.isspace())


def strip(c: Column) -> Column:
    """Python ``str.strip``: plain ``trim`` removes spaces only; trimming the full whitespace
    set keeps the exact semantics and stays a codegen'd char loop (no regex)."""
    return F.trim(c, F.lit(PY_WHITESPACE))


def fixed(c: Column, decimals: int) -> Column:
    """``f"{v:.{decimals}f}"`` (no thousands separator)."""
    return F.regexp_replace(F.format_number(c, decimals), ",", "")


def grouped(c: Column, decimals: int = 0) -> Column:
    """``f"{v:,.{decimals}f}"`` (with thousands separator)."""
    return F.format_number(c, decimals)


def signed(c: Column, decimals: int) -> Column:
    """``f"{v:+.{decimals}f}"``."""
    s = fixed(c, decimals)
    return F.when(s.startswith("-"), s).otherwise(F.concat(F.lit("+"), s))


def money(c: Column) -> Column:
    """'$1.23M' when |v| >= 1e6, else '$456K'; NULL counts as 0."""
    v = F.coalesce(c.cast("double"), F.lit(0.0))
    return F.when(F.abs(v) >= 1e6, F.concat(F.lit("$"), fixed(v / 1e6, 2), F.lit("M"))) \
            .otherwise(F.concat(F.lit("$"), fixed(v / 1e3, 0), F.lit("K")))


def money_or_dash(c: Column) -> Column:
    """Like ``money`` but a NULL amount prints as an em dash instead of '$nanK'."""
    return F.when(c.isNull(), F.lit("—")).otherwise(money(c))


def title_case(c: Column) -> Column:
    """Python ``str.title``: upper-case every letter that follows a non-letter."""
    chars = F.split(F.lower(c), "")
    return F.array_join(
        F.transform(chars, lambda ch, i: F.when(
            (i == 0) | ~F.element_at(chars, i).rlike(r"^\p{L}$"), F.upper(ch)).otherwise(ch)), "")


def triple(value: Column, wow_pct: Column, att_pct: Column, is_money: bool) -> Column:
    """'78 (+12%, 80%)'; missing parts print '–'; the bare value if both are missing."""
    cur = money(value) if is_money else grouped(value, 0)
    wow = F.coalesce(F.concat(signed(wow_pct, 0), F.lit("%")), F.lit("–"))
    att = F.coalesce(F.concat(fixed(att_pct, 0), F.lit("%")), F.lit("–"))
    return F.when(wow_pct.isNull() & att_pct.isNull(), cur) \
            .otherwise(F.concat(cur, F.lit(" ("), wow, F.lit(", "), att, F.lit(")")))
