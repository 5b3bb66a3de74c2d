"""Forecast fields, qualification score, risk flags, RAG, confidence and the
recommendation texts, each a native Column builder (no UDF, stays in whole-stage codegen)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dealflow import config as C
from dealflow.functions.text import strip, title_case


PROBABILITY = "decimal(26,12)"


def yes(v: Column) -> Column:
    """trimmed lower-case text in the yes-words; NULL is false."""
    return F.coalesce(F.lower(strip(v)).isin(*C.YES_WORDS), F.lit(False))


def has(v: Column) -> Column:
    """trimmed text not in the case-sensitive blank spellings; NULL is false."""
    return F.coalesce(~strip(v).isin(*C.HAS_BLANKS), F.lit(False))


def _chain(cases, otherwise) -> Column:
    """``CASE WHEN c1 THEN v1 WHEN c2 THEN v2 ... ELSE otherwise END`` from (cond, value) pairs."""
    (c0, v0), *rest = cases
    out = F.when(c0, v0)
    for c, v in rest:
        out = out.when(c, v)
    return out.otherwise(otherwise)


def forecast_cat(fcat: Column) -> Column:
    """rep category -> Commit / Best Case / Pipeline / Not Forecasted."""
    return _chain([(fcat == raw, label) for raw, label in C.FORECAST_CATEGORY_MAP.items()],
                  C.NOT_FORECASTED)


def is_forecasted(fcat: Column) -> Column:
    """F6."""
    return F.coalesce(fcat.isin(*C.FORECASTED_RAW), F.lit(False))


def fcat_display(fcat: Column) -> Column:
    """blank -> Uncategorized; mapped label; else Python-style title case of the raw value."""
    out = F.when(fcat.isNull() | (strip(fcat) == ""), C.UNCATEGORIZED)
    for raw, label in C.FORECAST_CATEGORY_MAP.items():
        out = out.when(fcat == raw, label)
    return out.otherwise(title_case(fcat))


def number(raw: Column, kind: str) -> Column:
    """Lenient number: text that is no number, and a number that ``kind`` cannot hold, is NULL; for a
    double that is an infinite one. ``reject_reason`` tells the two apart."""
    value = raw.try_cast(kind)
    return F.when(F.abs(value) < float("inf"), value) if kind == "double" else value


def reject_reason(raw: Column, kind: str) -> Column:
    """Why ``number`` drops a value: 'no_number' or 'does_not_fit' ``kind``; NULL for a value that it keeps and
    for an absent or blank one."""
    size = F.abs(raw.try_cast("double"))
    text = raw.cast("string")
    kept = number(raw, kind).isNotNull() | text.isNull() | (strip(text) == "")
    return F.when(~kept, F.when(size <= float("inf"), "does_not_fit").otherwise("no_number"))


def probability(prob_raw: Column) -> Column:
    """F8: lenient number; bad/NULL -> 0; values above 1 are percentages. Exact decimal of 12
    places; 10^14 and more counts as bad."""
    p = F.coalesce(number(prob_raw, PROBABILITY), F.lit(0).cast(PROBABILITY))
    return F.when(p <= 1, p).otherwise((p / 100).cast(PROBABILITY))


def days_since(last_contact_d: Column, today) -> Column:
    """F9."""
    return F.datediff(F.lit(today), last_contact_d)


# Flag columns in flag order: (column name, flag text).
FLAG_COLUMNS = (("f_stale", C.FLAG_STALE), ("f_single", C.FLAG_SINGLE), ("f_no_next", C.FLAG_NO_NEXT),
                ("f_no_eb", C.FLAG_NO_EB), ("f_late", C.FLAG_LATE_WEAK))
_FLAG_COL = {text: name for name, text in FLAG_COLUMNS}
_SEP = "\u0001"


def risk_flag_columns(days: Column, n_contacts: Column, next_step: Column, has_e: Column,
                      stage: Column, score: Column, cfg: C.ReviewConfig) -> dict[str, Column]:
    """F13 as five boolean columns (plain predicates, no arrays in the hot path);
    ``has_e`` is the already-computed economic-buyer test (F10 of e_buyer)."""
    stale = (days > cfg.stale_days)
    if cfg.null_contact_is_stale:
        stale = days.isNull() | stale
    return {
        "f_stale": F.coalesce(stale, F.lit(False)),
        "f_single": n_contacts.isNull() | (n_contacts <= 1),
        "f_no_next": ~has(next_step),
        "f_no_eb": ~has_e,
        "f_late": F.coalesce(stage.isin(*C.LATE_STAGES) & (score < cfg.min_score), F.lit(False)),
    }


def flag(text: str) -> Column:
    return F.col(_FLAG_COL[text])


def risk_count() -> Column:
    return sum(F.col(name).cast("int") for name, _ in FLAG_COLUMNS)


def risk_flags() -> Column:
    """F13 as the ordered array of flag texts (built only where a query reads it)."""
    joined = F.concat_ws(_SEP, *[F.when(F.col(n), F.lit(t)) for n, t in FLAG_COLUMNS])
    return F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(joined, _SEP))


def flags_text() -> Column:
    """Flags joined by ', ' ('—' when none), for reports."""
    joined = F.concat_ws(", ", *[F.when(F.col(n), F.lit(t)) for n, t in FLAG_COLUMNS])
    return F.when(joined == "", F.lit(C.DASH)).otherwise(joined)


def first_flag() -> Column:
    """Text of the first raised flag in flag order (NULL when none)."""
    return _chain([(F.col(n), F.lit(t)) for n, t in FLAG_COLUMNS], F.lit(None).cast("string"))


def rag(count: Column, score: Column, cfg: C.ReviewConfig) -> Column:
    """F14."""
    return (F.when((count >= 3) | flag(C.FLAG_STALE), "Red")
            .when((count == 2) | (score < cfg.min_score), "Yellow")
            .otherwise("Green"))


def confidence(count: Column, score: Column, days: Column, cfg: C.ReviewConfig) -> Column:
    """100 - 15/flag - 5/missing score point - 10 if silent > 30 days, in 5..100."""
    s = (F.lit(100) - count * 15 - F.greatest(F.lit(0), 5 - score) * 5
         - F.when(F.coalesce(days > cfg.long_silence_days, F.lit(False)), 10).otherwise(0))
    return F.greatest(F.lit(5), F.least(F.lit(100), s))


def recommended_category(cat: Column, rag_c: Column, score: Column, count: Column,
                         cfg: C.ReviewConfig) -> Column:
    """F16: first matching rule wins."""
    red = rag_c == "Red"
    return (F.when((cat == "Commit") & (red | (score < cfg.min_score) | flag(C.FLAG_STALE)),
                   C.REC_DOWN_TO_BEST)
            .when((cat == "Best Case") & red, C.REC_DOWN_TO_PIPELINE)
            .when(cat.isin("Pipeline", C.NOT_FORECASTED) & (rag_c == "Green")
                  & (score >= cfg.upgrade_score), C.REC_UPGRADE)
            .when(cat.isin("Pipeline", "Best Case", "Commit") & red & (score <= cfg.remove_score),
                  C.REC_REMOVE)
            .when(count >= 3, C.REC_ESCALATE)
            .otherwise(C.REC_KEEP))


def recommended_reason(rag_c: Column, score: Column, cfg: C.ReviewConfig) -> Column:
    """comma list of evidence; 'clean evidence' for a clean Green; else an em dash."""
    bits = F.concat_ws(
        ", ",
        F.when(score < cfg.min_score, F.concat(F.lit("MEDDPICC "), score.cast("string"), F.lit("/5"))),
        F.when(flag(C.FLAG_STALE), C.REASON_STALE),
        F.when(flag(C.FLAG_NO_EB), C.REASON_NO_EB),
        F.when(flag(C.FLAG_SINGLE), C.REASON_SINGLE),
        F.when(flag(C.FLAG_NO_NEXT), C.REASON_NO_NEXT))
    return (F.when(bits != "", bits)
            .when(rag_c == "Green", C.REASON_CLEAN)
            .otherwise(C.DASH))


def recommended_action() -> Column:
    """action of the highest-priority flag present (priority differs from flag order)."""
    return _chain([(flag(f), C.ACTION_TEXT[f]) for f in C.ACTION_PRIORITY], C.ACTION_ON_TRACK)


def support_ask(first: Column) -> Column:
    """Executive-support ask named by the first flag of a pod's biggest risk."""
    return _chain([(first.isNull(), F.lit(C.SUPPORT_NONE))]
                  + [(first == f, F.lit(text)) for f, text in C.SUPPORT_TEXT.items()], F.lit("Deal inspection"))


def partner_display(partner: Column, fallback: str) -> Column:
    """partner name when present, else the fallback ('—' open, 'Direct' won)."""
    return F.when(has(partner), partner).otherwise(fallback)
