"""Market, GTM engine and product bucketing as native Column expressions."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealflow import config as C
from dealflow.functions.text import PY_WHITESPACE, strip

# Regex class of exactly Python's whitespace characters.
_WS = "[" + "".join(f"\\u{ord(ch):04x}" for ch in PY_WHITESPACE) + "]"


def eco_label(erp: Column) -> Column:
    """ERP value -> ecosystem (case-sensitive; NULL -> Broad Market)."""
    return (F.when(erp == C.ERP_EXACT_NETSUITE, C.ECO_NETSUITE)
            .when(erp == C.ERP_EXACT_SAGE, C.ECO_SAGE)
            .when(erp.contains(C.ERP_CONTAINS_DYNAMICS), C.ECO_DYNAMICS)
            .when(erp == C.ERP_EXACT_ACUMATICA, C.ECO_ACUMATICA)
            .otherwise(C.ECO_BROAD))


def market_of_eco(eco: Column) -> Column:
    """the primary markets pass, everything else is Other."""
    return F.when(eco.isin(*C.PRIMARY_MARKETS), eco).otherwise(C.OTHER_MARKET)


def market(erp_raw: Column) -> Column:
    return market_of_eco(eco_label(erp_raw))


def gtm_key(src: Column) -> Column:
    """Lower-cased lead source (NULL -> ''), the input of the GTM substring tests."""
    return F.lower(F.coalesce(src, F.lit("")))


def gtm_of_key(s: Column) -> Column:
    """F3 over ``gtm_key``: whole-value missing spellings -> Other, then ordered substring
    tests, first hit wins."""
    out = F.when(s.isin(*C.MISSING_WORDS), C.OTHER_MARKET)
    for engine, words in C.GTM_KEYWORDS:
        out = out.when(reduce(lambda a, b: a | b, [s.contains(w) for w in words]), engine)
    return out.otherwise("Other")


def gtm(src: Column) -> Column:
    """lead source -> GTM engine (use ``with_buckets`` on frames so the key is computed once)."""
    return gtm_of_key(gtm_key(src))


def product_key(use_case: Column) -> Column:
    """The use-case parts as one text ',P1,P2,' (split on ',' or ';', stripped, upper-cased),
    or NULL when the value is empty or a missing spelling (-> Unknown). A part P is present
    iff ',P,' occurs, so no array is built."""
    s = F.coalesce(use_case, F.lit(""))
    u = F.regexp_replace(F.upper(s), f"{_WS}*[,;]{_WS}*", ",")
    return F.when((s == "") | F.lower(strip(s)).isin(*C.MISSING_WORDS), F.lit(None).cast("string")) \
            .otherwise(F.concat(F.lit(","), strip(u), F.lit(",")))


def product_of_key(t: Column) -> Column:
    """F4 over ``product_key``: AR and AP-like parts -> Multi-Product; AR; AP; else Other."""
    def part(p: str) -> Column:
        return t.contains(f",{p},")
    has_ar = part(C.PRODUCT_AR)
    has_ap = reduce(lambda a, b: a | b, [part(p) for p in C.PRODUCT_AP_PARTS])
    return (F.when(t.isNull(), "Unknown")
            .when(has_ar & has_ap, "Multi-Product")
            .when(has_ar, "AR")
            .when(has_ap, "AP")
            .otherwise("Other"))


def product(use_case: Column) -> Column:
    """use case -> AR / AP / Multi-Product / Other / Unknown (order-independent parts)."""
    return product_of_key(product_key(use_case))


def with_buckets(df: DataFrame, erp: str | None = "erp_raw", gtm_src: str | None = "gtm_raw",
                 use_case: str | None = "use_case", eco: str | None = None) -> DataFrame:
    """Add market / gtm / product columns. The normalised keys are projected first, so each
    is computed once per row (a key used in several CASE branches is not re-evaluated)."""
    keys = {}
    if gtm_src:
        keys["_gtm_key"] = gtm_key(F.col(gtm_src))
    if use_case:
        keys["_product_key"] = product_key(F.col(use_case))
    out = df.withColumns(keys) if keys else df
    cols = {}
    if eco:
        cols["market"] = market_of_eco(F.col(eco))
    elif erp:
        cols["market"] = market(F.col(erp))
    if gtm_src:
        cols["gtm"] = gtm_of_key(F.col("_gtm_key"))
    if use_case:
        cols["product"] = product_of_key(F.col("_product_key"))
    return out.withColumns(cols).drop(*keys)
