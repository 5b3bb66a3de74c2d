"""Rule tables: literal rows covering each branch and the NULL / text traps."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from dealflow import config as C
from dealflow.config import ReviewConfig
from dealflow.functions import dims, rules, text
from dealflow.functions.pacing import pacing

CFG = ReviewConfig()


def col_values(spark, values, fn, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_eco_and_market(spark):
    vals = ["Netsuite", "Sage Intacct", "Microsoft Dynamics 365", "Acumatica", "netsuite", None, "", "X"]
    assert col_values(spark, vals, dims.eco_label) == [
        "NetSuite", "Sage", "Dynamics", "Acumatica", "Broad Market", "Broad Market", "Broad Market", "Broad Market"]
    assert col_values(spark, vals, dims.market) == [
        "NetSuite", "Sage", "Dynamics", "Other", "Other", "Other", "Other", "Other"]


def test_gtm_buckets(spark):
    vals = ["Channel Partner", "Inbound Web", "SDR Outbound", "Account Exec", "Various", "Michael",
            "Webinar", "CS", None, "", " \t", "nan", "<NA>", "NaT", "None", "Referral"]
    assert col_values(spark, vals, dims.gtm) == [
        "Channels", "Marketing", "BDR", "AE", "Channels", "AE", "Marketing", "Other", "Other", "Other",
        "Other", "Other", "Other", "Other", "Other", "Channels"]


def test_product_buckets(spark):
    vals = ["AR", "AP", "AR;AP", "Expense Management", "Corporate Cards, ar", "FX", "  ", "nan", None,
            " ar , ap ", "AP;AR", "", " \t", "<NA>", "ar,,", "Expense  Management", "x　,　AR"]
    assert col_values(spark, vals, dims.product) == [
        "AR", "AP", "Multi-Product", "AP", "Multi-Product", "Other", "Other", "Unknown", "Unknown",
        "Multi-Product", "Multi-Product", "Unknown", "Other", "Unknown", "AR", "Other", "AR"]


def test_yes_has(spark):
    vals = ["Yes", " yes ", "TRUE", "1", "won", "identified", "No", "no", "False", "false", "FALSE",
            "None", "nan", "", " \t", None, "x"]
    assert col_values(spark, vals, rules.yes) == [
        True, True, True, True, True, True, False, False, False, False, False, False, False, False, False,
        False, False]
    assert col_values(spark, vals, rules.has) == [
        True, True, True, True, True, True, False, True, True, False, False, False, False, False, False,
        False, True]


def test_forecast_fields(spark):
    vals = ["COMMIT", "BEST_CASE", "PIPELINE", "OMIT", "", "  ", "CLOSED_WON", None, "commit", "x1y_z"]
    assert col_values(spark, vals, rules.forecast_cat) == [
        "Commit", "Best Case", "Pipeline", "Not Forecasted", "Not Forecasted", "Not Forecasted",
        "Not Forecasted", "Not Forecasted", "Not Forecasted", "Not Forecasted"]
    assert col_values(spark, vals, rules.is_forecasted) == [
        True, True, True, False, False, False, False, False, False, False]
    # Python str.title semantics, not initcap
    assert col_values(spark, vals, rules.fcat_display) == [
        "Commit", "Best Case", "Pipeline", "Not Forecasted", "Uncategorized", "Uncategorized", "Closed_Won",
        "Uncategorized", "Commit", "X1Y_Z"]


def test_probability(spark):
    vals = ["0.2", "60", "1", "1.0", "1.01", "100", "bad", "nan", None]
    got = [float(x) for x in col_values(spark, vals, rules.probability)]
    assert got == [0.2, 0.6, 1.0, 1.0, 0.0101, 1.0, 0.0, 0.0, 0.0]
    vals = ["33.33333333", "0.123456789", "5000000", "99999999999999"]
    assert [float(x) for x in col_values(spark, vals, rules.probability)] == [
        0.3333333333, 0.123456789, 50000.0, 999999999999.99]


def test_numbers_that_do_not_fit_are_null_and_named(spark):
    fit, text_, none = "does_not_fit", "no_number", None
    cases = {
        "decimal(18,2)": [("9999999999999999.99", none), ("n/a", text_), ("", none), (None, none), (" \t", none), ("nan", text_),
                          ("1e16", fit), ("-1e20", fit), ("Infinity", fit), ("-inf", fit), ("12", none), ("1,5", text_)],
        "decimal(26,12)": [("1e30", fit), ("0.5", none), ("99999999999999", none), ("100000000000000", fit)],
        "double": [("1e308", none), ("Infinity", fit), ("1e999", fit), ("NaN", text_), ("x", text_), ("7", none)],
        "bigint": [("3", none), ("99999999999999999999", fit), ("many", text_)]}
    for kind, values in cases.items():
        raws = [v for v, _ in values]
        reasons = col_values(spark, raws, lambda c: rules.reject_reason(c, kind))
        assert reasons == [r for _, r in values], kind
        kept = col_values(spark, raws, lambda c: rules.number(c, kind))
        for raw, reason, value in zip(raws, reasons, kept, strict=True):
            assert (value is not None) == (reason is None and bool((raw or "").strip())), (kind, raw)


def test_strip_is_python_strip(spark):
    vals = [" a ", "\t\na\x1c", "　a ", None, "  "]
    assert col_values(spark, vals, text.strip) == [v.strip() if v is not None else None for v in vals]


def test_money_and_number_text(spark):
    vals = [0.0, 499.0, 500.0, 1500.0, 2500.0, 999_499.0, 1_234_567.0, 1_005_000.0, -5000.0, 2.5e9]
    expect = ["$0K", "$0K", "$0K", "$2K", "$2K", "$999K", "$1.23M", "$1.00M", "$-5K", "$2500.00M"]
    assert col_values(spark, vals, text.money, "double") == expect
    signed_vals = [12.5, -0.4, 0.5, 1.5, -69.04, 0.0]
    assert col_values(spark, signed_vals, lambda c: text.signed(c, 0), "double") == [f"{v:+.0f}" for v in signed_vals]
    assert col_values(spark, [1234567.5, 0.5, 2.5], lambda c: text.grouped(c, 0), "double") == \
        [f"{v:,.0f}" for v in (1234567.5, 0.5, 2.5)]


def test_triple(spark):
    df = spark.createDataFrame(
        [(78.0, 12.0, 80.0), (78.0, None, None), (1500.0, None, 33.4), (2.5e6, -8.0, None)],
        "v double, w double, a double")
    got = [r[0] for r in df.select(text.triple(F.col("v"), F.col("w"), F.col("a"), False)).collect()]
    assert got == ["78 (+12%, 80%)", "78", "1,500 (–, 33%)", "2,500,000 (-8%, –)"]
    got = [r[0] for r in df.select(text.triple(F.col("v"), F.col("w"), F.col("a"), True)).collect()]
    assert got == ["$0K (+12%, 80%)", "$0K", "$2K (–, 33%)", "$2.50M (-8%, –)"]


def _score_row(spark, days, n_contacts, next_step, e_buyer, stage, score):
    df = spark.createDataFrame([(days, n_contacts, next_step, stage, score, e_buyer)],
                               "days int, n bigint, ns string, stage string, score int, eb string")
    d = df.withColumn("has_e", rules.yes(F.col("eb")))
    d = d.withColumns(rules.risk_flag_columns(F.col("days"), F.col("n"), F.col("ns"), F.col("has_e"),
                                              F.col("stage"), F.col("score"), CFG))
    d = d.withColumn("cnt", rules.risk_count())
    d = d.select(rules.risk_flags().alias("flags"), "cnt",
                 rules.rag(F.col("cnt"), F.col("score"), CFG).alias("rag"),
                 rules.confidence(F.col("cnt"), F.col("score"), F.col("days"), CFG).alias("conf"),
                 rules.recommended_action().alias("action"),
                 rules.first_flag().alias("first"))
    return d.collect()[0]


@pytest.mark.parametrize("days,stale", [(0, False), (14, False), (15, True), (30, True), (31, True), (None, True)])
def test_stale_flag_boundaries(spark, days, stale):
    r = _score_row(spark, days, 2, "Send quote", "Yes", C.STAGE_SAL, 5)
    assert (C.FLAG_STALE in r.flags) == stale


def test_flags_rag_confidence(spark):
    # clean deal
    r = _score_row(spark, 3, 2, "Send quote", "Yes", C.STAGE_SAL, 5)
    assert list(r.flags) == [] and r.rag == "Green" and r.conf == 100 and r.action == C.ACTION_ON_TRACK
    # exactly two flags (single-threaded + no next step), score 4 -> Yellow; 100-30-5 = 65
    r = _score_row(spark, 3, 1, "No", "Yes", C.STAGE_SAL, 4)
    assert list(r.flags) == [C.FLAG_SINGLE, C.FLAG_NO_NEXT] and r.rag == "Yellow" and r.conf == 65
    assert r.action == ACTION(C.FLAG_SINGLE) and r.first == C.FLAG_SINGLE
    # three flags -> Red; late stage with weak score flagged; silence > 30 costs 10; floor at 5
    r = _score_row(spark, 45, None, None, None, C.STAGE_NEGOTIATION, 0)
    assert list(r.flags) == list(C.FLAG_ORDER) and r.rag == "Red" and r.conf == 5
    assert r.action == ACTION(C.FLAG_STALE)
    # score 2 alone -> Yellow; NULL contact count is single-threaded
    r = _score_row(spark, 1, None, "x", "identified", C.STAGE_SAL, 2)
    assert list(r.flags) == [C.FLAG_SINGLE] and r.rag == "Yellow" and r.conf == 100 - 15 - 15


def ACTION(flag):
    return C.ACTION_TEXT[flag]


@pytest.mark.parametrize("cat,rag,score,cnt,stale,expect", [
    ("Commit", "Red", 4, 3, True, C.REC_DOWN_TO_BEST),
    ("Commit", "Green", 2, 0, False, C.REC_DOWN_TO_BEST),
    ("Commit", "Green", 5, 0, False, C.REC_KEEP),
    ("Best Case", "Red", 1, 3, False, C.REC_DOWN_TO_PIPELINE),
    ("Pipeline", "Green", 4, 0, False, C.REC_UPGRADE),
    ("Not Forecasted", "Green", 4, 0, False, C.REC_UPGRADE),
    ("Pipeline", "Green", 3, 0, False, C.REC_KEEP),
    ("Pipeline", "Red", 1, 3, False, C.REC_REMOVE),
    ("Pipeline", "Red", 2, 3, False, C.REC_ESCALATE),
    ("Not Forecasted", "Red", 0, 4, True, C.REC_ESCALATE),
    ("Not Forecasted", "Yellow", 3, 2, False, C.REC_KEEP),
])
def test_recommended_category(spark, cat, rag, score, cnt, stale, expect):
    df = spark.createDataFrame([(cat, rag, score, cnt, stale)], "cat string, rag string, score int, cnt int, f_stale boolean")
    got = df.select(rules.recommended_category(F.col("cat"), F.col("rag"), F.col("score"), F.col("cnt"), CFG)).first()[0]
    assert got == expect


def test_recommended_reason(spark):
    rows = [("Green", 5, False, False, False, False), ("Green", 2, False, False, False, False),
            ("Red", 1, True, True, True, True), ("Yellow", 3, False, False, True, False)]
    df = spark.createDataFrame(rows, "rag string, score int, f_stale boolean, f_no_eb boolean, "
                                     "f_single boolean, f_no_next boolean")
    got = [r[0] for r in df.select(rules.recommended_reason(F.col("rag"), F.col("score"), CFG)).collect()]
    assert got == [C.REASON_CLEAN, "MEDDPICC 2/5",
                   "MEDDPICC 1/5, stale 14d+, no EB, single-threaded, no next step", "single-threaded"]


@pytest.mark.parametrize("today,key,start,days_in,into,pct", [
    (dt.date(1998, 8, 19), "1998Q3", dt.date(1998, 7, 1), 92, 49, 53.3),
    (dt.date(2026, 4, 1), "2026Q2", dt.date(2026, 4, 1), 91, 0, 0.0),
    (dt.date(2026, 6, 30), "2026Q2", dt.date(2026, 4, 1), 91, 90, 98.9),
    (dt.date(2025, 12, 31), "2025Q4", dt.date(2025, 10, 1), 92, 91, 98.9),
    (dt.date(2024, 2, 29), "2024Q1", dt.date(2024, 1, 1), 91, 59, 64.8),
])
def test_pacing(today, key, start, days_in, into, pct):
    p = pacing(today)
    assert (p.quarter_key, p.quarter_start, p.days_in_quarter, p.days_into_quarter, p.pct_elapsed) == \
        (key, start, days_in, into, pct)
    assert p.first_friday.weekday() == 4 and 0 <= (p.first_friday - p.quarter_start).days < 7
    assert p.week_end.weekday() == 6 and p.week_start.weekday() == 0
