"""DuckDB oracle SQL. Dates of the review: as-of 1998-08-19 (a Wednesday), quarter
1998-07-01..1998-09-30, this week from Monday 1998-08-17, last week 1998-08-10..1998-08-16,
week end Sunday 1998-08-23, month end 1998-08-31, quarter key 1998Q3."""
from __future__ import annotations

from dealflow.plans.whole import BOOKING_SHEET, TOF_SHEET

TODAY = "DATE '1998-08-19'"
QS = "DATE '1998-07-01'"
QE = "DATE '1998-09-30'"

# Shared CTEs: the deal table derived from the test tables, hygiene, quarter base and flags.
PRELUDE = f"""
WITH deals AS (
  SELECT
    o.o_orderkey AS deal_id,
    CASE WHEN o.o_orderkey % 1009 = 0 THEN 'Test Deal A' ELSE 'Deal ' || CAST(o.o_orderkey AS VARCHAR) END AS dealname,
    CASE WHEN o.o_orderkey % 41 = 0 THEN 'renewals' ELSE 'default' END AS pipeline_id,
    CASE o.o_orderkey % 59 WHEN 0 THEN 'LegacyApp sync' WHEN 1 THEN 'Bulk Data load' WHEN 2 THEN 'Web form' END AS source_detail,
    CASE WHEN o.o_orderkey % 53 < 6 THEN 'IMPORT' WHEN o.o_orderkey % 53 < 9 THEN 'INTEGRATION'
         WHEN o.o_orderkey % 53 < 45 THEN 'CRM_UI' END AS source_label,
    CASE WHEN o.o_orderkey % 67 = 0 THEN NULL ELSE CAST(o.o_custkey % 31 AS VARCHAR) END AS owner_id,
    CASE c.c_mktsegment WHEN 'MACHINERY' THEN 'Netsuite' WHEN 'BUILDING' THEN 'Sage Intacct'
         WHEN 'AUTOMOBILE' THEN 'Microsoft Dynamics 365' WHEN 'FURNITURE' THEN 'Acumatica' END AS erp_raw,
    CASE left(o.o_orderpriority, 1) WHEN '1' THEN 'Channel Partner' WHEN '2' THEN 'Inbound Web'
         WHEN '3' THEN 'SDR Outbound' WHEN '4' THEN 'Account Exec' END AS gtm_raw,
    CASE o.o_orderkey % 9 WHEN 0 THEN 'AR' WHEN 1 THEN 'AP' WHEN 2 THEN 'AR;AP' WHEN 3 THEN 'Expense Management'
         WHEN 4 THEN 'Corporate Cards, ar' WHEN 5 THEN 'FX' WHEN 6 THEN '  ' WHEN 7 THEN 'nan' END AS use_case,
    CASE WHEN o.o_orderkey % 47 = 0 THEN 'n/a' WHEN o.o_orderkey % 47 = 1 THEN NULL
         ELSE CAST(CAST(floor(o.o_totalprice / 10) AS BIGINT) AS VARCHAR) END AS arr_raw,
    CASE WHEN o.o_orderkey % 71 = 0 THEN NULL ELSE CAST(CAST(o.o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS acv_raw,
    CAST(CAST(floor(o.o_totalprice / 10) AS BIGINT) + o.o_orderkey % 100 AS VARCHAR) AS total_arr_raw,
    CAST(o.o_orderdate AS DATE) AS create_d,
    CASE WHEN o.o_orderkey % 5 = 0 THEN NULL
         ELSE CAST(o.o_orderdate AS DATE) + CAST(o.o_orderkey % 20 AS INTEGER) END AS disco_d,
    CASE WHEN o.o_orderkey % 61 < 30 THEN 'Yes' WHEN o.o_orderkey % 61 < 35 THEN ' YES '
         WHEN o.o_orderkey % 61 < 50 THEN 'No' END AS meeting_happened,
    CASE WHEN o.o_orderkey % 3 = 0 THEN NULL
         ELSE CAST(o.o_orderdate AS DATE) + CAST(20 + o.o_orderkey % 30 AS INTEGER) END AS sal_d,
    CASE WHEN o.o_orderstatus = 'F' THEN CAST(o.o_orderdate AS DATE) + CAST(45 + o.o_orderkey % 45 AS INTEGER)
         WHEN o.o_orderkey % 73 = 0 THEN NULL
         ELSE {TODAY} + CAST(o.o_orderkey % 120 - 20 AS INTEGER) END AS close_d,
    CASE WHEN o.o_orderkey % 79 = 0 THEN NULL ELSE o.o_orderstatus = 'F' END AS is_closed,
    CASE WHEN o.o_orderkey % 83 = 0 THEN NULL ELSE (o.o_orderstatus = 'F' AND o.o_orderkey % 2 = 0) END AS is_won,
    CASE o.o_orderkey % 4 WHEN 0 THEN 's_sql' WHEN 1 THEN 's_sal' WHEN 2 THEN 's_prop' ELSE 's_neg' END AS stage_id,
    CASE o.o_orderkey % 7 WHEN 0 THEN 'COMMIT' WHEN 1 THEN 'BEST_CASE' WHEN 2 THEN 'PIPELINE' WHEN 3 THEN 'OMIT'
         WHEN 4 THEN '' WHEN 5 THEN 'CLOSED_WON' END AS fcat,
    CASE (o.o_orderkey % 43) % 5 WHEN 1 THEN '0.2' WHEN 2 THEN '60' WHEN 3 THEN '1' WHEN 4 THEN 'bad' END AS prob_raw,
    CAST(CASE WHEN o.o_orderkey % 13 = 12 THEN NULL ELSE (o.o_orderkey % 13) % 4 END AS BIGINT) AS n_contacts,
    CASE WHEN o.o_orderkey % 11 < 8 THEN 'Send quote' WHEN o.o_orderkey % 11 = 8 THEN 'No'
         WHEN o.o_orderkey % 11 = 9 THEN '' END AS next_step,
    CASE WHEN o.o_orderkey % 37 = 0 THEN NULL
         ELSE {TODAY} - CAST(((o.o_orderkey % 37) % 30) * ((o.o_orderkey % 37) % 3) AS INTEGER) END AS last_contact_d,
    CASE (o.o_orderkey % 31) % 4 WHEN 0 THEN 'Partner A' WHEN 1 THEN 'Partner B' WHEN 2 THEN 'No' END AS partner,
    CASE WHEN o.o_orderkey % 17 < 12 THEN 'ROI' END AS m_metrics,
    CASE WHEN o.o_orderkey % 19 < 13 THEN 'Board' END AS d_process,
    CASE WHEN o.o_orderkey % 23 < 16 THEN 'Manual' END AS i_pain,
    CASE WHEN o.o_orderkey % 29 < 15 THEN 'Rival' END AS c_compet,
    CASE o.o_orderkey % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'identified' END AS e_buyer,
    CAST(NULL AS VARCHAR) AS champion,
    CASE WHEN o.o_orderkey % 89 = 0 THEN NULL ELSE CAST((o.o_orderkey % 89) % 60 AS VARCHAR) END AS days_to_close_raw
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
),
bucketed AS (
  SELECT d.*,
    CASE WHEN erp_raw = 'Netsuite' THEN 'NetSuite' WHEN erp_raw = 'Sage Intacct' THEN 'Sage'
         WHEN erp_raw LIKE '%Microsoft Dynamics%' THEN 'Dynamics' WHEN erp_raw = 'Acumatica' THEN 'Acumatica'
         ELSE 'Broad Market' END AS eco,
    lower(coalesce(gtm_raw, '')) AS gtm_l,
    list_filter(list_transform(string_split(replace(coalesce(use_case, ''), ';', ','), ','),
                               lambda p: upper(regexp_replace(p, '^\\s+|\\s+$', '', 'g'))),
                lambda p: p <> '') AS uc_parts
  FROM deals d
),
dimmed AS (
  SELECT b.*,
    CASE WHEN eco IN ('NetSuite', 'Sage', 'Dynamics') THEN eco ELSE 'Other' END AS market,
    CASE WHEN gtm_l IN ('nan', 'none', '<na>', 'nat') THEN 'Other'
         WHEN contains(gtm_l, 'channel') OR contains(gtm_l, 'partner') OR contains(gtm_l, 'var')
              OR contains(gtm_l, 'referral') THEN 'Channels'
         WHEN contains(gtm_l, 'marketing') OR contains(gtm_l, 'inbound') OR contains(gtm_l, 'demand')
              OR contains(gtm_l, 'web') OR contains(gtm_l, 'event') OR contains(gtm_l, 'content') THEN 'Marketing'
         WHEN contains(gtm_l, 'bdr') OR contains(gtm_l, 'sdr') OR contains(gtm_l, 'outbound')
              OR contains(gtm_l, 'prospect') THEN 'BDR'
         WHEN contains(gtm_l, 'ae') OR contains(gtm_l, 'account exec') OR contains(gtm_l, 'sales')
              OR contains(gtm_l, 'self') OR contains(gtm_l, 'direct') THEN 'AE'
         ELSE 'Other' END AS gtm,
    CASE WHEN coalesce(use_case, '') = ''
              OR lower(regexp_replace(use_case, '^\\s+|\\s+$', '', 'g')) IN ('nan', 'none', '<na>', 'nat') THEN 'Unknown'
         WHEN list_contains(uc_parts, 'AR') AND (list_contains(uc_parts, 'AP') OR list_contains(uc_parts, 'EXPENSE MANAGEMENT')
              OR list_contains(uc_parts, 'CORPORATE CARDS')) THEN 'Multi-Product'
         WHEN list_contains(uc_parts, 'AR') THEN 'AR'
         WHEN list_contains(uc_parts, 'AP') OR list_contains(uc_parts, 'EXPENSE MANAGEMENT')
              OR list_contains(uc_parts, 'CORPORATE CARDS') THEN 'AP'
         ELSE 'Other' END AS product
  FROM bucketed b
),
clean AS (
  SELECT * FROM dimmed
  WHERE pipeline_id = 'default'
    AND dealname NOT IN ('Test Deal A')
    AND lower(coalesce(source_detail, '')) NOT LIKE '%legacyapp%'
    AND lower(coalesce(source_detail, '')) NOT LIKE '%bulk data%'
    AND (coalesce(source_label, '') NOT IN ('INTEGRATION', 'IMPORT') OR disco_d IS NOT NULL)
),
qtd AS (
  SELECT deal_id, eco AS erp, gtm_raw, use_case,
         TRY_CAST(arr_raw AS DECIMAL(18,2)) AS arr, TRY_CAST(acv_raw AS DECIMAL(18,2)) AS acv,
         create_d, disco_d, meeting_happened, sal_d, close_d, is_won AS won, market, gtm, product
  FROM clean
  WHERE create_d BETWEEN {QS} AND {TODAY}
     OR disco_d BETWEEN {QS} AND {TODAY}
     OR sal_d BETWEEN {QS} AND {TODAY}
     OR (is_won AND close_d BETWEEN {QS} AND {TODAY})
),
enriched AS (
  SELECT deal_id, market, gtm, product, erp, create_d, close_d,
         coalesce(arr, 0) AS arr, coalesce(acv, 0) AS acv,
         coalesce(create_d BETWEEN {QS} AND {TODAY}, false) AS is_sql,
         coalesce(disco_d BETWEEN {QS} AND {TODAY}, false)
           AND coalesce(lower(regexp_replace(meeting_happened, '^\\s+|\\s+$', '', 'g')) = 'yes', false) AS is_held,
         coalesce(sal_d BETWEEN {QS} AND {TODAY}, false) AS is_sal,
         coalesce(won, false) AND coalesce(close_d BETWEEN {QS} AND {TODAY}, false) AS is_book
  FROM qtd
)"""

FUNNEL_COLS = """
  count(*) FILTER (WHERE is_sql) AS sql_booked,
  count(*) FILTER (WHERE is_held) AS sql_held,
  count(*) FILTER (WHERE is_sal) AS sal,
  CAST(coalesce(sum(arr) FILTER (WHERE is_sql), 0) AS DOUBLE) AS pipeline_arr,
  CAST(coalesce(sum(acv) FILTER (WHERE is_sql), 0) AS DOUBLE) AS pipeline_acv,
  CAST(coalesce(sum(arr) FILTER (WHERE is_book), 0) AS DOUBLE) AS bookings_arr,
  CAST(coalesce(sum(acv) FILTER (WHERE is_book), 0) AS DOUBLE) AS bookings_acv"""

MARKETS_VALUES = "(VALUES ('NetSuite', 0), ('Sage', 1), ('Dynamics', 2), ('Other', 3))"
GTM_VALUES = "(VALUES ('Channels', 0), ('Marketing', 1), ('BDR', 2), ('AE', 3), ('Other', 4))"

SPINE_MARKET = f"""
, mf AS (SELECT market, {FUNNEL_COLS} FROM enriched GROUP BY market)
, mspine AS (
  SELECT s.market, CAST(s.ord AS INTEGER) AS ord,
         coalesce(mf.sql_booked, 0) AS sql_booked, coalesce(mf.sql_held, 0) AS sql_held,
         coalesce(mf.sal, 0) AS sal, coalesce(mf.pipeline_arr, 0) AS pipeline_arr,
         coalesce(mf.pipeline_acv, 0) AS pipeline_acv, coalesce(mf.bookings_arr, 0) AS bookings_arr,
         coalesce(mf.bookings_acv, 0) AS bookings_acv
  FROM {MARKETS_VALUES} AS s(market, ord) LEFT JOIN mf ON mf.market = s.market)"""

SPINE_GTM = f"""
, gf AS (SELECT gtm, {FUNNEL_COLS} FROM enriched GROUP BY gtm)
, gspine AS (
  SELECT s.gtm, CAST(s.ord AS INTEGER) AS ord,
         coalesce(gf.sql_booked, 0) AS sql_booked, coalesce(gf.sql_held, 0) AS sql_held,
         coalesce(gf.sal, 0) AS sal, coalesce(gf.pipeline_arr, 0) AS pipeline_arr,
         coalesce(gf.pipeline_acv, 0) AS pipeline_acv, coalesce(gf.bookings_arr, 0) AS bookings_arr,
         coalesce(gf.bookings_acv, 0) AS bookings_acv
  FROM {GTM_VALUES} AS s(gtm, ord) LEFT JOIN gf ON gf.gtm = s.gtm)"""


def _matrix(flag: str, money: str) -> str:
    cols = ",\n  ".join(
        f"CAST(coalesce(sum({money}) FILTER (WHERE market = '{m}'), 0) AS DOUBLE) AS \"{m}\""
        for m in ("NetSuite", "Sage", "Dynamics", "Other"))
    return f"{PRELUDE}\nSELECT product,\n  {cols}\nFROM enriched WHERE {flag} GROUP BY product"


ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["hygiene_filter"] = f"""{PRELUDE}
SELECT deal_id, dealname, pipeline_id, source_label FROM clean"""

ORACLE_SQL["qtd_base"] = f"""{PRELUDE}
SELECT deal_id, erp, gtm_raw, use_case, CAST(arr AS DOUBLE) AS arr, CAST(acv AS DOUBLE) AS acv,
       create_d, disco_d, meeting_happened, sal_d, close_d, won FROM qtd"""

# Values that no number column takes: the test tables hold text such as 'n/a' and 'bad'.
REJECTS = f"""{PRELUDE}
, raws AS (
  SELECT deal_id, market, unnest(['arr_raw', 'acv_raw', 'total_arr_raw', 'prob_raw', 'n_contacts', 'days_to_close_raw']) AS "column",
         unnest([arr_raw, acv_raw, total_arr_raw, prob_raw, CAST(n_contacts AS VARCHAR), days_to_close_raw]) AS raw
  FROM clean)
, rejected AS (
  SELECT deal_id, market, "column", raw, CASE WHEN isnan(d) OR d IS NULL THEN 'no_number' ELSE 'does_not_fit' END AS reason
  FROM (SELECT *, TRY_CAST(raw AS DOUBLE) AS d FROM raws)
  WHERE trim(raw) <> '' AND (d IS NULL OR isnan(d) OR isinf(d)
        OR abs(d) >= CASE WHEN "column" = 'prob_raw' THEN 1e14 WHEN "column" IN ('n_contacts', 'days_to_close_raw') THEN 9.2e18 ELSE 1e16 END))"""

ORACLE_SQL["qtd_base_by_quarter"] = ORACLE_SQL["qtd_base"]

ORACLE_SQL["numeric_rejects"] = f"""{REJECTS}
SELECT deal_id, "column", raw, reason FROM rejected"""

ORACLE_SQL["numeric_reject_counts"] = f"""{REJECTS}
SELECT "column", reason, market, count(*) AS "values" FROM rejected GROUP BY "column", reason, market"""

ORACLE_SQL["enrich_qtd"] = f"""{PRELUDE}
SELECT deal_id, market, gtm, product, CAST(arr AS DOUBLE) AS arr, CAST(acv AS DOUBLE) AS acv,
       is_sql, is_held, is_sal, is_book FROM enriched"""

ORACLE_SQL["dim_buckets"] = f"""{PRELUDE}
SELECT deal_id, eco, market, gtm, product FROM dimmed"""

ORACLE_SQL["pacing"] = f"""{PRELUDE}
, p AS (SELECT deal_id, create_d AS as_of, CAST(date_trunc('quarter', create_d) AS DATE) AS qs FROM deals)
SELECT deal_id, as_of,
       CAST(year(as_of) AS VARCHAR) || 'Q' || CAST(quarter(as_of) AS VARCHAR) AS quarter_key,
       qs AS quarter_start,
       'Q' || CAST(quarter(as_of) AS VARCHAR) || ' ' || CAST(year(as_of) AS VARCHAR) AS quarter_label,
       CAST(date_diff('day', qs, CAST(qs + INTERVAL 3 MONTH AS DATE)) AS INTEGER) AS days_in_quarter,
       CAST(date_diff('day', qs, as_of) AS INTEGER) AS days_into_quarter,
       CAST(date_diff('day', as_of, CAST(qs + INTERVAL 3 MONTH AS DATE)) AS INTEGER) AS days_remaining,
       round(100.0 * date_diff('day', qs, as_of) / date_diff('day', qs, CAST(qs + INTERVAL 3 MONTH AS DATE)), 1)
         AS pct_elapsed
FROM p"""

for _dim in ("market", "gtm", "product"):
    ORACLE_SQL[f"dim_funnel_{_dim}"] = f"""{PRELUDE}
SELECT {_dim}, {FUNNEL_COLS} FROM enriched GROUP BY {_dim}"""

ORACLE_SQL["company_totals"] = f"""{PRELUDE}
SELECT {FUNNEL_COLS} FROM enriched"""

ORACLE_SQL["funnel_grouping_sets"] = f"""{PRELUDE}
SELECT 'market' AS dimension, market AS value, {FUNNEL_COLS} FROM enriched GROUP BY market
UNION ALL SELECT 'gtm', gtm, {FUNNEL_COLS} FROM enriched GROUP BY gtm
UNION ALL SELECT 'product', product, {FUNNEL_COLS} FROM enriched GROUP BY product
UNION ALL SELECT 'total', 'Total', {FUNNEL_COLS} FROM enriched"""

ORACLE_SQL["tof_funnel"] = f"""{PRELUDE}
, per_erp AS (
  SELECT eco AS erp,
    count(*) FILTER (WHERE create_d BETWEEN {QS} AND {TODAY}) AS sql_booked,
    count(*) FILTER (WHERE disco_d BETWEEN {QS} AND {TODAY} AND lower(meeting_happened) = 'yes') AS sql_held,
    count(*) FILTER (WHERE sal_d BETWEEN {QS} AND {TODAY}) AS sal,
    coalesce(round(sum(CASE WHEN create_d BETWEEN {QS} AND {TODAY} THEN TRY_CAST(arr_raw AS DECIMAL(18,2)) ELSE 0 END), 0), 0) AS pipeline_arr,
    coalesce(round(sum(CASE WHEN create_d BETWEEN {QS} AND {TODAY} THEN TRY_CAST(acv_raw AS DECIMAL(18,2)) ELSE 0 END), 0), 0) AS pipeline_acv,
    coalesce(round(sum(CASE WHEN is_won AND close_d BETWEEN {QS} AND {TODAY} THEN TRY_CAST(arr_raw AS DECIMAL(18,2)) ELSE 0 END), 0), 0) AS bookings_arr,
    coalesce(round(sum(CASE WHEN is_won AND close_d BETWEEN {QS} AND {TODAY} THEN TRY_CAST(acv_raw AS DECIMAL(18,2)) ELSE 0 END), 0), 0) AS bookings_acv
  FROM clean GROUP BY eco)
SELECT CASE WHEN erp IN ('NetSuite', 'Sage', 'Dynamics') THEN erp ELSE 'Other' END AS market,
       CAST(sum(sql_booked) AS BIGINT) AS sql_booked, CAST(sum(sql_held) AS BIGINT) AS sql_held,
       CAST(sum(sal) AS BIGINT) AS sal,
       CAST(sum(pipeline_arr) AS DOUBLE) AS pipeline_arr, CAST(sum(pipeline_acv) AS DOUBLE) AS pipeline_acv,
       CAST(sum(bookings_arr) AS DOUBLE) AS bookings_arr, CAST(sum(bookings_acv) AS DOUBLE) AS bookings_acv
FROM per_erp GROUP BY 1"""

ORACLE_SQL["wow_by_market"] = f"""{PRELUDE}
, w AS (
  SELECT market,
    CAST(count(*) FILTER (WHERE create_d BETWEEN DATE '1998-08-17' AND {TODAY}) AS BIGINT) AS this_week,
    CAST(count(*) FILTER (WHERE create_d BETWEEN DATE '1998-08-10' AND DATE '1998-08-16') AS BIGINT) AS last_week
  FROM clean GROUP BY market)
SELECT market, this_week, last_week,
       round(100 * (this_week - last_week) / CAST(nullif(last_week, 0) AS DOUBLE), 6) AS wow_pct
FROM w"""

ORACLE_SQL["matrix_bookings_acv"] = _matrix("is_book", "acv")
ORACLE_SQL["matrix_bookings_arr"] = _matrix("is_book", "arr")
ORACLE_SQL["matrix_pipeline_acv"] = _matrix("is_sql", "acv")
ORACLE_SQL["matrix_pipeline_arr"] = _matrix("is_sql", "arr")

ORACLE_SQL["funnel_market_spine"] = f"""{PRELUDE}{SPINE_MARKET}
SELECT * FROM mspine"""

ORACLE_SQL["funnel_gtm_spine"] = f"""{PRELUDE}{SPINE_GTM}
SELECT * FROM gspine"""

ORACLE_SQL["funnel_long_market"] = f"""{PRELUDE}{SPINE_MARKET}
SELECT market, ord, 'SQL-Booked' AS stage, sql_booked AS count FROM mspine
UNION ALL SELECT market, ord, 'SQL-Held', sql_held FROM mspine
UNION ALL SELECT market, ord, 'SAL', sal FROM mspine"""

ORACLE_SQL["funnel_long_gtm"] = f"""{PRELUDE}{SPINE_GTM}
SELECT gtm, ord, 'SQL-Booked' AS stage, sql_booked AS count FROM gspine
UNION ALL SELECT gtm, ord, 'SQL-Held', sql_held FROM gspine
UNION ALL SELECT gtm, ord, 'SAL', sal FROM gspine"""

ORACLE_SQL["gtm_conversion"] = f"""{PRELUDE}{SPINE_GTM}
SELECT gtm, ord, sql_booked, sql_held, sal,
       round_even(sql_held / nullif(sql_booked, 0) * 100, 0) AS held_rate,
       round_even(sal / nullif(sql_held, 0) * 100, 0) AS sal_rate
FROM gspine"""

ORACLE_SQL["top_engine"] = f"""{PRELUDE}{SPINE_GTM}
SELECT (SELECT gtm FROM gspine ORDER BY sql_booked DESC, ord LIMIT 1) AS top_engine,
       (SELECT max(sql_booked) FROM gspine) AS top_sql_booked,
       (SELECT sql_booked FROM gspine WHERE gtm = 'Channels') AS channel_sql_booked"""

ORACLE_SQL["market_lead_lag"] = f"""{PRELUDE}{SPINE_MARKET}
SELECT (SELECT market FROM mspine ORDER BY bookings_arr DESC, ord LIMIT 1) AS lead_market,
       (SELECT max(bookings_arr) FROM mspine) AS lead_bookings_arr,
       (SELECT market FROM mspine WHERE market <> 'Other' ORDER BY bookings_arr, ord LIMIT 1) AS lag_market,
       (SELECT min(bookings_arr) FROM mspine WHERE market <> 'Other') AS lag_bookings_arr"""

ORACLE_SQL["funnel_steps"] = f"""{PRELUDE}
, t AS (SELECT count(*) FILTER (WHERE is_sql) AS s0, count(*) FILTER (WHERE is_held) AS s1,
               count(*) FILTER (WHERE is_sal) AS s2, count(*) FILTER (WHERE is_book) AS s3 FROM enriched)
, steps AS (
  SELECT 'SQL-Booked' AS step, 0 AS ord, s0 AS value, s0 AS first FROM t
  UNION ALL SELECT 'SQL-Held', 1, s1, s0 FROM t
  UNION ALL SELECT 'SAL', 2, s2, s0 FROM t
  UNION ALL SELECT 'Won', 3, s3, s0 FROM t)
SELECT step, CAST(ord AS INTEGER) AS ord, value, round(value / nullif(first, 0) * 100, 6) AS pct_of_initial
FROM steps"""

ORACLE_SQL["product_mix_qtd"] = f"""{PRELUDE}
, p AS (SELECT product, sum(acv) FILTER (WHERE is_sql) AS pacv, sum(acv) FILTER (WHERE is_book) AS bacv
        FROM enriched GROUP BY product)
SELECT product, CAST(coalesce(pacv, 0) AS DOUBLE) AS pipeline_acv,
       round(CAST(coalesce(pacv, 0) AS DOUBLE) / nullif(CAST(sum(coalesce(pacv, 0)) OVER () AS DOUBLE), 0), 6)
         AS pipeline_acv_share,
       CAST(coalesce(bacv, 0) AS DOUBLE) AS bookings_acv
FROM p"""


# ---------------------------------------------------------------------------------------
# Booking review: owners, sentiment, open pipeline scoring
# ---------------------------------------------------------------------------------------

def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _has(x: str) -> str:
    return f"coalesce({_strip(x)} NOT IN ('', 'None', 'nan', 'No', 'false', 'FALSE'), false)"


def _yes(x: str) -> str:
    return f"coalesce(lower({_strip(x)}) IN ('true', 'yes', '1', 'won', 'identified'), false)"


def _title(x: str) -> str:
    chars = f"string_split(lower({x}), '')"
    return (f"array_to_string(list_transform({chars}, lambda ch, i: CASE WHEN i = 1 OR NOT "
            f"regexp_matches({chars}[i - 1], '^[[:alpha:]]$') THEN upper(ch) ELSE ch END), '')")


def _money(x: str) -> str:
    v = f"coalesce(CAST({x} AS DOUBLE), 0.0)"
    return (f"CASE WHEN abs({v}) >= 1e6 THEN '$' || printf('%.2f', {v} / 1e6) || 'M' "
            f"ELSE '$' || printf('%.0f', {v} / 1e3) || 'K' END")


SCORED = f"""
, owners_raw AS (
  SELECT CAST(s_suppkey % 23 AS VARCHAR) AS owner_id,
         CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_name END AS full_name,
         CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 5 = 1 THEN ''
              ELSE 'Pod ' || CAST(s_nationkey % 4 AS VARCHAR) END AS team,
         s_suppkey AS seq
  FROM supplier)
, owner_last AS (
  SELECT owner_id, full_name, team FROM (
    SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY seq DESC) AS rn FROM owners_raw) WHERE rn = 1)
, owner_named AS (
  SELECT owner_id, team,
         {_strip("CASE WHEN full_name IS NULL OR full_name = '' THEN 'Unknown' ELSE full_name END")} AS owner_name
  FROM owner_last)
, owner_dim AS (
  SELECT owner_id, owner_name, CASE WHEN team IS NULL OR team = '' THEN owner_name ELSE team END AS pod
  FROM owner_named)
, sent AS (
  SELECT CAST(event_id - event_id % 3 AS VARCHAR) AS deal_id, value / 100 AS sentiment,
         (value - 50) / 100 AS trend, CAST(user_id % 20 AS BIGINT) AS call_count
  FROM events)
, deal_sent AS (
  SELECT deal_id, avg(sentiment) AS call_sentiment, avg(trend) AS call_trend, max(call_count) AS calls
  FROM sent GROUP BY deal_id)
, open_scan AS (
  SELECT deal_id, dealname, owner_id, gtm_raw, use_case, erp_raw, market, gtm, product,
         TRY_CAST(arr_raw AS DECIMAL(18,2)) AS arr, TRY_CAST(acv_raw AS DECIMAL(18,2)) AS acv,
         stage_id,
         CASE stage_id WHEN 's_sql' THEN 'SQL' WHEN 's_sal' THEN 'SAL – Discovery/Demo'
              WHEN 's_prop' THEN 'OPP – Proposal/ROI' WHEN 's_neg' THEN 'OPP – Negotiation' END AS stage,
         create_d, close_d, fcat, prob_raw, n_contacts, next_step, last_contact_d, partner,
         m_metrics, e_buyer, d_process, i_pain, c_compet, champion
  FROM clean
  WHERE is_closed = false AND stage_id IN ('s_sal', 's_prop', 's_neg'))
, sc1 AS (
  SELECT o.*,
    CASE fcat WHEN 'COMMIT' THEN 'Commit' WHEN 'BEST_CASE' THEN 'Best Case' WHEN 'PIPELINE' THEN 'Pipeline'
         ELSE 'Not Forecasted' END AS forecast_cat,
    coalesce(fcat IN ('COMMIT', 'BEST_CASE', 'PIPELINE'), false) AS is_forecasted,
    CASE WHEN fcat IS NULL OR {_strip("fcat")} = '' THEN 'Uncategorized'
         WHEN fcat = 'COMMIT' THEN 'Commit' WHEN fcat = 'BEST_CASE' THEN 'Best Case'
         WHEN fcat = 'PIPELINE' THEN 'Pipeline' WHEN fcat = 'OMIT' THEN 'Not Forecasted'
         ELSE {_title("fcat")} END AS fcat_disp,
    coalesce(TRY_CAST(prob_raw AS DECIMAL(26,12)), 0) AS prob0,
    date_diff('day', last_contact_d, {TODAY}) AS days_since_contact,
    {_has("m_metrics")} AS has_M, {_yes("e_buyer")} AS has_E, {_has("d_process")} AS has_D,
    {_has("i_pain")} AS has_I, {_has("c_compet")} AS has_C, {_yes("champion")} AS has_Champ
  FROM open_scan o)
, sc2 AS (
  SELECT *,
    CAST(CASE WHEN prob0 <= 1 THEN prob0 ELSE prob0 / 100 END AS DECIMAL(16,12)) AS prob,
    CAST(has_M AS INTEGER) + CAST(has_E AS INTEGER) + CAST(has_D AS INTEGER) + CAST(has_I AS INTEGER)
      + CAST(has_C AS INTEGER) AS meddpicc
  FROM sc1)
, sc3 AS (
  SELECT *, CAST(acv AS DECIMAL(22,2)) * prob AS weighted_acv,
    list_filter([
      CASE WHEN days_since_contact IS NULL OR days_since_contact > 14 THEN 'No activity 14d+' END,
      CASE WHEN n_contacts IS NULL OR n_contacts <= 1 THEN 'Single-threaded' END,
      CASE WHEN NOT {_has("next_step")} THEN 'No next step' END,
      CASE WHEN NOT {_yes("e_buyer")} THEN 'No economic buyer' END,
      CASE WHEN stage IN ('OPP – Proposal/ROI', 'OPP – Negotiation') AND meddpicc < 3
           THEN 'Late stage, weak MEDDPICC' END], lambda f: f IS NOT NULL) AS flags
  FROM sc2)
, sc4 AS (
  SELECT *, CAST(len(flags) AS INTEGER) AS risk_count,
    list_contains(flags, 'No activity 14d+') AS f_stale,
    list_contains(flags, 'Single-threaded') AS f_single,
    list_contains(flags, 'No next step') AS f_next,
    list_contains(flags, 'No economic buyer') AS f_eb,
    list_contains(flags, 'Late stage, weak MEDDPICC') AS f_late
  FROM sc3)
, sc5 AS (
  SELECT *,
    CASE WHEN risk_count >= 3 OR f_stale THEN 'Red' WHEN risk_count = 2 OR meddpicc < 3 THEN 'Yellow'
         ELSE 'Green' END AS rag,
    greatest(5, least(100, 100 - 15 * risk_count - 5 * greatest(0, 5 - meddpicc)
             - CASE WHEN days_since_contact > 30 THEN 10 ELSE 0 END)) AS confidence
  FROM sc4)
, scored AS (
  SELECT s.*,
    coalesce(od.owner_name, 'Unassigned') AS owner_name, coalesce(od.pod, 'Unassigned') AS pod,
    ds.call_sentiment, ds.call_trend, coalesce(ds.calls, 0) AS calls,
    {_has("partner")} AS partner_flag,
    CASE WHEN {_has("partner")} THEN partner ELSE '—' END AS partner_disp,
    CASE WHEN f_stale THEN 'Re-engage — book next touch this week'
         WHEN f_eb THEN 'Confirm + meet the economic buyer'
         WHEN f_late THEN 'Close MEDDPICC gaps before forecasting'
         WHEN f_single THEN 'Multi-thread — add a 2nd+ stakeholder'
         WHEN f_next THEN 'Set a concrete next step + date'
         ELSE 'On track — maintain cadence' END AS action,
    CASE WHEN forecast_cat = 'Commit' AND (rag = 'Red' OR meddpicc < 3 OR f_stale) THEN 'Downgrade → Best Case'
         WHEN forecast_cat = 'Best Case' AND rag = 'Red' THEN 'Downgrade → Pipeline'
         WHEN forecast_cat IN ('Pipeline', 'Not Forecasted') AND rag = 'Green' AND meddpicc >= 4 THEN 'Upgrade'
         WHEN forecast_cat IN ('Pipeline', 'Best Case', 'Commit') AND rag = 'Red' AND meddpicc <= 1
              THEN 'Remove from forecast'
         WHEN risk_count >= 3 THEN 'Escalate for manager review'
         ELSE 'Keep current category' END AS rec_category,
    coalesce(nullif(concat_ws(', ',
         CASE WHEN meddpicc < 3 THEN 'MEDDPICC ' || CAST(meddpicc AS VARCHAR) || '/5' END,
         CASE WHEN f_stale THEN 'stale 14d+' END, CASE WHEN f_eb THEN 'no EB' END,
         CASE WHEN f_single THEN 'single-threaded' END, CASE WHEN f_next THEN 'no next step' END), ''),
       CASE WHEN rag = 'Green' THEN 'clean evidence' ELSE '—' END) AS rec_reason,
    CASE WHEN len(flags) > 0 THEN array_to_string(flags, ', ') ELSE '—' END AS risk_flags
  FROM sc5 s
  LEFT JOIN owner_dim od ON od.owner_id = s.owner_id
  LEFT JOIN deal_sent ds ON ds.deal_id = CAST(s.deal_id AS VARCHAR))"""

BOOKING = PRELUDE + SCORED

ORACLE_SQL["open_deals"] = f"""{BOOKING}
SELECT deal_id, dealname, owner_id, gtm_raw, use_case, erp_raw, CAST(arr AS DOUBLE) AS arr,
       CAST(acv AS DOUBLE) AS acv, stage_id, create_d, close_d, fcat, prob_raw, n_contacts, next_step,
       last_contact_d, partner, m_metrics, e_buyer, d_process, i_pain, c_compet, champion, stage
FROM open_scan"""

ORACLE_SQL["owner_dim"] = f"""{BOOKING}
SELECT owner_id, owner_name, pod FROM owner_dim"""

ORACLE_SQL["deal_sentiment"] = f"""{BOOKING}
SELECT deal_id, round(call_sentiment, 6) AS call_sentiment, round(call_trend, 6) AS call_trend, calls
FROM deal_sent"""

ORACLE_SQL["deals_with_owner"] = f"""{BOOKING}
SELECT deal_id, owner_id, owner_name, pod FROM scored"""

ORACLE_SQL["deals_with_sentiment"] = f"""{BOOKING}
SELECT deal_id, round(call_sentiment, 6) AS call_sentiment, round(call_trend, 6) AS call_trend, calls
FROM scored"""

ORACLE_SQL["forecast_fields"] = f"""{BOOKING}
SELECT deal_id, forecast_cat, is_forecasted, fcat_disp, CAST(prob AS DOUBLE) AS prob,
       CAST(weighted_acv AS DOUBLE) AS weighted_acv, market, product, gtm
FROM scored"""

ORACLE_SQL["deal_scoring"] = f"""{BOOKING}
SELECT deal_id, CAST(days_since_contact AS INTEGER) AS days_since_contact, has_M, has_E, has_D, has_I, has_C,
       has_Champ, meddpicc, risk_flags, risk_count, rag, confidence
FROM scored"""

ORACLE_SQL["deal_recommendations"] = f"""{BOOKING}
SELECT deal_id, rec_category, rec_reason, action, partner_disp, partner_flag FROM scored"""

ORACLE_SQL["open_pipeline_full"] = f"""{BOOKING}
SELECT deal_id, dealname, stage, forecast_cat, rec_category, market, product, gtm, CAST(acv AS DOUBLE) AS acv,
       owner_name, pod, meddpicc, rag, confidence, CAST(days_since_contact AS INTEGER) AS days_since_contact, action
FROM scored"""

ORACLE_SQL["deals_with_sentiment_bucketed"] = ORACLE_SQL["deals_with_sentiment"]

ORACLE_SQL["watchlist"] = f"""{BOOKING}
, top AS (SELECT * FROM scored WHERE rag IN ('Red', 'Yellow') ORDER BY acv DESC NULLS LAST, deal_id LIMIT 12)
SELECT deal_id, dealname AS deal, owner_name AS owner, CAST(acv AS DOUBLE) AS acv,
       CASE WHEN acv IS NULL THEN '—' ELSE {_money("acv")} END AS acv_text, stage,
       strftime(close_d, '%b %d') AS close, forecast_cat AS rep_category, rec_category AS recommended,
       rec_reason AS why, CAST(confidence AS VARCHAR) AS conf, rag, CAST(meddpicc AS VARCHAR) || '/5' AS meddpicc,
       CASE WHEN call_sentiment IS NULL THEN '—' ELSE printf('%+.2f', call_sentiment) END AS sentiment,
       risk_flags, partner_disp AS partner, action,
       'https://crm.example.com/deal/' || CAST(deal_id AS VARCHAR) AS deal_url
FROM top"""

ORACLE_SQL["top_red"] = f"""{BOOKING}
SELECT deal_id, dealname, stage, CAST(acv AS DOUBLE) AS acv, owner_name, risk_count, meddpicc
FROM scored WHERE rag = 'Red' ORDER BY acv DESC NULLS LAST, deal_id LIMIT 5"""

ORACLE_SQL["forecast_rollup"] = f"""{BOOKING}
, g AS (SELECT forecast_cat, count(deal_id) AS deals, coalesce(sum(acv), 0) AS acv,
               coalesce(sum(weighted_acv), 0) AS w FROM scored GROUP BY forecast_cat)
SELECT g.forecast_cat, CAST(s.ord AS INTEGER) AS ord, deals, CAST(acv AS DOUBLE) AS acv,
       CAST(round(w, 2) AS DOUBLE) AS weighted_acv
FROM g JOIN (VALUES ('Commit', 0), ('Best Case', 1), ('Pipeline', 2), ('Not Forecasted', 3)) AS s(cat, ord)
  ON s.cat = g.forecast_cat"""

ORACLE_SQL["forecast_windows"] = f"""{BOOKING}
, h AS (SELECT * FROM (VALUES ('Week', 0, DATE '1998-08-23'), ('Month', 1, DATE '1998-08-31'),
                              ('Quarter', 2, DATE '1998-09-30')) AS t(horizon, ord, end_date))
SELECT h.horizon, CAST(h.ord AS INTEGER) AS ord, h.end_date,
       count(s.deal_id) AS deals,
       CAST(coalesce(sum(s.acv), 0) AS DOUBLE) AS total,
       CAST(coalesce(sum(s.acv) FILTER (WHERE s.forecast_cat = 'Commit'), 0) AS DOUBLE) AS commit,
       CAST(coalesce(sum(s.acv) FILTER (WHERE s.forecast_cat = 'Best Case'), 0) AS DOUBLE) AS best,
       CAST(round(coalesce(sum(s.weighted_acv), 0), 2) AS DOUBLE) AS weighted
FROM h LEFT JOIN scored s ON s.close_d <= h.end_date
GROUP BY h.horizon, h.ord, h.end_date"""

ORACLE_SQL["forecast_hygiene"] = f"""{BOOKING}
, t AS (SELECT count(*) AS open_deals, count(*) FILTER (WHERE is_forecasted) AS categorized,
               count(*) FILTER (WHERE forecast_cat IN ('Commit', 'Best Case')) AS commit_best_deals,
               CAST(coalesce(sum(acv) FILTER (WHERE NOT is_forecasted), 0) AS DOUBLE) AS uncategorized_acv
        FROM scored)
, p AS (SELECT *, round(CASE WHEN open_deals > 0 THEN 100 * categorized / open_deals ELSE 0.0 END, 6)
                  AS discipline_pct FROM t)
SELECT *, CASE WHEN discipline_pct >= 70 THEN 'Green' WHEN discipline_pct >= 40 THEN 'Yellow' ELSE 'Red' END
          AS discipline_status
FROM p"""

for _dim in ("market", "product"):
    ORACLE_SQL[f"{_dim}_forecast"] = f"""{BOOKING}
, g AS (SELECT {_dim}, coalesce(sum(acv) FILTER (WHERE forecast_cat = 'Commit'), 0) AS c0,
               coalesce(sum(acv) FILTER (WHERE forecast_cat = 'Best Case'), 0) AS c1,
               coalesce(sum(acv) FILTER (WHERE forecast_cat = 'Pipeline'), 0) AS c2
        FROM scored GROUP BY {_dim})
SELECT {_dim}, 'Commit' AS category, CAST(c0 AS DOUBLE) AS acv FROM g
UNION ALL SELECT {_dim}, 'Best Case', CAST(c1 AS DOUBLE) FROM g
UNION ALL SELECT {_dim}, 'Pipeline', CAST(c2 AS DOUBLE) FROM g"""

ORACLE_SQL["open_by_market"] = f"""{BOOKING}
SELECT s.market, CAST(s.ord AS INTEGER) AS ord, CAST(coalesce(sum(acv), 0) AS DOUBLE) AS acv, count(deal_id) AS deals
FROM scored JOIN {MARKETS_VALUES} AS s(market, ord) ON s.market = scored.market
GROUP BY s.market, s.ord"""

ORACLE_SQL["open_by_gtm"] = f"""{BOOKING}
SELECT gtm, CAST(coalesce(sum(acv), 0) AS DOUBLE) AS acv, count(deal_id) AS deals FROM scored GROUP BY gtm"""

ORACLE_SQL["open_mix_product"] = f"""{BOOKING}
, g AS (SELECT product, coalesce(sum(acv), 0) AS acv FROM scored GROUP BY product)
SELECT product, CAST(acv AS DOUBLE) AS acv,
       round(CAST(acv AS DOUBLE) / nullif(CAST(sum(acv) OVER () AS DOUBLE), 0), 6) AS share
FROM g"""

ORACLE_SQL["open_matrix"] = f"""{BOOKING}
SELECT product, """ + ",\n  ".join(
    f"CAST(coalesce(sum(acv) FILTER (WHERE market = '{m}'), 0) AS DOUBLE) AS \"{m}\""
    for m in ("NetSuite", "Sage", "Dynamics", "Other")) + """
FROM scored GROUP BY product"""

ORACLE_SQL["market_commit_vs_risk"] = f"""{BOOKING}
, g AS (
  SELECT 'commit' AS measure, market, coalesce(sum(acv), 0) AS acv FROM scored WHERE forecast_cat = 'Commit' GROUP BY market
  UNION ALL
  SELECT 'red', market, coalesce(sum(acv), 0) FROM scored WHERE rag = 'Red' GROUP BY market)
SELECT measure, market, CAST(acv AS DOUBLE) AS acv,
       row_number() OVER (PARTITION BY measure ORDER BY acv DESC, market) = 1 AS is_top
FROM g"""

ORACLE_SQL["rag_distribution"] = f"""{BOOKING}
SELECT rag, count(*) AS deals FROM scored GROUP BY rag"""

ORACLE_SQL["open_quality_stats"] = f"""{BOOKING}
SELECT count(*) AS open_deals, round(avg(meddpicc), 6) AS avg_meddpicc,
       count(call_sentiment) AS sentiment_coverage
FROM scored"""

_POD_BASE = f"""{BOOKING}
, pod_rows AS (
  SELECT pod, count(deal_id) AS deals, coalesce(sum(acv), 0) AS acv,
         count(*) FILTER (WHERE rag = 'Red') AS red, count(*) FILTER (WHERE rag = 'Yellow') AS yellow,
         count(*) FILTER (WHERE rag = 'Green') AS green
  FROM scored GROUP BY pod)
, ranked AS (
  SELECT pod, dealname, acv, flags, rag, forecast_cat,
         row_number() OVER (PARTITION BY pod ORDER BY acv DESC NULLS LAST, deal_id) AS rn_all,
         row_number() OVER (PARTITION BY pod, (forecast_cat = 'Commit' OR rag = 'Green')
                            ORDER BY acv DESC NULLS LAST, deal_id) AS rn_win,
         row_number() OVER (PARTITION BY pod, rag = 'Red' ORDER BY acv DESC NULLS LAST, deal_id) AS rn_red
  FROM scored)
, win_w AS (SELECT pod, dealname, acv FROM ranked WHERE rn_win = 1 AND (forecast_cat = 'Commit' OR rag = 'Green'))
, win_a AS (SELECT pod, dealname, acv FROM ranked WHERE rn_all = 1)
, risk AS (SELECT pod, dealname, acv, flags FROM ranked WHERE rn_red = 1 AND rag = 'Red')
, detail AS (
  SELECT p.pod, p.deals, CAST(p.acv AS DOUBLE) AS acv,
    CASE WHEN p.red > p.green THEN 'Red' WHEN p.yellow >= p.green THEN 'Yellow' ELSE 'Green' END AS status,
    p.red, p.yellow, p.green,
    coalesce(substr(coalesce(ww.dealname, wa.dealname), 1, 34), '') || ' ('
      || CASE WHEN ww.pod IS NOT NULL THEN (CASE WHEN ww.acv IS NULL THEN '—' ELSE {_money("ww.acv")} END)
              ELSE (CASE WHEN wa.acv IS NULL THEN '—' ELSE {_money("wa.acv")} END) END || ')' AS biggest_win,
    CASE WHEN rk.pod IS NULL THEN '—'
         ELSE coalesce(substr(rk.dealname, 1, 34), '') || ' ('
              || CASE WHEN rk.acv IS NULL THEN '—' ELSE {_money("rk.acv")} END || ')' END AS biggest_risk,
    CASE WHEN rk.pod IS NULL OR len(rk.flags) = 0 THEN 'None this week'
         WHEN rk.flags[1] = 'No economic buyer' THEN 'Help access the economic buyer'
         WHEN rk.flags[1] = 'No activity 14d+' THEN 'Unblock stalled engagement'
         WHEN rk.flags[1] = 'Late stage, weak MEDDPICC' THEN 'Deal inspection / qualification help'
         WHEN rk.flags[1] = 'Single-threaded' THEN 'Exec intro to multi-thread'
         WHEN rk.flags[1] = 'No next step' THEN 'Hold rep accountable for next step'
         ELSE 'Deal inspection' END AS exec_support
  FROM pod_rows p
  LEFT JOIN win_w ww ON ww.pod = p.pod
  LEFT JOIN win_a wa ON wa.pod = p.pod
  LEFT JOIN risk rk ON rk.pod = p.pod)"""

ORACLE_SQL["pod_detail"] = f"""{_POD_BASE}
SELECT * FROM detail"""

ORACLE_SQL["pod_top_deals"] = f"""{_POD_BASE}
, laned AS (
  SELECT *, 'any' AS lane FROM scored
  UNION ALL SELECT *, 'winner' FROM scored WHERE forecast_cat = 'Commit' OR rag = 'Green'
  UNION ALL SELECT *, 'risk' FROM scored WHERE rag = 'Red')
, placed AS (SELECT *, row_number() OVER (PARTITION BY pod, lane ORDER BY acv DESC NULLS LAST, deal_id) AS place FROM laned)
SELECT pod, lane, CAST(place AS INTEGER) AS place, deal_id, dealname, CAST(acv AS DOUBLE) AS acv, flags[1] AS first_flag
FROM placed WHERE place <= 3"""

ORACLE_SQL["pod_reviews"] = f"""{_POD_BASE}
, kept AS (SELECT * FROM detail
           WHERE deals >= 3 OR NOT EXISTS (SELECT 1 FROM detail d2 WHERE d2.deals >= 3))
SELECT * FROM kept ORDER BY acv DESC, pod LIMIT 8"""

ORACLE_SQL["pod_summary"] = f"""{BOOKING}
, g AS (
  SELECT pod, count(deal_id) AS deals, CAST(coalesce(sum(acv), 0) AS DOUBLE) AS acv,
         count(*) FILTER (WHERE rag = 'Red') AS red, count(*) FILTER (WHERE rag = 'Yellow') AS yellow,
         count(*) FILTER (WHERE rag = 'Green') AS green, round(avg(confidence), 6) AS avg_conf
  FROM scored GROUP BY pod)
SELECT *, CASE WHEN red > green THEN 'Red' WHEN yellow >= green THEN 'Yellow' ELSE 'Green' END AS status FROM g"""

# ---------------------------------------------------------------------------------------
# Wins
# ---------------------------------------------------------------------------------------

WON = f"""{BOOKING}
, won AS (
  SELECT c.deal_id, c.dealname, coalesce(od.owner_name, 'Unassigned') AS owner_name, c.market, c.product,
         coalesce(TRY_CAST(c.total_arr_raw AS DECIMAL(18,2)), 0) AS arr,
         coalesce(TRY_CAST(c.acv_raw AS DECIMAL(18,2)), 0) AS acv,
         TRY_CAST(c.days_to_close_raw AS DOUBLE) AS days_to_close,
         CASE WHEN {_has("c.partner")} THEN c.partner ELSE 'Direct' END AS partner_disp,
         c.close_d
  FROM clean c LEFT JOIN owner_dim od ON od.owner_id = c.owner_id
  WHERE c.is_won = true AND c.close_d BETWEEN {QS} AND {TODAY})"""

ORACLE_SQL["closed_won"] = f"""{WON}
SELECT deal_id, dealname, owner_name, market, product, CAST(arr AS DOUBLE) AS arr, CAST(acv AS DOUBLE) AS acv,
       days_to_close, partner_disp, close_d FROM won"""

ORACLE_SQL["wins_kpis"] = f"""{WON}
SELECT count(*) AS wins, CAST(coalesce(sum(acv), 0) AS DOUBLE) AS total_acv,
       CAST(coalesce(sum(arr), 0) AS DOUBLE) AS total_arr,
       round(CAST(sum(acv) AS DOUBLE) / count(*), 6) AS avg_acv,
       round(avg(nullif(days_to_close, 0)), 6) AS avg_cycle_days
FROM won"""

ORACLE_SQL["wins_by_market"] = f"""{WON}
SELECT market, CAST(sum(acv) AS DOUBLE) AS acv FROM won GROUP BY market"""

ORACLE_SQL["wins_by_product"] = f"""{WON}
, g AS (SELECT product, sum(acv) AS acv FROM won GROUP BY product)
SELECT product, CAST(acv AS DOUBLE) AS acv,
       round(CAST(acv AS DOUBLE) / nullif(CAST(sum(acv) OVER () AS DOUBLE), 0), 6) AS share
FROM g"""

ORACLE_SQL["wins_by_partner"] = f"""{WON}
SELECT partner_disp, CAST(sum(acv) AS DOUBLE) AS acv FROM won GROUP BY partner_disp
ORDER BY acv DESC, partner_disp LIMIT 8"""


# ---------------------------------------------------------------------------------------
# State: derived goals, reconstructed Friday history, snapshot store, actions; reports
# ---------------------------------------------------------------------------------------

FRIDAYS = ("1998-07-03", "1998-07-10", "1998-07-17", "1998-07-24", "1998-07-31", "1998-08-07", "1998-08-14")
_FRI_VALUES = ", ".join(f"(DATE '{f}')" for f in FRIDAYS)
_TOF = ("sql_booked", "sql_held", "sal", "pipeline_arr", "pipeline_acv", "bookings_arr", "bookings_acv")
_GOAL_METRICS = ("sql_booked", "sql_held", "sal", "pipeline_arr", "bookings_arr")
_HAPPENED = f"coalesce(lower({_strip('meeting_happened')}) = 'yes', false)"

STATE = f"""{BOOKING}
, gev AS (
  SELECT market, 'sql_booked' AS metric, create_d AS d, CAST(1 AS DECIMAL(18,2)) AS v FROM clean
  UNION ALL SELECT market, 'sql_held', CASE WHEN {_HAPPENED} THEN disco_d END, CAST(1 AS DECIMAL(18,2)) FROM clean
  UNION ALL SELECT market, 'sal', sal_d, CAST(1 AS DECIMAL(18,2)) FROM clean
  UNION ALL SELECT market, 'pipeline_arr', create_d, TRY_CAST(arr_raw AS DECIMAL(18,2)) FROM clean
  UNION ALL SELECT market, 'bookings_arr', CASE WHEN is_won THEN close_d END, TRY_CAST(arr_raw AS DECIMAL(18,2)) FROM clean)
, gagg AS (
  SELECT CAST(year(d) + 1 AS VARCHAR) || 'Q' || CAST(quarter(d) AS VARCHAR) AS quarter, market, metric,
         coalesce(sum(v), 0) AS actual
  FROM gev WHERE d IS NOT NULL GROUP BY 1, 2, 3)
, goals AS (
  SELECT quarter, market, metric,
         CASE WHEN market = 'Other' AND metric = 'sal' THEN 0.0 ELSE CAST(round(actual * 1.1, 0) AS DOUBLE) END AS value
  FROM gagg WHERE NOT (market = 'Dynamics' AND metric = 'sql_held'))
, gq AS (SELECT * FROM goals WHERE quarter = '1998Q3')
, gtot AS (
  SELECT m.metric, CAST(m.ord AS INTEGER) AS ord, coalesce(sum(gq.value), 0.0) AS goal_total
  FROM (VALUES ('sql_booked', 0), ('sql_held', 1), ('sal', 2), ('pipeline_arr', 3), ('bookings_arr', 4)) AS m(metric, ord)
  LEFT JOIN gq ON gq.metric = m.metric AND gq.market IN ('NetSuite', 'Sage', 'Dynamics', 'Other')
  GROUP BY m.metric, m.ord)
, fr AS (SELECT f AS snapshot_date FROM (VALUES {_FRI_VALUES}) AS t(f))
, qb AS (
  SELECT create_d, disco_d, sal_d, close_d, coalesce(arr, 0) AS arr0, coalesce(acv, 0) AS acv0,
         {_HAPPENED} AS hap, coalesce(won, false) AS w
  FROM qtd)
, hagg AS MATERIALIZED (
  SELECT fr.snapshot_date,
    count(qb.create_d) FILTER (WHERE qb.create_d BETWEEN {QS} AND fr.snapshot_date) AS sql_booked,
    count(qb.disco_d) FILTER (WHERE qb.hap AND qb.disco_d BETWEEN {QS} AND fr.snapshot_date) AS sql_held,
    count(qb.sal_d) FILTER (WHERE qb.sal_d BETWEEN {QS} AND fr.snapshot_date) AS sal,
    coalesce(sum(qb.arr0) FILTER (WHERE qb.create_d BETWEEN {QS} AND fr.snapshot_date), 0) AS pipeline_arr,
    coalesce(sum(qb.acv0) FILTER (WHERE qb.create_d BETWEEN {QS} AND fr.snapshot_date), 0) AS pipeline_acv,
    coalesce(sum(qb.arr0) FILTER (WHERE qb.w AND qb.close_d BETWEEN {QS} AND fr.snapshot_date), 0) AS bookings_arr,
    coalesce(sum(qb.acv0) FILTER (WHERE qb.w AND qb.close_d BETWEEN {QS} AND fr.snapshot_date), 0) AS bookings_acv
  FROM fr, qb GROUP BY fr.snapshot_date)
, hist AS MATERIALIZED (
  {" UNION ALL ".join(f"SELECT snapshot_date, 'tof_{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM hagg" for m in _TOF)})
, bk AS MATERIALIZED (
  SELECT CAST(coalesce(sum(acv), 0) AS DOUBLE) AS bk_open_acv,
         CAST(coalesce(sum(acv) FILTER (WHERE forecast_cat = 'Commit'), 0) AS DOUBLE) AS bk_commit,
         CAST(coalesce(sum(acv) FILTER (WHERE forecast_cat = 'Best Case'), 0) AS DOUBLE) AS bk_best,
         CAST(round(coalesce(sum(weighted_acv), 0), 2) AS DOUBLE) AS bk_weighted,
         CAST(coalesce(sum(acv) FILTER (WHERE close_d <= {QE}), 0) AS DOUBLE) AS bk_q_total
  FROM scored)
, bk_long AS MATERIALIZED (
  SELECT 'bk_open_acv' AS metric, bk_open_acv AS value FROM bk UNION ALL SELECT 'bk_commit', bk_commit FROM bk
  UNION ALL SELECT 'bk_best', bk_best FROM bk UNION ALL SELECT 'bk_weighted', bk_weighted FROM bk
  UNION ALL SELECT 'bk_q_total', bk_q_total FROM bk)
, seed AS MATERIALIZED (
  SELECT DATE '1998-08-14' AS snapshot_date, metric, value FROM bk_long
  UNION ALL SELECT DATE '1998-06-30', metric, value FROM bk_long)
, missing AS MATERIALIZED (SELECT DISTINCT h.snapshot_date FROM hist h ANTI JOIN seed s ON s.snapshot_date = h.snapshot_date)
, gate AS MATERIALIZED (SELECT count(*) > 0 AS open FROM missing)
, store AS MATERIALIZED (
  SELECT s.snapshot_date, s.metric, s.value
  FROM seed s LEFT JOIN hist h ON h.snapshot_date = s.snapshot_date AND h.metric = s.metric CROSS JOIN gate
  WHERE NOT gate.open OR h.metric IS NULL
  UNION ALL SELECT hist.snapshot_date, hist.metric, hist.value FROM hist CROSS JOIN gate WHERE gate.open)
, prior AS (SELECT * FROM store WHERE snapshot_date = (SELECT max(snapshot_date) FROM store WHERE snapshot_date < {TODAY}))
, totals AS (SELECT {FUNNEL_COLS} FROM enriched)
, tot_long AS (
  {" UNION ALL ".join(f"SELECT '{m}' AS metric, {i} AS ord, CAST({m} AS DOUBLE) AS value FROM totals" for i, m in enumerate(_TOF))})
, wow_m AS (
  SELECT market,
    count(*) FILTER (WHERE create_d BETWEEN DATE '1998-08-17' AND {TODAY}) AS this_week,
    count(*) FILTER (WHERE create_d BETWEEN DATE '1998-08-10' AND DATE '1998-08-16') AS last_week
  FROM clean GROUP BY market)
, actions AS (
  SELECT CAST(year(create_d) AS VARCHAR) || 'Q' || CAST(quarter(create_d) AS VARCHAR) AS quarter,
         CASE WHEN stage IN ('OPP – Proposal/ROI', 'OPP – Negotiation') THEN 'Booking' ELSE 'TOF' END AS meeting,
         CAST(deal_id AS BIGINT) AS pos,
         CASE WHEN next_step IS NULL THEN '  ' ELSE action || ': ' || dealname END AS text,
         owner_name AS owner,
         CASE deal_id % 4 WHEN 0 THEN 'Open' WHEN 1 THEN 'In progress' WHEN 2 THEN 'Done' ELSE 'Blocked' END AS status,
         create_d AS added
  FROM scored WHERE rag = 'Red')"""

ORACLE_SQL["historical_snapshots"] = f"""{STATE}
SELECT * FROM hist"""


def _pace(metric_sql: str, day_col: str, flag: str, goal_metric: str) -> str:
    return f"""{STATE}
, days AS (SELECT CAST(generate_series AS DATE) AS day FROM generate_series({QS}, {QE}, INTERVAL 1 DAY))
, daily AS (SELECT {day_col} AS day, {metric_sql} AS v FROM enriched WHERE {flag} GROUP BY {day_col})
, cum AS (SELECT days.day, sum(coalesce(daily.v, 0)) OVER (ORDER BY days.day ROWS UNBOUNDED PRECEDING) AS c
          FROM days LEFT JOIN daily ON daily.day = days.day)
, g AS (SELECT goal_total AS goal FROM gtot WHERE metric = '{goal_metric}')
SELECT day, CASE WHEN day <= {TODAY} THEN CAST(c AS DOUBLE) END AS actual_cum,
       CASE WHEN g.goal <> 0 THEN round(g.goal * date_diff('day', {QS}, day) / 91, 6) END AS target
FROM cum, g"""


ORACLE_SQL["pace_cumulative_arr"] = _pace("sum(arr)", "close_d", "is_book", "bookings_arr")
ORACLE_SQL["pace_cumulative_sql"] = _pace("count(*)", "create_d", "is_sql", "sql_booked")

ORACLE_SQL["trend_weekly"] = f"""{STATE}
, wide AS (
  SELECT snapshot_date,
         max(value) FILTER (WHERE metric = 'tof_sql_booked') AS sql_booked,
         max(value) FILTER (WHERE metric = 'tof_sql_held') AS sql_held,
         max(value) FILTER (WHERE metric = 'tof_sal') AS sal,
         max(value) FILTER (WHERE metric = 'tof_bookings_arr') AS bookings_arr
  FROM (SELECT * FROM store WHERE snapshot_date <> {TODAY} OR NOT starts_with(metric, 'tof_')
        UNION ALL SELECT {TODAY}, 'tof_' || metric, value FROM tot_long) GROUP BY snapshot_date)
SELECT *, lag(sql_booked) OVER (ORDER BY snapshot_date) AS prev_sql_booked
FROM wide WHERE sql_booked IS NOT NULL"""

ORACLE_SQL["goals_for_quarter"] = f"""{STATE}
SELECT * FROM gq"""

_MS = STATE + SPINE_MARKET.replace("\n, mf AS", "\n, mf AS", 1)

ORACLE_SQL["goals_upsert"] = f"""{_MS}
, upd AS (SELECT '1998Q3' AS quarter, market, 'sql_held' AS metric, round(CAST(sql_held AS DOUBLE) * 2, 0) AS value
          FROM mspine)
SELECT * FROM goals g WHERE NOT EXISTS (
  SELECT 1 FROM upd u WHERE u.quarter = g.quarter AND u.market = g.market AND u.metric = g.metric)
UNION ALL SELECT * FROM upd"""

ORACLE_SQL["goals_replace_quarter"] = f"""{_MS}
, upd AS ({" UNION ALL ".join(f"SELECT '1998Q3' AS quarter, market, '{m}' AS metric, round(CAST({m} AS DOUBLE) * 2, 0) AS value FROM mspine" for m in _GOAL_METRICS)})
SELECT * FROM goals WHERE quarter <> '1998Q3'
UNION ALL SELECT * FROM upd"""

ORACLE_SQL["goal_totals"] = f"""{STATE}
SELECT metric, ord, goal_total FROM gtot"""

_ATT = f"""{_MS}
, ma AS (
  SELECT l.market, l.ord, l.metric, l.actual, gq.value AS goal,
         round(100 * l.actual / nullif(gq.value, 0.0), 6) AS attainment_pct
  FROM ({" UNION ALL ".join(f"SELECT market, ord, '{m}' AS metric, CAST({m} AS DOUBLE) AS actual FROM mspine" for m in _GOAL_METRICS)}) l
  LEFT JOIN gq ON gq.market = l.market AND gq.metric = l.metric)
, ma2 AS (
  SELECT *, CASE WHEN attainment_pct IS NULL THEN NULL WHEN attainment_pct >= 53.3 THEN 'Green'
                 WHEN attainment_pct >= 33.3 THEN 'Yellow' ELSE 'Red' END AS status
  FROM ma)"""

ORACLE_SQL["market_attainment"] = f"""{_ATT}
SELECT * FROM ma2"""

ORACLE_SQL["snapshot_history"] = f"""{STATE}
SELECT * FROM store"""

ORACLE_SQL["snapshot_capture"] = f"""{STATE}
, cap AS MATERIALIZED (SELECT {TODAY} AS snapshot_date, 'tof_' || metric AS metric, value FROM tot_long)
SELECT s.snapshot_date, s.metric, s.value FROM store s
ANTI JOIN cap c ON c.snapshot_date = s.snapshot_date AND c.metric = s.metric
UNION ALL SELECT snapshot_date, metric, value FROM cap"""

ORACLE_SQL["stored_snapshots_captured"] = ORACLE_SQL["snapshot_capture"]

ORACLE_SQL["stored_goals_emptied"] = f"""{STATE}
SELECT * FROM goals WHERE quarter <> '1998Q3'"""

ORACLE_SQL["stored_actions_emptied"] = f"""{STATE}
SELECT * FROM actions WHERE NOT (quarter = '1998Q3' AND meeting = 'Booking')"""

ORACLE_SQL["snapshot_backfill"] = f"""{STATE}
SELECT * FROM seed s WHERE NOT EXISTS (
  SELECT 1 FROM hist h WHERE h.snapshot_date = s.snapshot_date AND h.metric = s.metric)
UNION ALL SELECT * FROM hist"""

ORACLE_SQL["snapshot_missing_dates"] = f"""{STATE}
SELECT snapshot_date FROM missing"""

ORACLE_SQL["snapshot_sync"] = f"""{STATE}
SELECT * FROM store"""

ORACLE_SQL["snapshot_movement"] = f"""{STATE}
, dates AS (SELECT snapshot_date, lag(snapshot_date) OVER (ORDER BY snapshot_date) AS prior_date
            FROM (SELECT DISTINCT snapshot_date FROM store))
SELECT s.snapshot_date, s.metric, s.value, d.prior_date, p.value AS prior, round(s.value - p.value, 2) AS delta,
       round(100 * (s.value - p.value) / nullif(p.value, 0.0), 6) AS delta_pct
FROM store s JOIN dates d USING (snapshot_date)
LEFT JOIN store p ON p.snapshot_date = d.prior_date AND p.metric = s.metric"""

ORACLE_SQL["history_after_changes"] = ORACLE_SQL["historical_snapshots"]

ORACLE_SQL["open_pipeline_page"] = ORACLE_SQL["open_pipeline_full"].rstrip() + " ORDER BY acv DESC NULLS LAST, deal_id LIMIT 50 OFFSET 100"

ORACLE_SQL["snapshot_latest_before"] = f"""{STATE}
SELECT * FROM prior"""

ORACLE_SQL["actions_list"] = f"""{STATE}
, l AS (SELECT * FROM actions WHERE quarter = '1998Q3' AND meeting = 'Booking')
SELECT * FROM l
UNION ALL SELECT '1998Q3', 'Booking', CAST(1 AS BIGINT), '', '', 'Open', {TODAY} WHERE NOT EXISTS (SELECT 1 FROM l)"""

ORACLE_SQL["goal_for"] = f"""{STATE}
SELECT (SELECT max(value) FROM gq WHERE market = 'Sage' AND metric = 'bookings_arr') AS sage_bookings_arr,
       (SELECT max(value) FROM gq WHERE market = 'Dynamics' AND metric = 'sql_held') AS dynamics_sql_held"""

ORACLE_SQL["actions_add"] = f"""{STATE}
, top AS (SELECT dealname, owner_name FROM scored WHERE rag = 'Red' ORDER BY acv DESC NULLS LAST, deal_id LIMIT 1)
SELECT * FROM actions
UNION ALL
SELECT '1998Q3', 'Booking',
       CAST(coalesce((SELECT max(pos) FROM actions WHERE quarter = '1998Q3' AND meeting = 'Booking'), 0) + 1 AS BIGINT),
       'Review ' || dealname, owner_name, 'Open', {TODAY}
FROM top"""

ORACLE_SQL["actions_replace"] = f"""{_POD_BASE.replace(PRELUDE + SCORED, STATE, 1)}
, items AS (
  SELECT CAST(dense_rank() OVER (ORDER BY pod) AS BIGINT) AS pos,
         CASE WHEN exec_support = 'None this week' THEN '' ELSE pod || ': ' || exec_support END AS text,
         pod AS owner, 'Open' AS status, {TODAY} AS added
  FROM (SELECT * FROM detail WHERE deals >= 3 OR NOT EXISTS (SELECT 1 FROM detail d2 WHERE d2.deals >= 3)
        ORDER BY acv DESC, pod LIMIT 8))
SELECT * FROM actions WHERE NOT (quarter = '1998Q3' AND meeting = 'Booking')
UNION ALL
SELECT '1998Q3', 'Booking', pos, text, owner, status, added FROM items
WHERE {_strip("coalesce(text, '')")} <> '' AND status IN ('Open', 'In progress', 'Done', 'Blocked')"""


def _grouped(x: str) -> str:
    return f"printf('%,.0f', CAST({x} AS DOUBLE))"


def _fixed0(x: str) -> str:
    return f"printf('%.0f', CAST({x} AS DOUBLE))"


ORACLE_SQL["exec_summary_tof"] = f"""{STATE}
, wt AS (SELECT round(100 * (sum(this_week) - sum(last_week)) / CAST(nullif(sum(last_week), 0) AS DOUBLE), 6) AS w
         FROM wow_m)
, j AS (
  SELECT t.metric, CAST(t.ord AS INTEGER) AS ord, t.value, p.value AS prior, coalesce(g.goal_total, 0.0) AS plan
  FROM tot_long t
  LEFT JOIN prior p ON p.metric = 'tof_' || t.metric
  LEFT JOIN gtot g ON g.metric = t.metric)
SELECT metric, ord, value,
       CASE WHEN metric = 'sql_booked' THEN (SELECT w FROM wt)
            ELSE round(100 * (value - prior) / nullif(prior, 0.0), 6) END AS delta_pct,
       plan, round(100 * value / nullif(plan, 0.0), 6) AS attainment_pct,
       CASE WHEN metric IN ('pipeline_arr', 'pipeline_acv', 'bookings_arr', 'bookings_acv') THEN {_money("value")}
            ELSE {_grouped("value")} END AS value_text
FROM j"""

ORACLE_SQL["run_rate"] = f"""{STATE}
, j AS (SELECT t.metric, t.value AS qtd, t.value / (53.3 / 100) AS proj, coalesce(g.goal_total, 0.0) AS plan
        FROM tot_long t LEFT JOIN gtot g ON g.metric = t.metric
        WHERE t.metric IN ('sql_booked', 'bookings_arr'))
SELECT metric, qtd, round(proj, 6) AS projection, plan,
       CASE WHEN metric = 'bookings_arr' THEN {_money("proj")} ELSE {_grouped("proj")} END AS projection_text
FROM j"""

ORACLE_SQL["quarter_health"] = f"""{STATE}
, v AS (
  SELECT CAST(t.bookings_arr AS DOUBLE) AS bookings_arr,
         (SELECT goal_total FROM gtot WHERE metric = 'bookings_arr') AS plan_bookings_arr,
         t.sql_booked, t.sql_booked / (53.3 / 100) AS proj,
         (SELECT goal_total FROM gtot WHERE metric = 'sql_booked') AS plan_sql_booked
  FROM totals t)
, a AS (SELECT *, round(100 * bookings_arr / nullif(plan_bookings_arr, 0.0), 6) AS attainment_pct FROM v)
SELECT bookings_arr, plan_bookings_arr, attainment_pct, CAST(53.3 AS DOUBLE) AS pace_pct,
       CASE WHEN attainment_pct IS NULL THEN 'Yellow' WHEN attainment_pct >= 53.3 THEN 'Green'
            WHEN attainment_pct >= 33.3 THEN 'Yellow' ELSE 'Red' END AS status,
       sql_booked, round(proj, 6) AS sql_projection, plan_sql_booked,
       (plan_sql_booked <> 0 AND proj < plan_sql_booked) AS behind_pace
FROM a"""


def _triple(v: str, wow: str, att: str, money: bool) -> str:
    cur = _money(v) if money else _grouped(v)
    return (f"CASE WHEN {wow} IS NULL AND {att} IS NULL THEN {cur} ELSE {cur} || ' (' || "
            f"coalesce(printf('%+.0f', {wow}) || '%', '–') || ', ' || coalesce(printf('%.0f', {att}) || '%', '–') || ')' END")


def _att(m: str) -> str:
    return f"round(100 * CAST(s.{m} AS DOUBLE) / nullif(gp.g_{m}, 0.0), 6)"


ORACLE_SQL["market_scorecard"] = f"""{_MS}
, gp AS (SELECT market, {", ".join(f"max(value) FILTER (WHERE metric = '{m}') AS g_{m}" for m in _GOAL_METRICS)}
         FROM gq GROUP BY market)
, w AS (SELECT market, round(100 * (this_week - last_week) / CAST(nullif(last_week, 0) AS DOUBLE), 6) AS wow_pct
        FROM wow_m)
SELECT s.market, s.ord,
       {_triple("s.sql_booked", "w.wow_pct", _att("sql_booked"), False)} AS sql_booked,
       {_triple("s.sql_held", "NULL", _att("sql_held"), False)} AS sql_held,
       {_triple("s.sal", "NULL", _att("sal"), False)} AS sal,
       {_triple("s.pipeline_arr", "NULL", _att("pipeline_arr"), True)} AS pipeline_arr,
       {_triple("s.bookings_arr", "NULL", _att("bookings_arr"), True)} AS bookings_arr,
       {_money("s.bookings_acv")} AS bookings_acv
FROM mspine s LEFT JOIN w ON w.market = s.market LEFT JOIN gp ON gp.market = s.market"""

ORACLE_SQL["strategic_priorities"] = f"""{_ATT}{SPINE_GTM}
, mk AS (
  SELECT CASE a.market WHEN 'NetSuite' THEN 0 WHEN 'Sage' THEN 1 ELSE 2 END AS ord,
         CASE a.market WHEN 'NetSuite' THEN 'Are we winning the NetSuite install base?'
                     WHEN 'Sage' THEN 'Is Sage continuing to scale?' ELSE 'Is Dynamics improving?' END AS question,
         'Bookings ' || {_money("a.actual")}
           || CASE WHEN a.attainment_pct IS NULL THEN ' · no goal set'
                   ELSE ' · ' || {_fixed0("a.attainment_pct")} || '% to plan (pace 53%)' END
           || ' · pipeline ' || {_money("s.pipeline_arr")} AS detail,
         a.status
  FROM ma2 a JOIN mspine s ON s.market = a.market
  WHERE a.metric = 'bookings_arr' AND a.market IN ('NetSuite', 'Sage', 'Dynamics'))
, pf AS (SELECT coalesce(sum(acv) FILTER (WHERE is_sql AND product = 'AP'), 0) AS pa,
                coalesce(sum(acv) FILTER (WHERE is_book AND product = 'AP'), 0) AS ba FROM enriched)
SELECT * FROM mk
UNION ALL
SELECT 3, 'Is Outbound recovering?',
       'BDR: ' || CAST(sql_booked AS VARCHAR) || ' SQL-Booked · ' || {_money("pipeline_arr")}
         || ' pipeline (QTD). Trend needs snapshot history.', NULL
FROM gspine WHERE gtm = 'BDR'
UNION ALL
SELECT 4, 'Is AP becoming a repeatable growth engine?',
       'AP: ' || {_money("pa")} || ' pipeline · ' || {_money("ba")} || ' bookings (QTD).', NULL FROM pf
UNION ALL
SELECT 5, 'Is Global FX proving the motion?', 'No FX field in the CRM yet — needs a definition (RevOps).', NULL"""

_COV = f"""{STATE}
, cv AS (
  SELECT (SELECT goal_total FROM gtot WHERE metric = 'bookings_arr') AS plan,
         (SELECT CAST(bookings_arr AS DOUBLE) FROM totals) AS bookings_arr_qtd,
         CAST(coalesce(sum(arr), 0) AS DOUBLE) AS open_arr,
         CAST(coalesce(sum(acv) FILTER (WHERE forecast_cat = 'Commit'), 0) AS DOUBLE) AS commit_acv,
         CAST(coalesce(sum(acv) FILTER (WHERE forecast_cat = 'Commit' AND close_d <= {QE}), 0) AS DOUBLE) AS q_commit
  FROM scored)
, cv2 AS (SELECT *, greatest(plan - bookings_arr_qtd, 0.0) AS gap FROM cv)
, cov AS (
  SELECT plan, bookings_arr_qtd, open_arr, gap, round(open_arr / nullif(gap, 0.0), 6) AS coverage,
         CASE WHEN plan = 0 THEN 'no_goal' WHEN gap = 0 THEN 'plan_met'
              WHEN open_arr / nullif(gap, 0.0) >= 3 THEN 'healthy' ELSE 'thin' END AS coverage_state,
         commit_acv, round(100 * commit_acv / nullif(plan, 0.0), 6) AS commit_acv_pct_of_arr_plan,
         round(100 * bookings_arr_qtd / nullif(plan, 0.0), 6) AS bookings_arr_pct_of_plan,
         round(100 * q_commit / nullif(plan, 0.0), 6) AS quarter_commit_pct_of_arr_plan
  FROM cv2)"""

ORACLE_SQL["pipeline_coverage"] = f"""{_COV}
SELECT * FROM cov"""

ORACLE_SQL["exec_forecast"] = f"""{STATE}
, p AS (SELECT goal_total AS plan FROM gtot WHERE metric = 'bookings_arr')
, v AS (
  SELECT 'Commit (Q)' AS gauge, 0 AS ord, bk_commit AS value, 1.5 AS mult FROM bk
  UNION ALL SELECT 'Commit + Best', 1, round(bk_commit + bk_best, 2), 1.3 FROM bk
  UNION ALL SELECT 'Weighted (illustrative)', 2, bk_weighted, 1.3 FROM bk
  UNION ALL SELECT 'Total open (Q)', 3, bk_q_total, 1.0 FROM bk)
SELECT gauge, CAST(ord AS INTEGER) AS ord, value,
       CASE WHEN p.plan <> 0 THEN p.plan ELSE round(value * mult, 6) END AS reference
FROM v, p"""

ORACLE_SQL["booking_snapshot"] = f"""{STATE}
SELECT {TODAY} AS snapshot_date, metric, value FROM bk_long"""

ORACLE_SQL["tof_snapshot"] = f"""{STATE}
SELECT {TODAY} AS snapshot_date, 'tof_' || metric AS metric, value FROM tot_long"""

ORACLE_SQL["forecast_movement"] = f"""{STATE}
, now AS (
  SELECT 'tof_bookings_arr' AS metric, 'Bookings ARR (QTD)' AS label, 0 AS ord, CAST(bookings_arr AS DOUBLE) AS now
  FROM totals
  UNION ALL SELECT 'bk_commit', 'Commit', 1, bk_commit FROM bk
  UNION ALL SELECT 'bk_best', 'Best Case', 2, bk_best FROM bk
  UNION ALL SELECT 'bk_weighted', 'Weighted', 3, bk_weighted FROM bk
  UNION ALL SELECT 'bk_q_total', 'Total open (Q)', 4, bk_q_total FROM bk)
, j AS (SELECT n.*, p.value AS last_week, n.now - p.value AS d FROM now n LEFT JOIN prior p ON p.metric = n.metric
        WHERE n.metric <> 'tof_bookings_arr' OR p.value IS NOT NULL)
SELECT label, CAST(ord AS INTEGER) AS ord, last_week, now, round(d, 2) AS delta,
       CASE WHEN last_week IS NULL THEN '— (accrues fwd)' ELSE {_money("last_week")} END AS last_week_text,
       {_money("now")} AS now_text,
       CASE WHEN d IS NULL THEN '—' ELSE (CASE WHEN d >= 0 THEN '+' ELSE '' END) || {_money("d")} END AS delta_text
FROM j"""

ORACLE_SQL["decisions"] = f"""{_COV.replace(STATE, _MS + SPINE_GTM, 1)}
, hy AS (SELECT count(*) AS n_open, count(*) FILTER (WHERE is_forecasted) AS categorized FROM scored)
, tof AS (
  SELECT t.sql_booked, CAST(t.sql_booked AS DOUBLE) / (53.3 / 100) AS proj, CAST(t.bookings_arr AS DOUBLE) AS bk,
         (SELECT goal_total FROM gtot WHERE metric = 'sql_booked') AS plan_s,
         (SELECT goal_total FROM gtot WHERE metric = 'bookings_arr') AS plan_b
  FROM totals t)
, tof2 AS (SELECT *, round(100 * bk / nullif(plan_b, 0.0), 6) AS bk_att FROM tof)
, lead AS (SELECT market, bookings_arr FROM mspine ORDER BY bookings_arr DESC, ord LIMIT 1)
, lag AS (SELECT market, bookings_arr FROM mspine WHERE market <> 'Other' ORDER BY bookings_arr, ord LIMIT 1)
, top_e AS (SELECT gtm FROM gspine ORDER BY sql_booked DESC, ord LIMIT 1)
, cm AS (SELECT market, sum(acv) AS acv FROM scored WHERE forecast_cat = 'Commit' GROUP BY market
         ORDER BY coalesce(sum(acv), 0) DESC, market LIMIT 1)
, rm AS (SELECT market, sum(acv) AS acv FROM scored WHERE rag = 'Red' GROUP BY market
         ORDER BY coalesce(sum(acv), 0) DESC, market LIMIT 1)
, bf AS (
  SELECT c.*, bk.bk_commit, bk.bk_best, round(100 * bk.bk_commit / nullif(c.plan, 0.0), 6) AS q_att,
         hy.n_open, hy.categorized
  FROM cov c, bk, hy)
SELECT 'tof_summary' AS section, 0 AS ord,
       'sql_booked=' || {_grouped("sql_booked")} || ' projected=' || {_grouped("proj")} || ' plan=' || {_grouped("plan_s")}
         || ' bookings=' || {_money("bk")} || ' plan_pct=' || coalesce({_fixed0("bk_att")}, '—') || ' elapsed_pct=53' AS figures,
       CASE WHEN plan_s <> 0 AND proj < plan_s THEN 'creation_behind_pace' ELSE 'creation_on_pace' END AS decision
FROM tof2
UNION ALL
SELECT 'market', 1, 'lead=' || lead.market || ' ' || {_money("lead.bookings_arr")}
         || ' lag=' || lag.market || ' ' || {_money("lag.bookings_arr")}, 'review_market:' || lag.market
FROM lead, lag
UNION ALL
SELECT 'gtm', 2, 'top=' || top_e.gtm || ' channel_sql_booked='
         || CAST((SELECT sql_booked FROM gspine WHERE gtm = 'Channels') AS VARCHAR), 'back_engine:' || top_e.gtm
FROM top_e
UNION ALL
SELECT 'booking_forecast', 3,
       'commit=' || {_money("bk_commit")} || ' plan_pct=' || coalesce({_fixed0("q_att")}, '—')
         || ' commit_best=' || {_money("bk_commit + bk_best")} || ' coverage=' || coalesce(printf('%.1f', coverage), '—')
         || ' gap=' || {_money("gap")} || ' categorized=' || CAST(categorized AS VARCHAR) || '/' || CAST(n_open AS VARCHAR),
       CASE WHEN q_att IS NULL OR q_att < 53.3 THEN 'commit_short' ELSE 'commit_on_pace' END
         || CASE WHEN coverage IS NULL OR coverage >= 3 THEN '' ELSE '+coverage_thin' END
FROM bf
UNION ALL
SELECT 'market_forecast', 4,
       'commit_market=' || coalesce((SELECT market FROM cm), '—') || ' ' || coalesce((SELECT {_money("coalesce(acv, 0)")} FROM cm), '—')
         || ' red_market=' || coalesce((SELECT market FROM rm), '—') || ' ' || coalesce((SELECT {_money("coalesce(acv, 0)")} FROM rm), '—'),
       'inspect_market:' || coalesce((SELECT market FROM rm), '—')
UNION ALL
SELECT 'trends', 5, 'weeks=' || CAST(n + 1 AS VARCHAR) || ' latest=' || {_grouped("sql_booked")} || ' previous=' || {_grouped("prev")},
       CASE WHEN sql_booked < prev THEN 'creation_fell' ELSE 'creation_rose_or_held' END
FROM totals, (SELECT count(value) AS n, arg_max(value, snapshot_date) AS prev FROM store
              WHERE metric = 'tof_sql_booked' AND snapshot_date < {TODAY}) WHERE n >= 1"""

_SP_BOOKING = ORACLE_SQL["strategic_priorities"] \
    .replace("'Are we winning the NetSuite install base?'", "'Is the NetSuite install-base strategy producing bookings?'") \
    .replace("'Is Sage continuing to scale?'", "'Is Sage growth translating into revenue?'") \
    .replace("'Is Outbound recovering?'", "'Is Outbound contributing future pipeline?'") \
    .replace("'Is AP becoming a repeatable growth engine?'", "'Is AP conversion improving?'")
ORACLE_SQL["strategic_priorities_booking"] = _SP_BOOKING

ORACLE_SQL["pod_reviews"] = ORACLE_SQL["pod_reviews"].replace(
    "SELECT * FROM kept ORDER BY acv DESC, pod LIMIT 8",
    "SELECT *, CASE WHEN EXISTS (SELECT 1 FROM prior) THEN 'see Movement' ELSE 'WoW from snapshots (next week)' END"
    " AS what_changed FROM kept ORDER BY acv DESC, pod LIMIT 8").replace(BOOKING, STATE, 1)

# ---------------------------------------------------------------------------------------
# Whole review: the figures of many reports in one long table
# ---------------------------------------------------------------------------------------


def _sheet(spec) -> str:
    parts = []
    for name, (labels, metrics) in spec.items():
        label = f"concat_ws('|', {', '.join(labels)})" if labels else "''"
        names = ", ".join(f"'{m}'" for m in metrics)
        values = ", ".join(f'CAST("{m}" AS DOUBLE)' for m in metrics)
        parts.append(f"SELECT '{name}' AS report, {label} AS label, unnest([{names}]) AS metric, unnest([{values}]) AS value\n"
                     f"FROM ({ORACLE_SQL[name]})")
    return "\nUNION ALL\n".join(parts)


ORACLE_SQL["whole_tof_review"] = _sheet(TOF_SHEET)
ORACLE_SQL["whole_booking_review"] = _sheet(BOOKING_SHEET)
