"""Review configuration: the as-of date, hygiene parameters and the fixed rule values.

Every operator takes a ``ReviewConfig``; nothing reads the wall clock or globals.
"""
from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Fixed values. These must equal the reviewed business rules exactly (labels,
# keyword lists, flag texts, orders); the result text of every report uses them.
# ---------------------------------------------------------------------------

# ERP value -> ecosystem label, tested in this order (exact, exact, contains, exact).
ERP_EXACT_NETSUITE = "Netsuite"
ERP_EXACT_SAGE = "Sage Intacct"
ERP_CONTAINS_DYNAMICS = "Microsoft Dynamics"
ERP_EXACT_ACUMATICA = "Acumatica"
ECO_NETSUITE, ECO_SAGE, ECO_DYNAMICS, ECO_ACUMATICA, ECO_BROAD = (
    "NetSuite", "Sage", "Dynamics", "Acumatica", "Broad Market")

PRIMARY_MARKETS = ("NetSuite", "Sage", "Dynamics")
OTHER_MARKET = "Other"
MARKET_ORDER = ("NetSuite", "Sage", "Dynamics", "Other")

GTM_ENGINES = ("Channels", "Marketing", "BDR", "AE", "Other")
# Substring tests on the lower-cased lead source, first hit wins.
GTM_KEYWORDS = (
    ("Channels", ("channel", "partner", "var", "referral")),
    ("Marketing", ("marketing", "inbound", "demand", "web", "event", "content")),
    ("BDR", ("bdr", "sdr", "outbound", "prospect")),
    ("AE", ("ae", "account exec", "sales", "self", "direct")),
)
# Whole-value spellings of "missing" in text columns.
MISSING_WORDS = ("nan", "none", "<na>", "nat")

PRODUCT_AR = "AR"
PRODUCT_AP_PARTS = ("AP", "EXPENSE MANAGEMENT", "CORPORATE CARDS")

FORECAST_CATEGORY_MAP = {
    "COMMIT": "Commit", "BEST_CASE": "Best Case", "PIPELINE": "Pipeline", "OMIT": "Not Forecasted",
}
FORECAST_ORDER = ("Commit", "Best Case", "Pipeline", "Not Forecasted")
FORECASTED_RAW = ("COMMIT", "BEST_CASE", "PIPELINE")
NOT_FORECASTED = "Not Forecasted"
UNCATEGORIZED = "Uncategorized"

YES_WORDS = ("true", "yes", "1", "won", "identified")
HAS_BLANKS = ("", "None", "nan", "No", "false", "FALSE")

STAGE_SQL = "SQL"
STAGE_SAL = "SAL – Discovery/Demo"
STAGE_PROPOSAL = "OPP – Proposal/ROI"
STAGE_NEGOTIATION = "OPP – Negotiation"
LATE_STAGES = (STAGE_PROPOSAL, STAGE_NEGOTIATION)

FLAG_STALE = "No activity 14d+"
FLAG_SINGLE = "Single-threaded"
FLAG_NO_NEXT = "No next step"
FLAG_NO_EB = "No economic buyer"
FLAG_LATE_WEAK = "Late stage, weak MEDDPICC"
FLAG_ORDER = (FLAG_STALE, FLAG_SINGLE, FLAG_NO_NEXT, FLAG_NO_EB, FLAG_LATE_WEAK)

# Recommended action per flag, and the priority in which flags pick the action.
ACTION_TEXT = {
    FLAG_STALE: "Re-engage — book next touch this week",
    FLAG_SINGLE: "Multi-thread — add a 2nd+ stakeholder",
    FLAG_NO_NEXT: "Set a concrete next step + date",
    FLAG_NO_EB: "Confirm + meet the economic buyer",
    FLAG_LATE_WEAK: "Close MEDDPICC gaps before forecasting",
}
ACTION_PRIORITY = (FLAG_STALE, FLAG_NO_EB, FLAG_LATE_WEAK, FLAG_SINGLE, FLAG_NO_NEXT)
ACTION_ON_TRACK = "On track — maintain cadence"

# Executive-support ask per flag of a pod's biggest risk.
SUPPORT_TEXT = {
    FLAG_NO_EB: "Help access the economic buyer",
    FLAG_STALE: "Unblock stalled engagement",
    FLAG_LATE_WEAK: "Deal inspection / qualification help",
    FLAG_SINGLE: "Exec intro to multi-thread",
    FLAG_NO_NEXT: "Hold rep accountable for next step",
}
SUPPORT_NONE = "None this week"

REC_DOWN_TO_BEST = "Downgrade → Best Case"
REC_DOWN_TO_PIPELINE = "Downgrade → Pipeline"
REC_UPGRADE = "Upgrade"
REC_REMOVE = "Remove from forecast"
REC_ESCALATE = "Escalate for manager review"
REC_KEEP = "Keep current category"

REASON_STALE = "stale 14d+"
REASON_NO_EB = "no EB"
REASON_SINGLE = "single-threaded"
REASON_NO_NEXT = "no next step"
REASON_CLEAN = "clean evidence"
DASH = "—"
EN_DASH = "–"

FUNNEL_METRICS = ("sql_booked", "sql_held", "sal", "pipeline_arr", "pipeline_acv",
                  "bookings_arr", "bookings_acv")
COUNT_METRICS = ("sql_booked", "sql_held", "sal")
MONEY_METRICS = ("pipeline_arr", "pipeline_acv", "bookings_arr", "bookings_acv")
GOAL_METRICS = ("sql_booked", "sql_held", "sal", "pipeline_arr", "bookings_arr")
METRIC_LABELS = {"sql_booked": "SQL-Booked", "sql_held": "SQL-Held", "sal": "SAL",
                 "pipeline_arr": "Pipeline ARR", "pipeline_acv": "Pipeline ACV",
                 "bookings_arr": "Bookings ARR", "bookings_acv": "Bookings ACV"}

ACTION_STATUSES = ("Open", "In progress", "Done", "Blocked")

# Questions of the six strategic priorities, per meeting.
PRIORITY_QUESTIONS = {
    "TOF": (
        "Are we winning the NetSuite install base?",
        "Is Sage continuing to scale?",
        "Is Dynamics improving?",
        "Is Outbound recovering?",
        "Is AP becoming a repeatable growth engine?",
        "Is Global FX proving the motion?",
    ),
    "Booking": (
        "Is the NetSuite install-base strategy producing bookings?",
        "Is Sage growth translating into revenue?",
        "Is Dynamics improving?",
        "Is Outbound contributing future pipeline?",
        "Is AP conversion improving?",
        "Is Global FX proving the motion?",
    ),
}
FX_DETAIL = "No FX field in the CRM yet — needs a definition (RevOps)."

GAUGE_MULTIPLES = (("Commit (Q)", 1.5), ("Commit + Best", 1.3),
                   ("Weighted (illustrative)", 1.3), ("Total open (Q)", 1.0))


@dataclass(frozen=True)
class ReviewConfig:
    """Parameters of one review run. ``today`` is the snapshot (as-of) date."""

    today: dt.date = dt.date(1998, 8, 19)
    pipeline_id: str = "default"
    test_deal_names: tuple[str, ...] = ("Test Deal A",)
    excluded_source_substrings: tuple[str, ...] = ("legacyapp", "bulk data")
    machine_source_labels: tuple[str, ...] = ("INTEGRATION", "IMPORT")
    stage_labels: tuple[tuple[str, str], ...] = (
        ("s_sql", STAGE_SQL), ("s_sal", STAGE_SAL),
        ("s_prop", STAGE_PROPOSAL), ("s_neg", STAGE_NEGOTIATION))
    open_stage_ids: tuple[str, ...] = ("s_sal", "s_prop", "s_neg")
    stale_days: int = 14
    long_silence_days: int = 30
    min_score: int = 3
    upgrade_score: int = 4
    remove_score: int = 1
    discipline_green: float = 70.0
    discipline_yellow: float = 40.0
    pace_yellow_band: float = 20.0
    coverage_healthy: float = 3.0
    null_contact_is_stale: bool = True
    watchlist_n: int = 12
    top_red_n: int = 5
    pod_cards: int = 8
    pod_min_deals: int = 3
    top_partners: int = 8
    deal_url_template: str = "https://crm.example.com/deal/{deal_id}"


DEFAULT_CONFIG = ReviewConfig()
