"""F21 quarter pacing and the date anchors derived from the as-of date.

These are driver-side scalars computed from ``cfg.today`` (a parameter, not data), so
they become literals in the plan and Catalyst folds them into pushed-down predicates.

Months are counted from year 0, so a quarter is three consecutive month numbers; weekdays come
from the proleptic day number (day 1 is a Monday).
"""
from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

MONDAY, FRIDAY = 1, 5  # day number modulo 7


@dataclass(frozen=True)
class Pacing:
    quarter_key: str
    quarter_start: dt.date
    quarter_end: dt.date          # inclusive
    quarter_label: str
    today: dt.date
    days_in_quarter: int
    days_into_quarter: int
    days_remaining: int
    pct_elapsed: float
    week_start: dt.date           # Monday of today's week
    last_week_start: dt.date
    last_week_end: dt.date        # Sunday before week_start
    week_end: dt.date             # Sunday of today's week
    month_end: dt.date
    first_friday: dt.date         # first Friday on or after quarter start


def first_of(month: int) -> int:
    """Day number of the first day of a month."""
    return dt.date(month // 12, month % 12 + 1, 1).toordinal()


def weekday_from(day: int, weekday: int) -> int:
    """First day number from ``day`` on that falls on ``weekday``."""
    return day + (weekday - day) % 7


def pacing(today: dt.date) -> Pacing:
    now, month = today.toordinal(), today.year * 12 + today.month - 1
    quarter = month // 3  # quarters since year 0
    start, after = first_of(3 * quarter), first_of(3 * quarter + 3)
    monday = weekday_from(now - 6, MONDAY)
    date = dt.date.fromordinal
    year, number = quarter // 4, quarter % 4 + 1
    return Pacing(
        quarter_key=f"{year}Q{number}", quarter_label=f"Q{number} {year}",
        quarter_start=date(start), quarter_end=date(after - 1), today=today,
        days_in_quarter=after - start, days_into_quarter=now - start, days_remaining=after - now,
        # quarters have 90-92 days: no tie at one decimal can occur, so round() is safe
        pct_elapsed=round(100 * (now - start) / (after - start), 1),
        week_start=date(monday), last_week_start=date(monday - 7), last_week_end=date(monday - 1),
        week_end=date(monday + 6), month_end=date(first_of(month + 1) - 1),
        first_friday=date(weekday_from(start, FRIDAY)),
    )
