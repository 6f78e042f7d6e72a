"""Date, lateness and reporting-window expressions."""

from __future__ import annotations

from datetime import date, datetime, time, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanewise.fixed_values import (
    DEFAULT_LOOKBACK_DAYS, PAYMENT_TERMS_DAYS, REPORT_MAX_DAYS, REPORT_MIN_DAYS,
)


def today_utc() -> date:
    return datetime.now(timezone.utc).date()


def as_date(value: date | str) -> date:
    return date.fromisoformat(value) if isinstance(value, str) else value


def spend_day(day: date | str | None = None) -> date:
    """The day the spend job processes: yesterday unless named."""
    return as_date(day) if day is not None else today_utc() - timedelta(days=1)


def scorecard_window(end: date | str | None = None,
                     lookback_days: int = DEFAULT_LOOKBACK_DAYS) -> tuple[date, date]:
    """First and last day of the rolling window.  Both count, so lookback 30 spans 31 dates."""
    last = as_date(end) if end is not None else today_utc()
    return last - timedelta(days=lookback_days), last


def within_days(col: Column, first: date, last: date) -> Column:
    """``first <= date(col) <= last`` as a half-open range on the raw column, so it pushes down."""
    start = datetime.combine(first, time.min)
    stop = datetime.combine(last + timedelta(days=1), time.min)
    return (col >= F.lit(start.isoformat(" "))) & (col < F.lit(stop.isoformat(" ")))


def check_report_days(days: int) -> int:
    if not REPORT_MIN_DAYS <= days <= REPORT_MAX_DAYS:
        raise ValueError(f"days must be between {REPORT_MIN_DAYS} and {REPORT_MAX_DAYS}")
    return days


def since(col: Column, as_of: date | str, days: int) -> Column:
    """``col`` on or after ``days`` days before ``as_of``."""
    start = as_date(as_of) - timedelta(days=check_report_days(days))
    return col >= F.lit(start.isoformat())


def on_time(actual: Column, estimated: Column, grain: str = "timestamp") -> Column:
    """Delivered by the promise; unknown counts as late.

    The spend cube compares instants; the scorecard compares calendar dates.
    """
    if grain == "date":
        actual, estimated = F.to_date(actual), F.to_date(estimated)
    elif grain != "timestamp":
        raise ValueError(f"unknown grain {grain!r}")
    return F.coalesce(actual <= estimated, F.lit(False))


def whole_days(start: Column, end: Column) -> Column:
    """Complete 24-hour days from start to end, toward zero; NULL if either is unknown."""
    return F.timestamp_diff("DAY", start, end)


def days_variance(actual: Column, estimated: Column) -> Column:
    """Whole days the delivery was early (+) or late (-); 0 if either is unknown."""
    return F.coalesce(whole_days(actual, estimated), F.lit(0)).cast("int")


def payment_due(invoice_date: Column, terms_days: int = PAYMENT_TERMS_DAYS) -> Column:
    return F.date_add(invoice_date, terms_days)
