"""Timestamp arithmetic and calendar parts.

Timestamps are kept as TIMESTAMP_NTZ (naive wall-clock time, like the input),
so differences never cross a time-zone rule.  ``timestamp_diff`` in
microseconds is exact; coarser units would truncate 1.5 minutes to 1.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ticketlens.functions.nullsafe import _c, flag

MICROS_PER_MINUTE = 60_000_000.0
MICROS_PER_HOUR = 3_600_000_000.0
MICROS_PER_DAY = 86_400_000_000.0


def micros_between(start, end) -> Column:
    """``end - start`` in microseconds (signed, NULL if either is NULL)."""
    return F.timestamp_diff("MICROSECOND", _c(start), _c(end))


def minutes_between(start, end) -> Column:
    return micros_between(start, end) / MICROS_PER_MINUTE


def hours_between(start, end) -> Column:
    return micros_between(start, end) / MICROS_PER_HOUR


def days_between(start, end) -> Column:
    return micros_between(start, end) / MICROS_PER_DAY


def weekday_name(col) -> Column:
    """Full English day name (Monday ... Sunday)."""
    return F.date_format(_c(col), "EEEE")


def datetime_parts(col: str, business_start: int = 9, business_end: int = 18) -> dict[str, Column]:
    """``{col}_hour/_day/_day_of_week/_month/_is_weekend/_is_business_hours``.

    Day of week counts Monday as 0.  The two flags are 0 for a missing time.
    Weekends are not excluded from business hours.
    """
    c = F.col(col)
    hour = F.hour(c)
    dow = F.weekday(c)
    return {
        f"{col}_hour": hour,
        f"{col}_day": F.dayofmonth(c),
        f"{col}_day_of_week": dow,
        f"{col}_month": F.month(c),
        f"{col}_is_weekend": flag(dow.isin(5, 6)),
        f"{col}_is_business_hours": flag((hour >= business_start) & (hour < business_end)),
    }
