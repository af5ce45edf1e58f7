"""Event-time features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hour bounds [start, end) over midnight.
FEATURE_HOURS = (21, 6)
REPORT_HOURS = (22, 6)


def parse_timestamp(text: Column) -> Column:
    """A date with an optional time, fraction and zone, after a blank or ``T``; null for anything else.

    Fractions beyond microseconds are cut. A time without a date, which Spark would take for today, is null.
    """
    return F.when(text.rlike(r"^\s*\d{4}-\d"), F.try_to_timestamp(text))


def hour_of(ts: Column) -> Column:
    return F.hour(ts)


def hour_or_default(ts: Column) -> Column:
    return F.coalesce(F.hour(ts), F.lit(-1))


def day_of_week(ts: Column) -> Column:
    """Monday is 0."""
    return F.weekday(ts)


def in_unusual_hours(ts: Column, hours: tuple[int, int] = FEATURE_HOURS) -> Column:
    """True from ``start`` on and before ``end``, over midnight if ``end`` is not later; false without a time."""
    start, end = hours
    hour = F.hour(ts)
    inside = (hour >= start) & (hour < end) if start < end else (hour >= start) | (hour < end)
    return F.coalesce(inside, F.lit(False))


def is_unusual_time(ts: Column, hours: tuple[int, int] = FEATURE_HOURS) -> Column:
    return in_unusual_hours(ts, hours).cast("int")


def event_date(ts: Column) -> Column:
    return F.to_date(ts)


def run_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMddHHmm")
