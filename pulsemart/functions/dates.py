"""Date arithmetic that counts calendar boundaries.

Spark's ``datediff(YEAR, ...)`` / ``timestampdiff`` count full elapsed units. The
warehouse rules reproduced here count how many unit boundaries lie between the two
values, so Saturday to Monday is one week and New Year's Eve to New Year's Day one year.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def days_between(start: Column, end: Column) -> Column:
    """Midnights crossed from start to end."""
    return F.datediff(F.to_date(end), F.to_date(start)).cast("long")


def weeks_between(start: Column, end: Column) -> Column:
    """Mondays crossed from start to end."""
    monday = lambda c: F.trunc(F.to_date(c), "WEEK")
    return (F.datediff(monday(end), monday(start)) / 7).cast("long")


def years_between(start: Column, end: Column) -> Column:
    """Difference of the calendar years (not a birthday age)."""
    return (F.year(end) - F.year(start)).cast("long")


def hours_between(start: Column, end: Column) -> Column:
    """Full-hour marks crossed from start to end."""
    return F.timestamp_diff("HOUR", hour_of(start), hour_of(end)).cast("long")


def month_of(value: Column) -> Column:
    return F.trunc(F.to_date(value), "MONTH")


def day_of(value: Column) -> Column:
    return F.to_date(value)


def hour_of(value: Column) -> Column:
    """Full hour of a zone-free timestamp, without a detour through the session's time zone."""
    return F.to_date(value).cast("timestamp_ntz") + F.make_dt_interval(hours=F.hour(value))


def moment(text: str) -> Column:
    """A zone-free timestamp literal; the explicit stand-in for 'now'."""
    return F.lit(text).cast("timestamp_ntz")


def end_of_time() -> Column:
    """Where an open period ends."""
    return moment("9999-12-31 00:00:00")


def back(as_of: Column, amount: int, unit: str) -> Column:
    """``as_of`` moved back by ``amount`` units (MINUTE, HOUR, DAY, MONTH, YEAR)."""
    return as_of - F.expr(f"INTERVAL {amount} {unit}")
