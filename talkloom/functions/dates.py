"""Dates from unix seconds, in UTC or a given zone, as column expressions. ``as_of`` is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utc_day(seconds: Column) -> Column:
    return F.to_date(F.timestamp_seconds(seconds))


def local_day(seconds: Column, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(F.timestamp_seconds(seconds), zone))


def days_between(a: Column, b: Column, zone: str = "UTC") -> Column:
    """Calendar days from ``a`` to ``b``."""
    return F.datediff(local_day(b, zone), local_day(a, zone))


def month_key(seconds: Column, zone: str = "UTC") -> Column:
    return F.last_day(local_day(seconds, zone))


def relative_text(seconds: Column, as_of: Column, zone: str = "UTC") -> Column:
    """Time today, weekday within a week, else the date."""
    at = F.from_utc_timestamp(F.timestamp_seconds(seconds), zone)
    days = days_between(seconds, as_of, zone)
    return F.when(days == 0, F.date_format(at, "HH:mm")).when(days.between(1, 6), F.date_format(at, "EEE")).otherwise(F.date_format(at, "yyyy-MM-dd"))


def duration_text(seconds: Column) -> Column:
    """h:mm:ss, or mm:ss below an hour."""
    m, s = F.floor(seconds / 60) % 60, seconds % 60
    h = F.floor(seconds / 3600)
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%02d:%02d", m, s))


def month_step(day: Column, months: int) -> Column:
    """First day of the month that many months on."""
    return F.trunc(F.add_months(day, months), "month")


def weekday_column(day: Column, first: int = 2) -> Column:
    """0-based column of a day in a calendar whose weeks begin with ``first`` (1 Sunday, 2 Monday)."""
    return F.pmod(F.dayofweek(day) - first, F.lit(7))
