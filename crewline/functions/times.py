"""Dates and times relative to an explicit as-of moment."""

from __future__ import annotations

from datetime import datetime
from zoneinfo import ZoneInfo

from pyspark.sql import Column, functions as F

DAY_MICROS = 24 * 60 * 60 * 1_000_000


def as_of(moment: datetime, zone: str):
    """Calendar date and wall-clock time of an aware moment in a named zone."""
    local = moment.astimezone(ZoneInfo(zone)).replace(tzinfo=None)
    return local.date(), local


def ntz(value) -> Column:
    """A date or wall-clock literal as a timestamp without zone."""
    return F.lit(value).cast("timestamp_ntz")


def dt_string(ts: Column) -> Column:
    """Fixed form with microseconds."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def try_ts(text: Column) -> Column:
    """Lenient parse; what is no timestamp becomes NULL."""
    return text.try_cast("timestamp_ntz")


def age_days(ts: Column, as_of_ts: datetime) -> Column:
    """Whole 24-hour periods between ``ts`` and the as-of time, rounded down."""
    return F.floor(F.timestamp_diff("MICROSECOND", ts, ntz(as_of_ts)) / DAY_MICROS)


def days_ago(ts: Column, as_of_ts: datetime) -> Column:
    """``Today`` / ``Yesterday`` / ``Nd ago`` / ``Unknown``."""
    age = age_days(ts, as_of_ts)
    return (
        F.when(age.isNull(), "Unknown")
        .when(age == 0, "Today")
        .when(age == 1, "Yesterday")
        .otherwise(F.concat(age.cast("string"), F.lit("d ago")))
    )


def recently_active(ts: Column, as_of_ts: datetime, days: int = 7) -> Column:
    return F.coalesce(age_days(ts, as_of_ts) <= days, F.lit(False))
