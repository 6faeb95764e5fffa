"""Row filters."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from crewline.functions.times import ntz


def for_key(df: DataFrame, key: str, value=None) -> DataFrame:
    """All keys, or one when a value is given."""
    return df if value is None else df.where(F.col(key) == F.lit(value))


def between_dates(df: DataFrame, column: str, first: date, last: date) -> DataFrame:
    """Closed range of days."""
    return df.where(F.col(column).between(F.lit(first), F.lit(last)))


def in_window(df: DataFrame, column: str, start: datetime, end: datetime) -> DataFrame:
    """Half-open range of moments."""
    return df.where((F.col(column) >= ntz(start)) & (F.col(column) < ntz(end)))


def active_since(df: DataFrame, column: str, as_of_ts: datetime, days: int) -> DataFrame:
    return df.where(F.col(column) >= ntz(as_of_ts - timedelta(days=days)))


def at_snapshot(df: DataFrame, column: str, first: date, last: date | None = None) -> DataFrame:
    """One snapshot day, or the days from ``first`` to ``last``."""
    return between_dates(df, column, first, last or first)


def latest_snapshot(df: DataFrame, column: str, *preds: Column) -> DataFrame:
    """Rows of the last day that the same predicates leave; the day is a scalar subquery."""
    kept = df.where(both(preds)) if preds else df
    return kept.where(F.col(column) == kept.agg(F.max(column)).scalar())


def ne_or_null(column: Column, value) -> Column:
    return ~column.eqNullSafe(F.lit(value))


def both(preds: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, preds, F.lit(True))


def filter_in(df: DataFrame, choices: Mapping[str, Iterable]) -> DataFrame:
    """Keep chosen values per column; an empty choice does not filter."""
    picked = {name: list(values) for name, values in choices.items() if values}
    return df.where(both(F.col(name).isin(values) for name, values in picked.items())) if picked else df
