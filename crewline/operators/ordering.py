"""Sorts, top rows and the past / future split."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from crewline.functions.times import ntz


def top_n(df: DataFrame, order: Sequence[str | Column], n: int) -> DataFrame:
    """First n rows; each task keeps n, so nothing is sorted as a whole."""
    return df.orderBy(*order).limit(n)


def with_bucket(df: DataFrame, column: str, as_of_ts: datetime) -> DataFrame:
    """``past`` before the as-of time, ``future`` from it on; rows without a time drop out."""
    now = ntz(as_of_ts)
    bucket = F.when(F.col(column) < now, "past").when(F.col(column) >= now, "future")
    return df.withColumn("bucket", bucket).where(F.col("bucket").isNotNull())


def split_past_future(df: DataFrame, column: str, as_of_ts: datetime, tie: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Past rows newest first, future rows soonest first."""
    rows = with_bucket(df, column, as_of_ts)
    past = rows.where(F.col("bucket") == "past").orderBy(F.col(column).desc(), *tie)
    future = rows.where(F.col("bucket") == "future").orderBy(F.col(column).asc(), *tie)
    return past, future
