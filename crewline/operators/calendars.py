"""Per-day lists and month grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from crewline.functions.shifts import day_class


def day_lists(df: DataFrame, keys: Sequence[str], entry: Sequence[str]) -> DataFrame:
    """Sorted entries per key, equal ones folded into one with a count ``n``.

    The fold comes first, on the map side, so a list is as long as its key has different entries,
    however many rows there are; ``n`` keeps the number of rows. Rows with a NULL key belong to no list.
    """
    for key in keys:
        df = df.where(F.col(key).isNotNull())
    folded = df.groupBy(*keys, *entry).agg(F.count("*").alias("n"))
    return folded.groupBy(*keys).agg(
        F.sum("n").alias("shifts"), F.sort_array(F.collect_list(F.struct(*entry, "n"))).alias("entries")
    )


def day_marks(df: DataFrame, key: str, day: str = "shift_date") -> DataFrame:
    """Number of shifts and colour per key and day."""
    status = F.col("assignment_status")
    return (
        df.groupBy(key, day)
        .agg(
            F.count("*").alias("shifts"),
            F.bool_or(status == "Completed").alias("done"),
            F.bool_or(status.isin("Canceled", "NoShow")).alias("dropped"),
        )
        .select(key, day, "shifts", day_class(F.col("done"), F.col("dropped")).alias("day_class"))
    )


def with_entries(cells: DataFrame, lists: DataFrame, key: str, day: str = "shift_date") -> DataFrame:
    """Calendar cells with the entries of their day; a day without any, or a blank cell, has none."""
    return cells.join(lists.select(key, day, "entries"), [key, day], "left")


def calendar_grid(marks: DataFrame, key: str, day: str = "shift_date") -> DataFrame:
    """One row per cell of every month from a key's first to its last day.

    Weeks start on Monday. Cells outside the month are blank: day 0, no marks. The marks of a key, one
    per day at most, travel as a map beside the cells, so the cells themselves are never shuffled.
    """
    by_key = (
        marks.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            F.min(day).alias("first"),
            F.max(day).alias("last"),
            F.map_from_entries(F.collect_list(F.struct(day, F.struct("shifts", "day_class")))).alias("marked"),
        )
    )
    month = F.col("month_start")
    step = F.expr("INTERVAL 1 MONTH")
    months = by_key.select(
        key, "marked", F.explode(F.sequence(F.trunc("first", "month"), F.trunc("last", "month"), step)).alias("month_start")
    )
    monday = F.date_sub(month, F.weekday(month))
    sunday = F.date_add(F.last_day(month), 6 - F.weekday(F.last_day(month)))
    cells = months.select(key, "marked", "month_start", F.explode(F.sequence(monday, sunday)).alias("cell"))
    inside = F.trunc("cell", "month") == month
    mark = F.when(inside, F.col("marked")[F.col("cell")])
    return cells.select(
        key,
        "month_start",
        F.floor(F.datediff("cell", monday) / 7).cast("int").alias("week"),
        F.weekday("cell").alias("weekday"),
        F.when(inside, F.dayofmonth("cell")).otherwise(0).alias("day"),
        F.when(inside, F.col("cell")).alias(day),
        F.coalesce(mark["shifts"], F.lit(0)).alias("shifts"),
        mark["day_class"].alias("day_class"),
    )
