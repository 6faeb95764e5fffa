"""Exact distinct counts under any filter, from mergeable bitmaps.

Values are numbered once (``numbers``); rows become one bitmap of numbers per combination of the
filter columns and per bucket of 32,768 numbers (``bitmaps``). A distinct count under a filter is then
an OR of the bitmaps of the matching rows per bucket and a count of bits (``distinct_count``): small rows
instead of a scan of the facts, and exact, unlike a sketch. Bitmaps of days, zones or stores merge by OR,
so a rollup over any choice of them needs no second pass over the rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from crewline.sources.sinks import materialize


def numbers(values: DataFrame, column: str) -> DataFrame:
    """``column, number``: each distinct value that is not null gets a number from 1, written once.

    Numbers run densely within each partition of the distinct values, so the buckets are about the
    values' count / 32,768 plus the number of partitions.
    """
    distinct = values.select(column).where(F.col(column).isNotNull()).distinct()
    return materialize(distinct.withColumn("number", F.monotonically_increasing_id() + 1))


def bitmaps(rows: DataFrame, dims: Sequence[str], column: str, numbered: DataFrame) -> DataFrame:
    """``dims..., bucket, bits``: the numbers of ``column`` per combination of ``dims``; nulls are not counted."""
    joined = rows.select(*dims, column).join(numbered, column)
    bucket = F.bitmap_bucket_number("number").alias("bucket")
    return joined.groupBy(*dims, bucket).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))


def distinct_count(bits: DataFrame, by: Sequence[str] = (), name: str = "n") -> DataFrame:
    """Exact distinct count per ``by`` over all given bitmap rows."""
    per = bits.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return per.groupBy(*by).agg(F.sum(F.bitmap_count("bits")).alias(name))


def choices(values: Sequence[str], label: str = "filter", column: str = "value") -> Iterable[tuple[str, str]]:
    """(filter, value) for every non-empty subset of ``values``; a filter is its values joined by '+'."""
    for size in range(1, len(values) + 1):
        for chosen in combinations(values, size):
            for value in chosen:
                yield "+".join(chosen), value


def under_filters(rows: DataFrame, column: str, values: Sequence[str], counted: Mapping[str, str]) -> DataFrame:
    """``filter`` and one exact distinct count per entry of ``counted`` (name -> column) for every subset of
    ``values`` of ``column``: the bitmaps are built once per value and OR'ed per filter."""
    spark = rows.sparkSession
    table = spark.createDataFrame(list(choices(values)), f"filter string, {column} string")
    out = None
    for name, counted_column in counted.items():
        bits = bitmaps(rows, [column], counted_column, numbers(rows, counted_column)).join(table, column)
        counts = distinct_count(bits, ["filter"], name)
        out = counts if out is None else out.join(counts, "filter", "full")
    present = rows.select(column).distinct().join(table, column).select("filter").distinct()
    out = present.join(out, "filter", "left")
    return out.fillna(0, list(counted))
