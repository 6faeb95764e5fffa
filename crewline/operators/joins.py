"""Join shapes.

No side is forced to broadcast here: Spark broadcasts what it measures to be under
``autoBroadcastJoinThreshold`` and otherwise shuffles on the key, with skewed partitions split.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def enrich(base: DataFrame, key: str, dims: Sequence[DataFrame]) -> DataFrame:
    """Chain of left joins on one key; the base is shuffled at most once for all of them."""
    for dim in dims:
        base = base.join(dim, key, "left")
    return base


def scope(df: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Only rows whose key is in ``keys``; duplicates there do no harm."""
    return df.join(keys, on, "left_semi")


def semi_in(df: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """``column IN (SELECT key FROM keys)``."""
    return df.join(keys.select(F.col(key).alias("__key")), F.col(column) == F.col("__key"), "left_semi")


def flag_exists(df: DataFrame, keys: DataFrame, on: str | Sequence[str], name: str) -> DataFrame:
    """TRUE where the key is in ``keys``, else FALSE; no row is multiplied."""
    on = [on] if isinstance(on, str) else list(on)
    marked = keys.select(*on).distinct().withColumn("__hit", F.lit(True))
    return df.join(marked, on, "left").withColumn(name, F.col("__hit").isNotNull()).drop("__hit")


def zero_fill(skeleton: DataFrame, counted: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """Every skeleton row, with 0 where nothing was counted."""
    joined = skeleton.join(counted.select(key, *names), key, "left")
    return joined.withColumns({name: F.coalesce(F.col(name), F.lit(0)) for name in names})


def left_one(left: DataFrame, right: DataFrame, on: str | Sequence[str], defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Left join to a side with at most one row per key, with defaults for what is missing."""
    joined = left.join(right, on, "left")
    filled: dict[str, Column] = {name: F.coalesce(F.col(name), F.lit(v)) for name, v in (defaults or {}).items()}
    return joined.withColumns(filled) if filled else joined
