"""Latest and best rows per key.

``row_number() <= k`` becomes a group limit that runs before the shuffle as well, so at most k rows
per key leave a map task and a hot key costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

_RANK = "__rank"


def top_k_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], k: int, rank: str | None = None) -> DataFrame:
    """The first k rows per key; ``rank`` names a column for the position."""
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(rank or _RANK, F.row_number().over(window)).where(F.col(rank or _RANK) <= k)
    return ranked if rank else ranked.drop(_RANK)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: str, tie: Sequence[str] = ()) -> DataFrame:
    """The row with the greatest ``order`` per key; among equal ones the greatest ``tie`` columns win."""
    return top_k_per_group(df, keys, [F.col(name).desc() for name in (order, *tie)], 1)


def merge_latest(state: DataFrame, events: DataFrame, keys: Sequence[str], order: str, tie: Sequence[str] = ()) -> DataFrame:
    """Yesterday's latest row per key brought up to date with the day's events.

    Equal to ``latest_per_key`` over all events so far, late events (older ``order`` than the kept row) and
    repeated events included, wherever the ``order`` and ``tie`` columns tell rows apart. Only keys with events
    of the day are decided again: the state meets their keys in a semi and an anti join, so it is scanned
    but not shuffled while the day's keys are small enough to broadcast (AQE decides from their measured
    size), and the new decision groups only the rows of those keys. Null keys are keys like any other.
    ``events`` may have more columns; those of ``state`` are kept.
    """
    fresh = latest_per_key(events.select(*state.columns), keys, order, tie)
    touched = fresh.select(*keys).distinct()
    same = lambda left, right: [left[k].eqNullSafe(right[k]) for k in keys]
    old = state.join(touched, same(state, touched), "left_semi")
    kept = state.join(touched, same(state, touched), "left_anti")
    return kept.unionByName(latest_per_key(old.unionByName(fresh), keys, order, tie))


def dedup_latest(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    """Latest row per key, reduced to ``columns``: one row per key, so no DISTINCT is left to do."""
    return latest_per_key(df, keys, order, tie).select(*keys, *[c for c in columns if c not in keys])


def partition_counts(df: DataFrame, keys: Sequence[str], counts: dict[str, Column | None]) -> DataFrame:
    """Counts over the whole partition on every row; ``None`` counts all rows.

    A window would bring each partition into one task. Here the counts are combined on the map side
    and joined back, so a hot key is split like any other join partition.
    """
    totals = df.groupBy(*keys).agg(
        *[(F.count("*") if p is None else F.count_if(p)).alias(name) for name, p in counts.items()]
    )
    left, right = df.alias("l"), totals.alias("r")
    match = [F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}")) for key in keys]
    return left.join(right, match, "inner").select("l.*", *[f"r.{name}" for name in counts])
