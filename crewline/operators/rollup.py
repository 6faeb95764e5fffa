"""Cohort, group and grand totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from crewline.functions.funnel import cohort_l1
from crewline.functions.numbers import share


def funnel_rollup(df: DataFrame, code: str = "cohort") -> DataFrame:
    """Counts per code, per group and in total.

    Rows are first counted per code, so the roll-up itself sees one row per code. ``level`` is
    0 for a code, 1 for a group and 3 for the total.
    """
    per_code = df.groupBy(F.col(code).alias("cohort")).agg(F.count("*").alias("n"))
    return (
        per_code.withColumn("l1_group", cohort_l1(F.col("cohort")))
        .rollup("l1_group", "cohort")
        .agg(F.sum("n").alias("partners"), F.grouping_id().cast("int").alias("level"))
    )


def pct_of_total(df: DataFrame, count: str, total: DataFrame | None = None, name: str = "pct") -> DataFrame:
    """Share of the grand total in percent, to one decimal; the total is a scalar subquery."""
    grand = (df if total is None else total).agg(F.sum(count)).scalar()
    return df.withColumn(name, share(F.col(count), grand))
