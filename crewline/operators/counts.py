"""Conditional aggregates. All of them combine on the map side."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from crewline.functions.numbers import fill_rate, mean_money
from crewline.functions.shifts import DROPPED_STATUSES, is_accepted


def cond_counts(df: DataFrame, keys: Sequence[str], preds: Mapping[str, Column]) -> DataFrame:
    """One count per predicate and key in a single pass."""
    return df.groupBy(*keys).agg(*[F.count_if(pred).alias(name) for name, pred in preds.items()])


def pick_by_priority(df: DataFrame, keys: Sequence[str], values: Sequence[str], priority: str) -> DataFrame:
    """The values of the row with the lowest priority number, ties by the values themselves."""
    best = F.min(F.struct(priority, *values)).alias("best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"best.{v}").alias(v) for v in values])


def options(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values without NULL."""
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def sum_or_zero(column: Column) -> Column:
    return F.coalesce(F.sum(column), F.lit(0))


def shift_totals() -> list[Column]:
    """Size, outcome counts and pay of a set of assignments."""
    return [
        F.count("*").alias("total_shifts"),
        F.count_if(F.col("is_completed")).alias("completed"),
        F.count_if(F.col("is_noshow")).alias("noshows"),
        F.count_if(F.col("is_canceled")).alias("canceled"),
        sum_or_zero(F.col("total_amount")).alias("total_pay"),
    ]


def shift_kpis(df: DataFrame) -> DataFrame:
    """One row over all given assignments; rows without a zone count too."""
    return df.agg(
        *shift_totals(),
        F.countDistinct("partner_id").alias("unique_partners"),
        F.countDistinct("store_number").alias("store_count"),
    ).withColumn("fill_rate", fill_rate(F.col("completed"), F.col("total_shifts")))


def assignment_kpis(df: DataFrame, keys: Sequence[str] = ("partner_id",)) -> DataFrame:
    return (
        df.groupBy(*keys)
        .agg(
            F.count("*").alias("assignments"),
            sum_or_zero(F.col("total_amount")).alias("total_pay"),
            F.sum("payment_rate").alias("rate_sum"),
            F.count("payment_rate").alias("rate_n"),
        )
        .withColumn("avg_rate", mean_money(F.col("rate_sum"), F.col("rate_n")))
        .drop("rate_sum", "rate_n")
    )


def sent_kpis(df: DataFrame, keys: Sequence[str] = ("partner_id",), include_assigned_at: bool = True) -> DataFrame:
    """Offers by outcome."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("total"),
        F.count_if(is_accepted(F.col("status"), F.col("assigned_at"), include_assigned_at)).alias("accepted"),
        F.count("seen_at").alias("seen"),
        F.count("completed_at").alias("completed"),
        F.count_if(F.col("status").isin(DROPPED_STATUSES)).alias("dropped"),
    )


def bonus_kpis(df: DataFrame, keys: Sequence[str] = ("partner_id",)) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count("*").alias("total_bonuses"),
        F.count_if(F.col("opted_in") == "Yes").alias("opted_in"),
        F.count_if(F.col("opted_in") == "No").alias("not_opted_in"),
        F.count_if(F.col("status") == "Complete").alias("completed"),
    )
