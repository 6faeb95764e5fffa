"""Markets worth working on, by the priority class of their stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from crewline.functions.funnel import l2_priority
from crewline.operators.counts import pick_by_priority
from crewline.operators.filters import at_snapshot, latest_snapshot
from crewline.operators.joins import scope
from crewline.params import FunnelParams
from crewline.sources.dimensions import TARGET_L1


def zone_cohorts(store_crm: DataFrame) -> DataFrame:
    """Per zone the classes of its most urgent store."""
    stores = store_crm.where(F.col("priority_cohort_l1").isin(TARGET_L1)).withColumn(
        "l2_priority", l2_priority(F.col("priority_cohort_l2"))
    )
    return pick_by_priority(
        stores.withColumnRenamed("zone_desc", "zone_description"),
        ["zone_description"],
        ["priority_cohort_l2", "priority_cohort_l1"],
        "l2_priority",
    )


def open_supply(supply: DataFrame, company: str) -> DataFrame:
    """Position totals of a company with at least one shift."""
    return supply.where((F.col("company_name") == company) & (F.col("position") == "All") & (F.col("shifts") > 0))


def market_fill_rate(supply: DataFrame) -> DataFrame:
    """Fill rate and shift counts per zone.

    The rate covers the snapshot days that the frame holds, by default a single one, in spite of its name.
    """
    return supply.groupBy("zone_description").agg(
        F.max("hex_city_description").alias("city"),
        F.try_divide(F.sum("filled"), F.sum("shifts")).alias("fill_rate_l7d"),
        F.sum("shifts").alias("total_shifts_l7d"),
        F.sum("filled").alias("filled_shifts_l7d"),
    )


def target_markets(supply: DataFrame, store_crm: DataFrame, p: FunnelParams) -> DataFrame:
    """Zones with target stores and shifts in the snapshot; supply is summed per zone before the join."""
    days = at_snapshot(open_supply(supply, p.company), "date", p.day(-p.supply_days), p.day(-1))
    return market_fill_rate(days).join(zone_cohorts(store_crm), "zone_description")


def priority_markets(supply: DataFrame, store_crm: DataFrame, company: str) -> DataFrame:
    """Cities of target zones in the company's last snapshot."""
    wanted = store_crm.where(F.col("priority_cohort_l1").isin(TARGET_L1)).select(
        F.col("zone_desc").alias("zone_description")
    )
    listed = supply.where((F.col("company_name") == company) & (F.col("position") == "All"))
    last = latest_snapshot(listed, "date").where(F.col("shifts") > 0)
    # Distinct first: a large zone then meets the store list as a handful of rows.
    cities = last.select("zone_description", F.col("hex_city_description").alias("city_name")).distinct()
    return scope(cities, wanted, "zone_description").select("city_name").distinct().orderBy("city_name")
