"""Stores near partners and what is coming up there."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame, functions as F

from crewline.functions.text import roster_location
from crewline.operators.filters import between_dates
from crewline.operators.joins import left_one
from crewline.operators.nearest import nearest_k
from crewline.sources.sinks import materialize


def nearest_stores(partners: DataFrame, locations: DataFrame, companies: Sequence[str], k: int = 5, radius: float = 25.0) -> DataFrame:
    """The k nearest active stores of every partner and company; one row with zero stores for a company that has none.

    A partner listed with several places counts as living at the greatest (latitude, longitude) of them.
    """
    placed = F.col("partner_lat").isNotNull() & F.col("partner_lng").isNotNull()
    home = F.max(F.struct(F.col("partner_lat").alias("lat"), F.col("partner_lng").alias("lng")))
    homes = partners.where(placed).groupBy("partner_id").agg(home.alias("home")).select("partner_id", "home.*")
    stores = locations.where(F.col("is_active")).select(
        "company_name", F.col("external_id").alias("store_number"), "city", "state_code", "lat", "lng"
    )
    found = nearest_k(homes, stores, companies, k, radius).select(
        "partner_id", "company_name", "rank", "store_number", "city", "state_code", "distance_miles",
        "total_active_stores", "stores_within_radius",
    )
    known = stores.where(F.col("lat").isNotNull() & F.col("lng").isNotNull()).select("company_name").distinct()
    named = homes.select("partner_id", F.explode(F.array(*[F.lit(c) for c in companies])).alias("company_name"))
    without = named.join(known, "company_name", "left_anti")
    empty = {"total_active_stores": F.lit(0), "stores_within_radius": F.lit(0)}
    return found.unionByName(
        without.select(*[empty.get(f.name, F.col(f.name) if f.name in without.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in found.schema])
    )


def store_outlook(assignments: DataFrame, companies: Sequence[str], as_of_date: date, back: int = 7, ahead: int = 30) -> DataFrame:
    """Shifts of the last days and the next shift day per store and company."""
    today = F.lit(as_of_date)
    day = F.col("shift_date")
    rows = between_dates(
        assignments.where(F.col("company_name").isin(list(companies))),
        "shift_date", as_of_date - timedelta(days=back), as_of_date + timedelta(days=ahead),
    )
    return rows.groupBy("company_name", F.col("location.external_id").alias("store_number")).agg(
        F.count_if(day <= today).alias("l7d_shifts"), F.min(F.when(day >= today, day)).alias("next_shift_date")
    )


def nearby_outlook(nearest: DataFrame, outlook: DataFrame) -> DataFrame:
    """Nearest stores with their outlook; a store without shifts shows 0 and a dash.

    The outlook, one row per store, is written first, so that its size decides about a broadcast and
    the many partner rows of a busy store need not meet in one task.
    """
    joined = left_one(nearest, materialize(outlook), ["company_name", "store_number"], {"l7d_shifts": 0})
    return joined.withColumns(
        {
            "next_shift": F.coalesce(F.col("next_shift_date").cast("string"), F.lit("—")),
            "location": roster_location(F.col("city"), F.col("state_code")),
        }
    )
