"""Zone and store summaries, zone lists."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame, functions as F

from crewline.functions.numbers import mean_money
from crewline.functions.text import zone_label
from crewline.operators.counts import shift_totals

# Texts that stand for no city.
NO_CITY = ("", "None", "nan")


def zone_rows(filtered: DataFrame) -> DataFrame:
    """The columns of filtered assignments that the summaries need."""
    return filtered.select(
        F.col("location.store_cluster").alias("zone_hex"),
        F.col("location.external_id").alias("store_number"),
        F.col("location.saved_location_name").alias("store_name"),
        "assignment_status", "assignment.is_completed", "assignment.is_noshow", "assignment.is_canceled",
        "payment.total_amount", "payment.rate", "partner_id",
    )


def _rate(df: DataFrame) -> DataFrame:
    return df.withColumn("fill_rate", F.bround(F.col("completed") / F.col("total_shifts") * 100, 1))


def zone_summary(rows: DataFrame) -> DataFrame:
    """Per zone: shifts, outcomes, pay, mean rate, partners and stores; rows without a zone are left out.

    The distinct counts spread a large zone over its partners and stores before it is put together.
    """
    summed = (
        rows.where(F.col("zone_hex").isNotNull())
        .groupBy("zone_hex")
        .agg(
            *shift_totals(),
            F.sum("rate").alias("rate_sum"),
            F.count("rate").alias("rate_n"),
            F.countDistinct("partner_id").alias("unique_partners"),
            F.countDistinct("store_number").alias("store_count"),
        )
    )
    return (
        _rate(summed)
        .withColumn("avg_rate", mean_money(F.col("rate_sum"), F.col("rate_n")))
        .drop("rate_sum", "rate_n")
        .orderBy(F.col("total_shifts").desc(), "zone_hex")
    )


def store_summary(rows: DataFrame) -> DataFrame:
    """Per zone and store; rows without a store number or name are left out."""
    known = rows.where(F.col("zone_hex").isNotNull() & F.col("store_number").isNotNull() & F.col("store_name").isNotNull())
    summed = known.groupBy("zone_hex", "store_number", "store_name").agg(
        *shift_totals(), F.countDistinct("partner_id").alias("unique_partners")
    )
    return _rate(summed.drop("canceled")).orderBy(F.col("total_shifts").desc(), "zone_hex", "store_number", "store_name")


def _of(df: DataFrame, companies: Sequence[str] | None) -> DataFrame:
    """Rows of the companies named, or of all that have a name."""
    return df.where(F.col("company_name").isNotNull() if companies is None else F.col("company_name").isin(list(companies)))


def zone_cities(supply: DataFrame, locations: DataFrame, companies: Sequence[str] | None, since: date) -> DataFrame:
    """Set of store cities per company and zone, over the clusters that had shifts since a day; empty names are no city."""
    open_days = _of(supply, companies).where((F.col("position") == "All") & (F.col("shifts") > 0) & (F.col("date") >= F.lit(since)))
    clusters = open_days.select("company_name", "zone_description", "store_cluster").distinct()
    named = F.col("city").isNotNull() & ~F.col("city").isin(*NO_CITY)
    stores = _of(locations, companies).where(F.col("is_active") & named)
    stores = stores.select("company_name", F.col("hex").alias("store_cluster"), "city").distinct()
    pairs = clusters.join(stores, ["company_name", "store_cluster"]).select("company_name", "zone_description", "city").distinct()
    return pairs.groupBy("company_name", "zone_description").agg(F.sort_array(F.collect_list("city")).alias("store_cities"))


def zone_peaks(supply: DataFrame, companies: Sequence[str] | None) -> DataFrame:
    """Zone and city pairs of each company's last snapshot with their largest shift count."""
    listed = _of(supply, companies).where(F.col("position") == "All")
    # One row per company, so it meets the supply as a broadcast; larger, the sizes decide.
    last_day = listed.groupBy("company_name").agg(F.max("date").alias("date"))
    last = listed.where(F.col("shifts") > 0).join(last_day, ["company_name", "date"])
    return last.groupBy("company_name", "zone_description", "hex_city_description").agg(F.max("shifts").alias("max_shifts"))


def zone_list(supply: DataFrame, locations: DataFrame, companies: Sequence[str] | None, as_of_date: date, days: int = 7) -> DataFrame:
    """Labelled zones of the companies named, or of all, ready to be saved; one plan whatever their number."""
    cities = zone_cities(supply, locations, companies, as_of_date - timedelta(days=days))
    none = F.array().cast("array<string>")
    return (
        zone_peaks(supply, companies)
        .join(cities, ["company_name", "zone_description"], "left")
        .select(
            F.col("company_name").alias("company"),
            zone_label(
                F.col("hex_city_description"), F.col("zone_description"), F.coalesce("store_cities", none)
            ).alias("label"),
            F.col("zone_description").alias("value"),
            "max_shifts",
            "hex_city_description",
        )
        .orderBy("company", "hex_city_description", "value")
        .drop("hex_city_description")
    )
