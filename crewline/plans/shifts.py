"""Shifts of a market."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from crewline.functions.shifts import completion_status
from crewline.functions.text import full_name
from crewline.functions.times import dt_string
from crewline.operators.counts import shift_kpis
from crewline.operators.filters import both, filter_in
from crewline.operators.joins import semi_in
from crewline.sources.sinks import materialize

ORDER = ("shift_date", "shift.start", "shift_id", "location.external_id", "partner_id")


def shift_filter(
    assignments: DataFrame,
    company: str | None = None,
    first: date | None = None,
    last: date | None = None,
    zone: str | None = None,
    store: str | None = None,
    supply: DataFrame | None = None,
) -> DataFrame:
    """Only the predicates whose value is given; a zone means the store clusters that supply lists for it.

    The clusters are written first, so that Spark knows how few they are and leaves the shifts where they are.
    """
    preds: list[Column] = []
    if company:
        preds.append(F.col("company_name") == company)
    if first:
        preds.append(F.col("shift_date") >= F.lit(first))
    if last:
        preds.append(F.col("shift_date") <= F.lit(last))
    if store and store.strip():
        preds.append(F.col("location.external_id") == store.strip())
    rows = assignments.where(both(preds)) if preds else assignments
    if zone is None:
        return rows
    clusters = supply.where(F.col("zone_description") == zone)
    if company:
        clusters = clusters.where(F.col("company_name") == company)
    known = materialize(clusters.select("store_cluster").distinct())
    return semi_in(rows, "location.store_cluster", known, "store_cluster")


def zone_bridge(supply: DataFrame) -> DataFrame:
    """``company_name, zone_description, store_cluster``: every cluster under each zone that supply lists it for.

    Written once; a cluster may be under several zones, and a zone has several clusters.
    """
    keys = ("company_name", "zone_description", "store_cluster")
    return materialize(supply.select(*keys).where(both(F.col(k).isNotNull() for k in keys)).distinct())


def zoned_shifts(assignments: DataFrame, bridge: DataFrame, salt: int = 16) -> DataFrame:
    """Each shift once under every zone whose clusters hold its store, with ``zone_description``.

    The shifts of all zones in one plan, to be written ranged by zone, so a zone look-up is a filtered read.
    The bridge is copied ``salt`` times and each shift takes one copy by a hash, so a cluster with a third
    of all shifts is spread over ``salt`` tasks when the bridge is too large to broadcast.
    """
    rows = assignments.withColumns({"__salt": F.pmod(F.xxhash64("shift_id", "partner_id", "shift_date"), F.lit(salt)), "__cluster": F.col("location.store_cluster")})
    spread = bridge.select("company_name", "zone_description", F.col("store_cluster").alias("__cluster"), F.explode(F.sequence(F.lit(0), F.lit(salt - 1))).alias("__salt"))
    return rows.join(spread, ["company_name", "__cluster", "__salt"]).drop("__salt", "__cluster")


def _status() -> Column:
    return completion_status(
        F.col("assignment.is_completed"), F.col("assignment.is_noshow"), F.col("assignment.is_canceled")
    )


def market_shifts(filtered: DataFrame, *extra: str) -> DataFrame:
    """Flat shift rows with completion status and pay; ``extra`` columns of ``filtered`` follow."""
    return filtered.select(
        "company_name", "shift_date", "shift_id", "shift_title",
        F.col("shift.type").alias("shift_type"),
        dt_string(F.col("shift.start")).alias("shift_time"), dt_string(F.col("shift.end")).alias("shift_end"),
        F.col("location.external_id").alias("store_number"),
        F.col("location.store_cluster").alias("zone"),
        F.col("location.saved_location_name").alias("store_name"),
        "partner_id", full_name(F.col("partner.first_name"), F.col("partner.last_name")).alias("partner_name"),
        "assignment_status", _status().alias("completion_status"),
        "payment.rate", F.col("payment.base_amount").alias("base_pay"),
        F.coalesce("payment.shift_bonus_amount", F.lit(0)).alias("bonus"),
        F.col("payment.total_amount").alias("total_pay"),
        F.col("payment.approval_status").alias("payment_approval"),
        F.col("payment.status").alias("payment_status"),
        *extra,
    )


def market_kpis(shifts: DataFrame, statuses=()) -> DataFrame:
    """Counts and pay of the shift rows with the given statuses."""
    status = F.col("completion_status")
    flagged = filter_in(shifts, {"completion_status": statuses}).select(
        (status == "Completed").alias("is_completed"), (status == "No Show").alias("is_noshow"),
        (status == "Canceled").alias("is_canceled"), F.col("total_pay").alias("total_amount"),
        "partner_id", "store_number",
    )
    return shift_kpis(flagged)


def shift_detail(assignments: DataFrame) -> DataFrame:
    """Everything about a shift; filter on ``shift_id`` for one."""
    return assignments.select(
        "company_name", "shift_date", "shift_id", "shift_title",
        F.col("shift.type").alias("shift_type"),
        dt_string(F.col("shift.start")).alias("shift_start"), dt_string(F.col("shift.end")).alias("shift_end"),
        "shift.duration",
        F.col("location.external_id").alias("store_number"),
        F.col("location.saved_location_name").alias("store_name"),
        F.col("location.store_cluster").alias("zone"),
        "partner_id", full_name(F.col("partner.first_name"), F.col("partner.last_name")).alias("partner_name"),
        "assignment_status", "assignment.is_completed", "assignment.is_noshow", "assignment.is_canceled",
        "payment.rate", "payment.base_amount", "payment.shift_bonus_amount", "payment.total_amount",
        "payment.approval_status", F.col("payment.status").alias("payment_status"),
        dt_string(F.col("attendance.check_in_at")).alias("check_in"),
        dt_string(F.col("attendance.check_out_at")).alias("check_out"),
    )
