"""What a partner look-up shows, for every partner at once; a look-up is a filter on ``partner_id``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, datetime

from pyspark.sql import DataFrame, functions as F

from crewline.functions import shifts as label
from crewline.functions.text import map_company, map_company_long
from crewline.functions.times import days_ago, dt_string, recently_active
from crewline.operators.filters import between_dates, filter_in, in_window
from crewline.operators.latest import latest_per_key, partition_counts
from crewline.operators.ordering import with_bucket
from crewline.sources.dimensions import COMPANY_NAMES


def partner_profile(partners: DataFrame, as_of_ts: datetime) -> DataFrame:
    """One row per partner and company with recency and the number of companies."""
    seen = F.col("last_active_at")
    rows = partition_counts(partners, ["partner_id"], {"companies": None})
    return rows.select(
        "partner_id", "first_name", "last_name", "email", "phone_number", "company_name", "msa", "op_date",
        "last_active_at", "total_shifts_last_4w", "weeks_worked_last_4w", "partner_lat", "partner_lng",
        "user_company_status", "companies",
        days_ago(seen, as_of_ts).alias("last_active_text"),
        recently_active(seen, as_of_ts).alias("recently_active"),
    )


def deactivation_history(deactivations: DataFrame, names: Mapping[str, str] = COMPANY_NAMES) -> DataFrame:
    """All records; a look-up shows a partner's newest first, and the written mart keeps that order."""
    return deactivations.withColumns(
        {
            "status": label.deact_status(F.col("is_banned"), F.col("is_deactivated")),
            "company": map_company_long(F.col("deactivation_company"), names),
            "last_reactivated": label.last_reactivated(F.col("reactivation_date")),
        }
    )


def deactivation_status(
    deactivations: DataFrame,
    names: Mapping[str, str] = COMPANY_NAMES,
    tie: Sequence[str] = ("is_banned", "is_deactivated", "deactivation_level", "deactivation_company"),
) -> DataFrame:
    """The record that counts: the newest one of each partner."""
    newest = latest_per_key(deactivations, ["partner_id"], "ds", tie)
    return deactivation_history(newest, names).withColumn(
        "deactivation_level", F.when(~F.coalesce("deactivation_level", F.lit("")).isin("", "None"), F.col("deactivation_level")).otherwise("N/A")
    )


def shifts_sent(user_shifts: DataFrame, start: datetime, end: datetime, as_of_ts: datetime, names: Mapping[str, str] = COMPANY_NAMES) -> DataFrame:
    """Offers in the window with company name, row class and past / future bucket."""
    rows = with_bucket(in_window(user_shifts, "start", start, end), "start", as_of_ts)
    return rows.withColumns(
        {
            "company_name": map_company(F.col("company"), names),
            "row_class": label.row_class(F.col("status"), F.col("assigned_at")),
        }
    ).withColumnsRenamed({"start": "shift_start", "end": "shift_end"})


def offer_kpis(sent: DataFrame, statuses: Sequence[str] = ()) -> DataFrame:
    """Offers by outcome per partner and ``rule``: accepted by status or an assignment (``both``), or by status alone.

    Counts all statuses unless some are chosen. Both rules come from one aggregate.
    """
    rows = filter_in(sent, {"status": statuses})
    accepted = {
        "both": label.is_accepted(F.col("status"), F.col("assigned_at"), True), "status": label.is_accepted(F.col("status"), F.col("assigned_at"), False),
    }
    counted = rows.groupBy("partner_id").agg(
        F.count("*").alias("total"),
        F.array(*[F.struct(F.lit(rule).alias("rule"), F.count_if(test).alias("accepted")) for rule, test in accepted.items()]).alias("rules"),
        F.count("seen_at").alias("seen"),
        F.count("completed_at").alias("completed"),
        F.count_if(F.col("status").isin(label.DROPPED_STATUSES)).alias("dropped"),
    )
    return counted.select("partner_id", F.inline("rules"), "total", "seen", "completed", "dropped")


def listed_shifts(sent: DataFrame, statuses: Sequence[str] = label.LISTED_STATUSES) -> DataFrame:
    """The statuses that are shown unless others are chosen."""
    return filter_in(sent, {"status": statuses})


def assignments(shift_assignments: DataFrame, first: date, last: date) -> DataFrame:
    """Assignments of the days given, flat."""
    return between_dates(shift_assignments, "shift_date", first, last).select(
        "partner_id", "company_name", "shift_date", "shift_id", "assignment_status",
        F.col("shift.type").alias("shift_type"), "shift.is_remote",
        dt_string(F.col("shift.start")).alias("shift_start"), dt_string(F.col("shift.end")).alias("shift_end"),
        "shift.duration", F.col("location.external_id").alias("store_number"),
        F.col("payment.status").alias("payment_status"),
        F.col("payment.approval_status").alias("payment_approval"),
        F.col("payment.rate").alias("payment_rate"),
        "payment.base_amount", "payment.shift_bonus_amount", "payment.total_amount",
    )


def partner_tags(certs: DataFrame) -> DataFrame:
    return certs.select("partner_id", "tag", "title", dt_string(F.col("updated_at")).alias("updated_at"))


def partner_assessments(assessments: DataFrame) -> DataFrame:
    return assessments.select(
        "partner_id", "reporting_company", "assessment_status",
        dt_string(F.col("ts_account_created")).alias("account_created"),
    )
