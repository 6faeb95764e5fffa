"""Background checks per partner."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, functions as F

from crewline.functions import bgc
from crewline.functions.times import dt_string
from crewline.operators.latest import latest_per_key

TIE = ("created_at", "status", "result", "event")


def _decided(checks: DataFrame, since: date, legacy: bool):
    return bgc.adjudication_pred(F.col("result"), F.col("event"), F.col("updated_at"), since, legacy)


def bgc_latest(checks: DataFrame, tie: Sequence[str] = TIE) -> DataFrame:
    """Last update per partner with the result as stored."""
    return latest_per_key(checks, ["partner_id"], "updated_at", tie).select(
        "partner_id",
        F.col("status").alias("bgc_status_raw"),
        F.coalesce("result", F.lit(bgc.NO_CHECK)).alias("bgc_result"),
        F.col("updated_at").alias("bgc_submitted_at"),
    )


def bgc_adjudication(checks: DataFrame, since: date, legacy: bool = False, tie: Sequence[str] = TIE) -> DataFrame:
    """Last decision per partner."""
    return latest_per_key(checks.where(_decided(checks, since, legacy)), ["partner_id"], "updated_at", tie).select(
        "partner_id",
        F.col("event").alias("bgc_adjudication_event"),
        F.col("updated_at").alias("bgc_adjudication_date"),
    )


def check_facts(checks: DataFrame, since: date, legacy: bool, tie: Sequence[str] = TIE) -> DataFrame:
    """Both of the above from one scan and one shuffle, with map-side combination."""
    order = ["updated_at", *tie]
    rest = [c for c in ("status", "result", "created_at", "event") if c not in order]
    row = F.struct(*order, *rest)
    both = checks.groupBy("partner_id").agg(
        F.max(row).alias("last"), F.max(F.when(_decided(checks, since, legacy), row)).alias("decided")
    )
    return both.select(
        "partner_id",
        F.col("last.status").alias("bgc_status_raw"),
        F.col("last.result").alias("bgc_result_raw"),
        F.col("last.created_at").alias("bgc_started_at"),
        F.col("last.updated_at").alias("bgc_submitted_at"),
        F.col("decided.event").alias("bgc_adjudication_event"),
        F.col("decided.updated_at").alias("bgc_adjudication_date"),
    )


def bgc_status(checks: DataFrame, since: date, tie: Sequence[str] = TIE) -> DataFrame:
    """Status per partner for display, older records included."""
    facts = check_facts(checks, since, True, tie).withColumn(
        "bgc_result", bgc.bgc_result(F.col("bgc_result_raw"), F.col("bgc_status_raw"))
    )
    result, event = F.col("bgc_result"), F.col("bgc_adjudication_event")
    return facts.select(
        "partner_id",
        "bgc_status_raw",
        "bgc_result",
        dt_string(F.col("bgc_started_at")).alias("bgc_started_at"),
        dt_string(F.col("bgc_submitted_at")).alias("bgc_updated_at"),
        "bgc_adjudication_event",
        dt_string(F.col("bgc_adjudication_date")).alias("bgc_adjudication_date"),
        bgc.bgc_display(result, event).alias("bgc_display_status"),
        bgc.bgc_passed(result, event).alias("bgc_passed"),
        bgc.bgc_delta(result, event).alias("bgc_delta"),
        bgc.adj_label(event, F.col("bgc_adjudication_date")).alias("adjudication_label"),
    )
