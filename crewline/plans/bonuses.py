"""Bonuses that partners are eligible for."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from crewline.functions.shifts import bonus_class, bonus_status, opted_in
from crewline.functions.text import map_companies, progress as progress_text
from crewline.operators.latest import dedup_latest
from crewline.sources.dimensions import COMPANY_NAMES
from crewline.sources.sinks import materialize

INFO = "title bonus_type amount shifts_required valid_from valid_to companies days_to_complete".split()


def bonus_info(progress: DataFrame, tie: Sequence[str] = ("partner_id", "count_progress")) -> DataFrame:
    """The terms of each bonus as of its last update."""
    return dedup_latest(progress, ["bonus_id"], "updated_at", INFO, tie)


def partner_bonuses(
    eligible: DataFrame,
    progress: DataFrame,
    names: Mapping[str, str] = COMPANY_NAMES,
    tie: Sequence[str] = ("partner_id", "count_progress"),
) -> DataFrame:
    """Eligible bonuses of every partner with progress and labels.

    Eligibility and progress meet on bonus and partner, which spreads a bonus that everybody has. The
    terms, one row per bonus, are written first: by their size Spark decides to broadcast them or to
    shuffle by bonus with skewed partitions split.
    """
    terms = materialize(bonus_info(progress, tie))
    pairs = eligible.select("bonus_id", "partner_id").distinct()
    own = progress.select("bonus_id", "partner_id", "count_progress", "is_complete", "is_viewed")
    joined = pairs.join(own, ["bonus_id", "partner_id"], "left").join(terms, "bonus_id")
    return joined.select(
        "partner_id", "bonus_id", F.col("title").alias("bonus_name"), "bonus_type", "amount", "shifts_required",
        F.coalesce("count_progress", F.lit(0)).alias("shifts_completed"),
        F.coalesce("is_complete", F.lit(False)).alias("is_complete"),
        F.col("is_viewed").alias("viewed_by_partner"),
        progress_text(F.col("count_progress"), F.col("shifts_required")).alias("progress"),
        opted_in(F.col("is_viewed")).alias("opted_in"),
        bonus_status(F.col("is_complete")).alias("status"),
        bonus_class(F.col("is_complete"), F.col("is_viewed")).alias("row_class"),
        "valid_from", "valid_to", "days_to_complete",
        map_companies(F.col("companies"), names).alias("companies"),
    )
