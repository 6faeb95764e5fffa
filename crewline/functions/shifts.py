"""Shift, assignment, bonus and deactivation labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ACCEPTED_STATUSES = ["Assigned", "Accepted", "Completed"]
DROPPED_STATUSES = ["Canceled", "Declined"]
LISTED_STATUSES = ["Sent", "Accepted", "Assigned", "Completed"]


def is_work_shift(title: Column) -> Column:
    """Neither orientation nor shadow shift; NULL for an unknown title."""
    low = F.lower(title)
    return ~low.contains("orientation") & ~low.contains("shadow")


def completion_status(completed: Column, noshow: Column, canceled: Column) -> Column:
    return (
        F.when(completed, "Completed").when(noshow, "No Show").when(canceled, "Canceled").otherwise("Assigned")
    )


def is_accepted(status: Column, assigned_at: Column, include_assigned_at: bool = True) -> Column:
    """By status alone, or also by an assignment time."""
    by_status = F.coalesce(status.isin(ACCEPTED_STATUSES), F.lit(False))
    return by_status | assigned_at.isNotNull() if include_assigned_at else by_status


def row_class(status: Column, assigned_at: Column) -> Column:
    """``accepted`` / ``rejected`` / ``none``; the status is compared without case."""
    low = F.lower(status)
    accepted = low.isin([s.lower() for s in ACCEPTED_STATUSES]) | assigned_at.isNotNull()
    return (
        F.when(accepted, "accepted")
        .when(low.isin([s.lower() for s in DROPPED_STATUSES]), "rejected")
        .otherwise("none")
    )


def opted_in(viewed: Column) -> Column:
    return F.when(viewed, "Yes").otherwise("No")


def bonus_status(completed: Column) -> Column:
    return F.when(completed, "Complete").otherwise("In Progress")


def bonus_class(completed: Column, viewed: Column) -> Column:
    """``in`` when complete or opted in, else ``not_in``."""
    return F.when(F.coalesce(completed, F.lit(False)) | F.coalesce(viewed, F.lit(False)), "in").otherwise("not_in")


def deact_status(banned: Column, deactivated: Column) -> Column:
    return F.when(banned, "BANNED").when(deactivated, "Deactivated").otherwise("Active")


def last_reactivated(day: Column) -> Column:
    return F.coalesce(day.cast("string"), F.lit("Never"))


def is_m1_active(tier: Column) -> Column:
    """Senior tier that is active: both marks, in this order, case-sensitive."""
    return tier.like("%M1%Active%")


def is_m1_any(tier: Column) -> Column:
    return F.when(F.lower(tier).contains("m1"), 1).otherwise(0)


def day_class(completed: Column, dropped: Column) -> Column:
    """Colour of a calendar day: any completed, else any canceled or no-show, else open."""
    return F.when(completed, "green").when(dropped, "red").otherwise("blue")
