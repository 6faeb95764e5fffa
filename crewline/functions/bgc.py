"""Background-check rules."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, functions as F

from crewline.functions.text import lookup

NO_CHECK = "no_bgc"

# Adjudication events.
ENGAGED = "report.engaged"
PRE_ADVERSE = "report.pre_adverse_action"
POST_ADVERSE = "report.post_adverse_action"

# Legacy status -> result.
LEGACY_RESULT = {
    "report_clear": "clear",
    "report_consider": "consider",
    "report_pending": "pending",
    "report_suspended": "suspended",
    "report_cancelled": "cancelled",
    "invitation_expired": "pending",
    "invitation_pending": "pending",
    "invitation_completed": "pending",
}

# Result -> display text.
RESULT_DISPLAY = {
    "clear": "Clear",
    "consider": "Consider (Pending Review)",
    "pending": "Pending",
    "suspended": "Suspended",
    "cancelled": "Cancelled",
}

# Event -> short label.
EVENT_LABEL = {ENGAGED: "Cleared", PRE_ADVERSE: "Pre-Adverse", POST_ADVERSE: "Post-Adverse"}


def is_adverse(event: Column) -> Column:
    return event.isin(PRE_ADVERSE, POST_ADVERSE)


def adjudication_pred(result: Column, event: Column, updated_at: Column, since: date, legacy: bool = False) -> Column:
    """Rows that carry a decision.

    From ``since`` on, engagement counts only on a ``consider`` result. With ``legacy``, older rows
    count as well, whatever their result.
    """
    recent = F.to_date(updated_at) >= F.lit(since)
    current = recent & (is_adverse(event) | ((event == ENGAGED) & (result == "consider")))
    if not legacy:
        return current
    return current | ((F.to_date(updated_at) < F.lit(since)) & (is_adverse(event) | (event == ENGAGED)))


def bgc_result(result: Column, status: Column) -> Column:
    """The result, else the one that the legacy status implies."""
    return F.coalesce(result, lookup(status, LEGACY_RESULT), F.lit(NO_CHECK))


def bgc_passed(result: Column, event: Column) -> Column:
    """Clear without any decision, or cleared by decision. Never NULL."""
    passed = ((result == "clear") & event.isNull()) | (event == ENGAGED)
    return F.coalesce(passed, F.lit(False))


def bgc_display(result: Column, event: Column) -> Column:
    return (
        F.when(event == ENGAGED, "Cleared (Adjudicated)")
        .when(is_adverse(event), "Failed (Post-Adverse)")
        .otherwise(F.coalesce(lookup(result, RESULT_DISPLAY), F.lit("Not Submitted")))
    )


def bgc_delta(result: Column, event: Column) -> Column:
    """Short trend label under the status; NULL where there is none."""
    return (
        F.when(event == ENGAGED, "Cleared")
        .when(is_adverse(event), "Failed")
        .when(bgc_passed(result, event), "Passed")
        .when(result == "consider", "Review needed")
        .when(result == "pending", "In progress")
    )


def adj_label(event: Column, decided_at: Column) -> Column:
    """``Cleared (2024-01-05)``; unknown events keep their name, a missing date shows ``?``."""
    day = F.coalesce(F.date_format(decided_at, "yyyy-MM-dd"), F.lit("?"))
    return F.concat(F.coalesce(lookup(event, EVENT_LABEL), event), F.lit(" ("), day, F.lit(")"))
