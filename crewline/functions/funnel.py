"""Partner cohorts.

The classifier is a list of stages. A stage opens on its gate; inside it the first branch that
holds gives the code. Label, group and next action follow from the code by the cohort dimension,
so a row is classified once.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from datetime import datetime, timedelta

from pyspark.sql import Column, functions as F

from crewline.functions import bgc
from crewline.functions.shifts import is_m1_active
from crewline.functions.text import lookup
from crewline.functions.times import ntz
from crewline.sources import dimensions as dims

CHAMPION_SHIFTS = 5
SEASONED_SHIFTS = 3

# Columns that the rules read. Missing facts of a joined source are NULL and count as 0 or "no".
FACTS = (
    "currently_suspended currently_deactivated is_fraud_partner oa_date op_date s1c_date last_active_at "
    "shifts_assigned_next_7d shifts_worked_last_7d partner_role_tier bgc_result bgc_submitted_at "
    "bgc_adjudication_event work_shifts_sent_next_7d work_shifts_seen_next_7d completed_shifts s1c_elsewhere"
).split()


def l2_priority(l2: Column) -> Column:
    return F.coalesce(lookup(l2, dims.L2_PRIORITY), F.lit(99))


def _stages(as_of_ts: datetime) -> list[tuple[Column, list[tuple[str, Column]]]]:
    col, always = F.col, F.lit(True)
    result, event = F.coalesce(col("bgc_result"), F.lit(bgc.NO_CHECK)), col("bgc_adjudication_event")

    def count(name: str) -> Column:
        return F.coalesce(col(name), F.lit(0))

    def active_within(**span: int) -> Column:
        return col("last_active_at") >= ntz(as_of_ts - timedelta(**span))

    sent, seen = count("work_shifts_sent_next_7d") > 0, count("work_shifts_seen_next_7d")
    booked, unbooked = col("shifts_assigned_next_7d") > 0, col("shifts_assigned_next_7d") == 0
    seasoned, senior = count("completed_shifts") >= SEASONED_SHIFTS, is_m1_active(col("partner_role_tier"))
    worked_first = col("s1c_date").isNotNull()
    oriented = col("op_date").isNotNull() & col("s1c_date").isNull()
    invited = col("oa_date").isNotNull() & col("op_date").isNull()
    pending = result == "pending"

    return [
        (col("currently_suspended"), [("24_former_suspended", always)]),
        (col("currently_deactivated") | col("is_fraud_partner"), [("23_former_deactivated", always)]),
        (bgc.is_adverse(event), [("22_former_failed_bgc", always)]),
        (
            worked_first & booked,
            [
                ("01_s1c_assigned_champion", col("shifts_worked_last_7d") >= CHAMPION_SHIFTS),
                ("02_s1c_assigned_non_m1_s3c", seasoned & ~F.coalesce(senior, F.lit(False))),
                ("03_s1c_assigned_m1_s3c", seasoned & senior),
                ("04_s1c_assigned_not_s3c", always),
            ],
        ),
        (
            worked_first & unbooked,
            [
                ("05_s1c_not_assigned_sent_seen", sent & (seen > 0)),
                ("06_s1c_not_assigned_sent_not_seen", sent & (seen == 0)),
                ("07_s1c_not_assigned_not_sent", always),
            ],
        ),
        (
            oriented & bgc.bgc_passed(result, event),
            [
                ("08_bgc_passed_s1a_assigned", booked),
                ("09_bgc_passed_sent_seen", sent & (seen > 0)),
                ("10_bgc_passed_sent_not_seen", sent & (seen == 0)),
                ("11_bgc_passed_not_sent", always),
            ],
        ),
        (
            oriented,
            [
                ("12_op_bgc_consider", (result == "consider") & event.isNull()),
                ("13_op_bgc_pending_gt24h", pending & (col("bgc_submitted_at") < ntz(as_of_ts - timedelta(hours=24)))),
                ("14_op_bgc_pending_lt24h", pending),
                ("15_op_bgc_not_submitted", always),
            ],
        ),
        (invited, [("16_oa_not_op", always)]),
        (col("oa_date").isNull(), _not_invited(active_within)),
    ]


def _not_invited(active_within) -> list[tuple[str, Column]]:
    return [
        ("17_not_oa_non_ckp_s1c", F.coalesce(F.col("s1c_elsewhere"), F.lit(False))),
        ("18_not_oa_active_24h", active_within(hours=24)),
        ("19_not_oa_active_72h", active_within(days=3)),
        ("20_not_oa_active_7d", active_within(days=7)),
        ("21_not_oa_active_7d_plus", F.lit(True)),
    ]


def cohort_rules(as_of_ts: datetime) -> Iterator[tuple[str, Column]]:
    """The stages as one ordered list of (code, condition)."""
    for gate, branches in _stages(as_of_ts):
        for code, branch in branches:
            yield code, gate & branch


def cohort_code(as_of_ts: datetime) -> Column:
    """Code of a row that carries the FACTS columns."""
    chain = F
    for code, condition in cohort_rules(as_of_ts):
        chain = chain.when(condition, code)
    return chain.otherwise(dims.UNCLASSIFIED)


def cohort_l1(code: Column) -> Column:
    return F.coalesce(lookup(code, dims.GROUP_OF), F.lit("Unclassified"))


def cohort_l2(code: Column, as_of_ts: datetime) -> Column:
    """Label of a coded row.

    ``Not Submitted`` is kept for rows without a check or with a cancelled one. Any other result
    under that code is labelled by the not-invited branches, or not at all.
    """
    code_15 = (code == "15_op_bgc_not_submitted") & ~F.coalesce(F.col("bgc_result"), F.lit(bgc.NO_CHECK)).isin(
        bgc.NO_CHECK, "cancelled"
    )
    spare = F
    for other, branch in _stages(as_of_ts)[-1][1]:
        spare = spare.when(F.col("oa_date").isNull() & branch, dims.LABEL_OF[other])
    return F.when(code_15, spare.otherwise("Unclassified")).otherwise(
        F.coalesce(lookup(code, dims.LABEL_OF), F.lit("Unclassified"))
    )


def triage_action(code: Column, actions: Mapping[str, str] = dims.ACTION_OF) -> Column:
    """Next action; unclassified partners are treated as inactive."""
    return F.coalesce(lookup(code, actions), F.lit("OA (inactive)"))


def override_cohort(code: Column, overridden: Column, cleared: Column, sent_next: Column) -> Column:
    """Hand-made corrections on top of a stored code."""
    offered = F.when(F.coalesce(sent_next, F.lit(0)) > 0, "10_bgc_passed_sent_not_seen")
    return (
        F.when(overridden, "25_former_failed_bgc")
        .when(cleared & (code == "12_op_bgc_consider"), offered.otherwise("11_bgc_passed_not_sent"))
        .otherwise(code)
    )


def override_event(event: Column, overridden: Column) -> Column:
    return F.when(overridden, bgc.PRE_ADVERSE).otherwise(event)
