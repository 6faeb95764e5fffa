"""Small dimensions held as data. All sizes are fixed by the code below."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Code, label, group, next action.
COHORTS = [
    ("01_s1c_assigned_champion", "Champion (5+ weekly shifts)", "S1C, Assigned", "Maximize output"),
    ("02_s1c_assigned_non_m1_s3c", "Non-M1, S3C", "S1C, Assigned", "Work more"),
    ("03_s1c_assigned_m1_s3c", "M1, S3C", "S1C, Assigned", "Work more"),
    ("04_s1c_assigned_not_s3c", "Not S3C", "S1C, Assigned", "Work more"),
    ("05_s1c_not_assigned_sent_seen", "Sent, Seen", "S1C, Not Assigned", "Pick up shifts (seen)"),
    ("06_s1c_not_assigned_sent_not_seen", "Sent, Not Seen", "S1C, Not Assigned", "Pick up shifts (not seen)"),
    ("07_s1c_not_assigned_not_sent", "Not Sent", "S1C, Not Assigned", "Show shifts"),
    ("08_bgc_passed_s1a_assigned", "S1A, Currently Assigned", "BGC Passed, Not S1C", "S1A (shift coming)"),
    ("09_bgc_passed_sent_seen", "Sent, Seen", "BGC Passed, Not S1C", "Pick up shifts (BGC clear)"),
    ("10_bgc_passed_sent_not_seen", "Sent, Not Seen", "BGC Passed, Not S1C", "Pick up shifts (BGC clear)"),
    ("11_bgc_passed_not_sent", "Not Sent", "BGC Passed, Not S1C", "Show shifts (BGC clear)"),
    ("12_op_bgc_consider", "Consider", "OP, Not BGC Finalized", "Escalate for review"),
    ("13_op_bgc_pending_gt24h", "Pending > 24H", "OP, Not BGC Finalized", "BGC stuck (>24h)"),
    ("14_op_bgc_pending_lt24h", "Pending < 24H", "OP, Not BGC Finalized", "BGC processing (<24h)"),
    ("15_op_bgc_not_submitted", "Not Submitted", "OP, Not BGC Finalized", "Submit BGC"),
    ("16_oa_not_op", "All", "OA, Not OP", "Complete orientation"),
    ("17_not_oa_non_ckp_s1c", "Non CKP S1C", "Not OA", "Cross-sell to CKP"),
    ("18_not_oa_active_24h", "Active 24hrs No OA", "Not OA", "OA (active)"),
    ("19_not_oa_active_72h", "Active 72hrs No OA", "Not OA", "OA (active)"),
    ("20_not_oa_active_7d", "Active 7 Days No OA", "Not OA", "OA (active)"),
    ("21_not_oa_active_7d_plus", "Active +7 Days No OA", "Not OA", "OA (inactive)"),
    ("22_former_failed_bgc", "Failed BGC", "Former", "No action (failed BGC)"),
    ("23_former_deactivated", "Deactivated", "Former", "No action"),
    ("24_former_suspended", "Suspended", "Former", "No action"),
    ("25_former_failed_bgc", "Failed BGC (Override)", "Former", "No action (failed BGC)"),
]
UNCLASSIFIED = "99_unclassified"
# Codes that only an override list can give; the classifier itself never returns them.
OVERRIDE_ONLY = ("25_former_failed_bgc",)

# Store priority classes, most urgent first.
TARGET_L1 = ["C1: Root Cause Diagnosis", "C2: Unblock Partner Funnel"]
L2_PRIORITY = {
    "C1: Subscale Deep Dives": 1,
    "C2a: FR<80 (Any)": 2,
    "C2b: StoreSmart Alpha": 3,
    "C2c: T25, FR 80-90%": 4,
}
ROSTER_L2 = list(L2_PRIORITY) + [
    "C2d: CL Launch N3W",
    "C3a: Scale, Health Low/Med",
    "C3b: Subscale, Health Low/Med",
    "C3c: Scale, No Health, Zone FR 80-95%",
    "C3d: Subscale, No Health, Zone FR 80-90%",
]

# Result columns of the cohort counts, one per priority class.
L2_COUNT_COLUMNS = {
    "c1_subscale": "C1: Subscale Deep Dives",
    "c2a_fr_below_80": "C2a: FR<80 (Any)",
    "c2b_storesmart": "C2b: StoreSmart Alpha",
    "c2c_t25_fr_80_90": "C2c: T25, FR 80-90%",
}

# Company id -> display name.
COMPANY_NAMES = {
    "da532ea5-9fed-46cf-a5cc-6dd7721411b6": "Circle K - Premium",
    "26983819-c423-4f57-90dc-f62c018d1eb6": "PepsiCo Beverages",
    "a9eb903d-3493-43f7-a180-be8eda4a9668": "PepsiCo Foods",
    "14824b29-7224-48a1-9d30-a62d1b8ed614": "Dollar General",
}

# Fixed value: the tag of partners whose check was cleared by hand.
CLEARED_TAG = "2d0ec64c-6b29-40a9-a1d2-a4942c437bf3"

LABEL_OF = {code: label for code, label, _, _ in COHORTS}
GROUP_OF = {code: group for code, _, group, _ in COHORTS}
ACTION_OF = {code: action for code, _, _, action in COHORTS}
GROUP_ORDER = list(dict.fromkeys(GROUP_OF.values()))


def cohort_dim(spark: SparkSession, overrides: bool = False) -> DataFrame:
    """One row per cohort: 24 from the classifier, 25 with the override-only code."""
    rows = [row for row in COHORTS if overrides or row[0] not in OVERRIDE_ONLY]
    return spark.createDataFrame(
        rows, "cohort string, cohort_label string, l1_group string, triage_action string"
    )
