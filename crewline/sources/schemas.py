"""Declared source schemas.

Each table maps ``source column -> (type, name used by the marts)``; a plain type keeps the name.
"""

from __future__ import annotations

from pyspark.sql import types as T

STRING, LONG, DOUBLE = T.StringType(), T.LongType(), T.DoubleType()
BOOL, DATE, DATETIME = T.BooleanType(), T.DateType(), T.TimestampNTZType()
MONEY = T.DecimalType(12, 2)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


def _many(dtype: T.DataType, names: str) -> dict:
    return {name: dtype for name in names.split()}


TABLES: dict[str, dict] = {
    "partner_throughput": {
        **_many(STRING, "partner_id first_name last_name phone_number email company_name msa"),
        **_many(STRING, "zone_description city_description closest_store_cluster"),
        "closest_store_proximity_miles": DOUBLE,
        **_many(DATE, "created_date oa_date op_date s1a_date s1c_date m1_date"),
        **_many(STRING, "oa_shift_type op_shift_type churn_status volume_label_current"),
        "last_active_at": DATETIME,
        **_many(LONG, "shifts_worked_last_7d shifts_assigned_next_7d days_since_last_shift_worked"),
        **_many(LONG, "total_shifts_last_4w weeks_worked_last_4w"),
        **_many(BOOL, "currently_suspended currently_deactivated is_fraud_partner"),
        **_many(DOUBLE, "churn_probability rolling_l50shifts_reliability_score evfr_score"),
        **_many(DOUBLE, "pct_shift_success partner_lat partner_lng"),
        **_many(STRING, "partner_role_tier bgc_result bgc_adjudication_event"),
        **_many(LONG, "work_shifts_sent_l7d work_shifts_accepted_l7d work_shifts_sent_next_7d"),
        **_many(LONG, "work_shifts_seen_next_7d lifetime_ckp_food_shifts"),
        **_many(STRING, "ckp_food_completed_flag priority_cohort_l1 priority_cohort_l2"),
        **_many(STRING, "partner_cohort user_company_status"),
    },
    "supply_daily_position": {
        **_many(STRING, "company_name position zone_description hex_city_description store_cluster"),
        "date": DATE,
        **_many(LONG, "shifts filled"),
    },
    "store_crm": _many(STRING, "zone_desc store_num priority_cohort_l1 priority_cohort_l2"),
    "background_checks": {
        "userId": (STRING, "partner_id"),
        **_many(STRING, "status result"),
        "webhookEventType": (STRING, "event"),
        "createdAt": (DATETIME, "created_at"),
        "updatedAt": (DATETIME, "updated_at"),
    },
    "user_shifts": {
        "user": (STRING, "partner_id"),
        **_many(STRING, "company title status payment_status"),
        **_many(DATETIME, "start end sent_at seen_at assigned_at confirmed_at"),
        **_many(DATETIME, "completed_at canceled_at declined_at"),
        **_many(DOUBLE, "duration rate"),
    },
    "partner_reliability": {
        "user": (STRING, "partner_id"),
        "ds": DATE,
        "partner_role_tier": STRING,
        "rolling_lifetime_ckp_closed_loop_cook_shifts": (LONG, "lifetime_shifts"),
    },
    "shift_assignments": {
        **_many(STRING, "company_name shift_id shift_title partner_id assignment_status"),
        "shift_date": DATE,
        "shift": _struct(type=STRING, start=DATETIME, end=DATETIME, duration=DOUBLE, is_remote=BOOL),
        "location": _struct(external_id=STRING, store_cluster=STRING, saved_location_name=STRING),
        "partner": _struct(first_name=STRING, last_name=STRING),
        "assignment": _struct(is_completed=BOOL, is_noshow=BOOL, is_canceled=BOOL),
        "payment": _struct(
            rate=MONEY, base_amount=MONEY, shift_bonus_amount=MONEY, total_amount=MONEY,
            approval_status=STRING, status=STRING,
        ),
        "attendance": _struct(check_in_at=DATETIME, check_out_at=DATETIME),
    },
    "locations": {
        **_many(STRING, "external_id company_name city state_code hex"),
        **_many(DOUBLE, "lat lng"),
        "is_active": BOOL,
    },
    "bonus_eligible_users": {"uuid": (STRING, "bonus_id"), "user_id": (STRING, "partner_id")},
    "bonus_progress": {
        "paymentBonusId": (STRING, "bonus_id"),
        "userId": (STRING, "partner_id"),
        "title": STRING,
        "bonusType": (STRING, "bonus_type"),
        "amount": DOUBLE,
        "count": (LONG, "shifts_required"),
        "countProgress": (LONG, "count_progress"),
        "isComplete": (BOOL, "is_complete"),
        "isViewedByWorker": (BOOL, "is_viewed"),
        "validFrom": (DATETIME, "valid_from"),
        "validTo": (DATETIME, "valid_to"),
        "companies": T.ArrayType(STRING),
        "daysToComplete": (LONG, "days_to_complete"),
        "updatedAt": (DATETIME, "updated_at"),
    },
    "partner_deactivations": {
        "partner_id": STRING,
        "ds": DATE,
        **_many(BOOL, "is_banned is_deactivated"),
        **_many(STRING, "deactivation_level deactivation_company internal_reason"),
        "reactivation_date": DATE,
    },
    "user_certs": {
        "user": (STRING, "partner_id"),
        **_many(STRING, "tag title"),
        "updatedAt": (DATETIME, "updated_at"),
    },
    "partner_assessment_status": {
        "user_id": (STRING, "partner_id"),
        **_many(STRING, "reporting_company assessment_status"),
        "ts_account_created": DATETIME,
    },
    "bgc_override": {"partner_id": STRING},
}


def _parts(name: str):
    for source, spec in TABLES[name].items():
        dtype, target = spec if isinstance(spec, tuple) else (spec, source)
        yield source, dtype, target


def source_schema(name: str) -> T.StructType:
    """Schema as stored."""
    return T.StructType([T.StructField(source, dtype) for source, dtype, _ in _parts(name)])


def mart_schema(name: str) -> T.StructType:
    """Schema after renaming, as the marts see it."""
    return T.StructType([T.StructField(target, dtype) for _, dtype, target in _parts(name)])


def renames(name: str) -> dict[str, str]:
    return {source: target for source, _, target in _parts(name) if source != target}
