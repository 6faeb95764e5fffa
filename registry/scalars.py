"""Scalar expressions."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from crewline.functions import bgc, funnel as rules, geo, numbers, shifts as label, text, times
from crewline.operators import calendars
from crewline.operators.joins import flag_exists
from crewline.plans import checks, funnel, partners, shifts
from registry.core import COMPANIES, EVENT_TIE, NAMES, P, check, day, moment
from registry.relational import _MILES, BASE, BONUS_SQL, MARKET_SQL, ZONE_LIST_SQL, _bonuses, _zones
from registry.staging import Staged

SEASON = ("2023-11-01", "2024-03-01")


def _coded(s: Staged):
    return funnel.cohorted(s, P, EVENT_TIE)


@check("SELECT partner_id, cohort FROM o_coded")
def cohort_code(s: Staged):
    return _coded(s).select("partner_id", "cohort")


@check("SELECT partner_id, triage_action FROM o_roster")
def triage_action(s: Staged):
    return _coded(s).select("partner_id", rules.triage_action(F.col("cohort")).alias("triage_action"))


@check("SELECT partner_id, cohort_l1 FROM o_roster")
def cohort_l1(s: Staged):
    return _coded(s).select("partner_id", rules.cohort_l1(F.col("cohort")).alias("cohort_l1"))


@check("SELECT partner_id, cohort_l2 FROM o_roster")
def cohort_l2(s: Staged):
    return _coded(s).select("partner_id", rules.cohort_l2(F.col("cohort"), P.as_of_ts).alias("cohort_l2"))


@check(
    """SELECT store_num, CAST(CASE WHEN priority_cohort_l2 LIKE 'C1:%' THEN 1 WHEN priority_cohort_l2 LIKE 'C2a%' THEN 2
         WHEN priority_cohort_l2 LIKE 'C2b%' THEN 3 WHEN priority_cohort_l2 LIKE 'C2c%' THEN 4 ELSE 99 END AS BIGINT) AS l2_priority FROM stg_store_crm"""
)
def l2_priority(s: Staged):
    return s.store_crm.select("store_num", rules.l2_priority(F.col("priority_cohort_l2")).alias("l2_priority"))


OVERRIDE_SQL = """
WITH v_flags AS (
  SELECT c.*, o.partner_id IS NOT NULL AS overridden, EXISTS (SELECT 1 FROM stg_user_cert t WHERE t.partner_id = c.partner_id AND t.tag = 'tag_2') AS cleared
  FROM o_coded c LEFT JOIN stg_bgc_override o ON o.partner_id = c.partner_id),
v_over AS (
  SELECT *, CASE WHEN overridden THEN '25_former_failed_bgc' WHEN cleared AND cohort = '12_op_bgc_consider' AND sent > 0 THEN '10_bgc_passed_sent_not_seen'
    WHEN cleared AND cohort = '12_op_bgc_consider' THEN '11_bgc_passed_not_sent' ELSE cohort END AS new_code,
    CASE WHEN overridden THEN 'report.pre_adverse_action' ELSE adj_event END AS new_event FROM v_flags)
"""


@check(OVERRIDE_SQL + "SELECT partner_id, new_code, new_event FROM v_over")
def override_cohort(s: Staged):
    rows = flag_exists(_coded(s), s.bgc_override, "partner_id", "overridden")
    rows = flag_exists(rows, s.user_certs.where("tag = 'tag_2'"), "partner_id", "cleared")
    code = rules.override_cohort(F.col("cohort"), F.col("overridden"), F.col("cleared"), F.col("work_shifts_sent_next_7d"))
    event = rules.override_event(F.col("bgc_adjudication_event"), F.col("overridden"))
    return rows.select("partner_id", code.alias("new_code"), event.alias("new_event"))


@check("SELECT external_id, COALESCE(city, state_code, 'unknown') AS place, CASE WHEN is_active THEN 'open' ELSE 'closed' END AS state FROM stg_location")
def null_defaults(s: Staged):
    state = F.when(F.col("is_active"), "open").otherwise("closed").alias("state")
    return s.locations.select("external_id", F.coalesce("city", "state_code", F.lit("unknown")).alias("place"), state)


_RESULT = """COALESCE(result, CASE status WHEN 'report_clear' THEN 'clear' WHEN 'report_consider' THEN 'consider' WHEN 'invitation_pending' THEN 'pending' ELSE 'no_bgc' END)"""


@check(f"SELECT event_id, {_RESULT} AS bgc_result FROM stg_background_check")
def bgc_result(s: Staged):
    return s.background_checks.select("event_id", bgc.bgc_result(F.col("result"), F.col("status")).alias("bgc_result"))


CHECK_SQL = f"""
WITH k_adj AS (
  SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY partner_id ORDER BY updated_at DESC, event_id DESC) AS rn FROM stg_background_check
    WHERE event LIKE '%adverse_action' OR (event = 'report.engaged' AND (result = 'consider' OR updated_at < TIMESTAMP '2024-01-10'))) WHERE rn = 1),
k_base AS (
  SELECT b.partner_id, b.status AS bgc_status_raw, {_RESULT.replace('result,', 'b.result,').replace('status WHEN', 'b.status WHEN', 1)} AS bgc_result,
    b.created_at, b.updated_at, a.event, a.updated_at AS decided_at FROM o_last b LEFT JOIN k_adj a ON a.partner_id = b.partner_id),
k_all AS (
  SELECT partner_id, bgc_status_raw, bgc_result, {moment('created_at')} AS bgc_started_at, {moment('updated_at')} AS bgc_updated_at,
    event AS bgc_adjudication_event, {moment('decided_at')} AS bgc_adjudication_date,
    CASE WHEN event = 'report.engaged' THEN 'Cleared (Adjudicated)' WHEN event IS NOT NULL THEN 'Failed (Post-Adverse)'
      ELSE COALESCE(MAP {{'clear': 'Clear', 'consider': 'Consider (Pending Review)', 'pending': 'Pending', 'suspended': 'Suspended', 'cancelled': 'Cancelled'}}[bgc_result], 'Not Submitted')
      END AS bgc_display_status,
    event IS NOT DISTINCT FROM 'report.engaged' OR (event IS NULL AND bgc_result = 'clear') AS bgc_passed,
    CASE WHEN event = 'report.engaged' THEN 'Cleared' WHEN event IS NOT NULL THEN 'Failed'
      ELSE MAP {{'clear': 'Passed', 'consider': 'Review needed', 'pending': 'In progress'}}[bgc_result] END AS bgc_delta,
    CASE event WHEN 'report.engaged' THEN 'Cleared' WHEN 'report.pre_adverse_action' THEN 'Pre-Adverse' WHEN 'report.post_adverse_action' THEN 'Post-Adverse' END
      || ' (' || {day('CAST(decided_at AS DATE)')} || ')' AS adjudication_label FROM k_base)
"""


def _status(s: Staged):
    return checks.bgc_status(s.background_checks, P.adjudication_from, EVENT_TIE)


@check(CHECK_SQL + "SELECT partner_id, bgc_display_status, bgc_passed FROM k_all")
def bgc_display(s: Staged):
    return _status(s).select("partner_id", "bgc_display_status", "bgc_passed")


@check(CHECK_SQL + "SELECT partner_id, bgc_delta FROM k_all")
def bgc_delta(s: Staged):
    return _status(s).select("partner_id", "bgc_delta")


@check(CHECK_SQL + "SELECT partner_id, adjudication_label FROM k_all")
def adj_label(s: Staged):
    return _status(s).select("partner_id", "adjudication_label")


@check(MARKET_SQL + "SELECT shift_id, partner_id, store_number, completion_status FROM m_all")
def completion_status(s: Staged):
    return shifts.market_shifts(s.shift_assignments).select("shift_id", "partner_id", "store_number", "completion_status")


@check("SELECT DISTINCT partner_id, TRIM(COALESCE(first_name, '') || ' ' || COALESCE(last_name, '')) AS partner_name FROM stg_assignment")
def full_name(s: Staged):
    name = text.full_name(F.col("partner.first_name"), F.col("partner.last_name")).alias("partner_name")
    return s.shift_assignments.select("partner_id", name).distinct()


@check(f"SELECT event_id, {moment('updated_at')} AS updated_at FROM stg_background_check")
def dt_string(s: Staged):
    return s.background_checks.select("event_id", times.dt_string(F.col("updated_at")).alias("updated_at"))


@check(
    f"""SELECT event_id, {day('CAST(updated_at AS DATE)')} AS on_day, {day('CAST(updated_at AS DATE) + 7')} AS week_later,
          {moment("CAST(CAST(updated_at AS DATE) AS TIMESTAMP)")} AS at_midnight FROM stg_background_check"""
)
def date_casts(s: Staged):
    on = F.to_date("updated_at")
    return s.background_checks.select(
        "event_id", on.alias("on_day"), F.date_add(on, 7).alias("week_later"), on.cast("timestamp_ntz").alias("at_midnight")
    )


@check(
    f"""SELECT shift_key, {moment("start_at - INTERVAL 24 HOUR")} AS day_before, {day("CAST(start_at AS DATE) - 7")} AS week_before,
          {day("CAST(start_at AS DATE) + 30")} AS month_after FROM stg_user_shift"""
)
def interval_math(s: Staged):
    start = F.col("start")
    return s.user_shifts.select(
        "shift_key", (start - F.expr("INTERVAL 24 HOUR")).alias("day_before"),
        F.date_sub(F.to_date(start), 7).alias("week_before"), F.date_add(F.to_date(start), 30).alias("month_after"),
    )


@check(
    """SELECT event_id, '2024-01-31' AS as_of_date, '2024-01-31 01:00:00.000000' AS as_of_ts, updated_at < TIMESTAMP '2024-01-31 01:00:00' AS earlier FROM stg_background_check"""
)
def as_of(s: Staged):
    today, now = times.as_of(datetime(2024, 1, 31, 6, tzinfo=timezone.utc), "America/New_York")
    return s.background_checks.select(
        "event_id", F.lit(today).alias("as_of_date"), times.ntz(now).alias("as_of_ts"), (F.col("updated_at") < times.ntz(now)).alias("earlier")
    )


@check("SELECT shift_id, partner_id, ROUND(CAST(rate AS DOUBLE) / 8, 1) AS rounded FROM stg_assignment")
def round_half_up(s: Staged):
    return s.shift_assignments.select("shift_id", "partner_id", F.round(F.col("payment.rate").cast("double") / 8, 1).alias("rounded"))


@check("SELECT shift_id, partner_id, ROUND_EVEN(CAST(rate AS DOUBLE) / 8, 1) AS rounded FROM stg_assignment")
def round_half_even(s: Staged):
    return s.shift_assignments.select("shift_id", "partner_id", F.bround(F.col("payment.rate").cast("double") / 8, 1).alias("rounded"))


@check(f"SELECT DISTINCT z.hex_city_description AS city, {BASE} AS base FROM stg_supply z")
def zone_base_city(s: Staged):
    city = F.col("hex_city_description")
    return s.supply_daily_position.select(city.alias("city"), text.zone_base_city(city).alias("base")).distinct()


@check(
    """SELECT shift_key, CASE company WHEN '1-URGENT' THEN 'Urgent Works' WHEN '2-HIGH' THEN 'High Works' ELSE company[1:8] || '...' END AS company_name FROM stg_user_shift"""
)
def map_company(s: Staged):
    return s.user_shifts.select("shift_key", text.map_company(F.col("company"), NAMES).alias("company_name"))


@check(BONUS_SQL + "SELECT partner_id, bonus_id, COUNT(*) AS n, MIN(companies) AS companies FROM b_all GROUP BY 1, 2")
def map_companies(s: Staged):
    return _bonuses(s).groupBy("partner_id", "bonus_id").agg(F.count("*").alias("n"), F.min("companies").alias("companies"))


DEACT_SQL = f"""
WITH d_all AS (
  SELECT event_id, partner_id, {day('ds')} AS ds, is_banned, is_deactivated, deactivation_level, {day('reactivation_date')} AS reactivation_date,
    CASE WHEN is_banned THEN 'BANNED' WHEN is_deactivated THEN 'Deactivated' ELSE 'Active' END AS status,
    CASE WHEN deactivation_company IS NULL THEN 'N/A' WHEN deactivation_company = 'unit_0' THEN 'Unit Zero' WHEN deactivation_company = 'unit_1' THEN 'Unit One'
      ELSE deactivation_company[1:20] END AS company, COALESCE({day('reactivation_date')}, 'Never') AS last_reactivated,
    ROW_NUMBER() OVER (PARTITION BY partner_id ORDER BY d.ds DESC, event_id DESC) AS rn FROM stg_deactivation d)
"""


@check(DEACT_SQL + "SELECT event_id, company FROM d_all")
def map_company_long(s: Staged):
    return partners.deactivation_history(s.partner_deactivations, NAMES).select("event_id", "company")


@check(DEACT_SQL + "SELECT event_id, status, last_reactivated FROM d_all")
def deact_status(s: Staged):
    return partners.deactivation_history(s.partner_deactivations, NAMES).select("event_id", "status", "last_reactivated")


@check(
    f"""SELECT a.partner_id, a.shift_id, a.store_number, {_MILES.format(a='p', b='l')} AS distance_miles FROM stg_assignment a
        JOIN (SELECT DISTINCT partner_id, partner_lat AS lat, partner_lng AS lng FROM stg_partner) p ON p.partner_id = a.partner_id
        JOIN stg_location l ON l.external_id = a.store_number"""
)
def distance_miles(s: Staged):
    homes = s.partner_throughput.select("partner_id", "partner_lat", "partner_lng").distinct()
    shops = s.locations.select(F.col("external_id").alias("store_number"), "lat", "lng")
    rows = s.shift_assignments.select("partner_id", "shift_id", F.col("location.external_id").alias("store_number"))
    miles = geo.distance_miles(F.col("partner_lat"), F.col("partner_lng"), F.col("lat"), F.col("lng"))
    return rows.join(homes, "partner_id").join(shops, "store_number").select("partner_id", "shift_id", "store_number", miles.alias("distance_miles"))


@check(
    """SELECT event_id, COALESCE(count_progress, 0) || '/' || COALESCE(CAST(shifts_required AS VARCHAR), '?') AS progress FROM stg_bonus_progress"""
)
def progress(s: Staged):
    return s.bonus_progress.select("event_id", text.progress(F.col("count_progress"), F.col("shifts_required")).alias("progress"))


@check(
    """SELECT event_id, CASE WHEN is_viewed THEN 'Yes' ELSE 'No' END AS opted_in, CASE WHEN is_complete THEN 'Complete' ELSE 'In Progress' END AS status FROM stg_bonus_progress"""
)
def bonus_flags(s: Staged):
    return s.bonus_progress.select(
        "event_id", label.opted_in(F.col("is_viewed")).alias("opted_in"), label.bonus_status(F.col("is_complete")).alias("status")
    )


@check(f"SELECT shift_key, {moment('TRY_CAST(CASE WHEN shift_key % 2 = 0 THEN CAST(start_at AS VARCHAR) ELSE title END AS TIMESTAMP)')} AS start FROM stg_user_shift")
def try_ts(s: Staged):
    raw = F.when(F.col("shift_key") % 2 == 0, F.col("start").cast("string")).otherwise(F.col("title"))
    return s.user_shifts.select("shift_key", times.try_ts(raw).alias("start"))


_AGE = "CAST(FLOOR(EPOCH(TIMESTAMP '2024-01-31 06:00:00' - last_active_at) / 86400) AS BIGINT)"
_AGO = f"CASE WHEN last_active_at IS NULL THEN 'Unknown' WHEN {_AGE} = 0 THEN 'Today' WHEN {_AGE} = 1 THEN 'Yesterday' ELSE {_AGE} || 'd ago' END"


@check(f"SELECT partner_id, company_name, {_AGO} AS age FROM stg_partner")
def days_ago(s: Staged):
    return s.partner_throughput.select("partner_id", "company_name", times.days_ago(F.col("last_active_at"), P.as_of_ts).alias("age"))


@check(f"SELECT partner_id, company_name, COALESCE({_AGE} <= 7, FALSE) AS recent FROM stg_partner")
def recently_active(s: Staged):
    return s.partner_throughput.select("partner_id", "company_name", times.recently_active(F.col("last_active_at"), P.as_of_ts).alias("recent"))


@check(
    """SELECT 'shift' AS kind, shift_key AS id, CASE WHEN status IN ('Assigned', 'Completed') OR assigned_at IS NOT NULL THEN 'accepted'
         WHEN status IN ('Canceled', 'Declined') THEN 'rejected' ELSE 'none' END AS row_class FROM stg_user_shift
       UNION ALL SELECT 'bonus', event_id, CASE WHEN is_complete OR is_viewed THEN 'in' ELSE 'not_in' END FROM stg_bonus_progress"""
)
def row_class(s: Staged):
    offers = s.user_shifts.select(F.lit("shift").alias("kind"), F.col("shift_key").alias("id"), label.row_class(F.col("status"), F.col("assigned_at")).alias("row_class"))
    return offers.union(s.bonus_progress.select(F.lit("bonus"), "event_id", label.bonus_class(F.col("is_complete"), F.col("is_viewed"))))


@check("SELECT partner_id, CAST(CASE WHEN LOWER(partner_role_tier) LIKE '%m1%' THEN 1 ELSE 0 END AS BIGINT) AS is_m1 FROM stg_reliability")
def is_m1_any(s: Staged):
    return s.partner_reliability.select("partner_id", label.is_m1_any(F.col("partner_role_tier")).alias("is_m1"))


@check(ZONE_LIST_SQL + "SELECT company, value AS zone, label FROM z_list")
def zone_label(s: Staged):
    return _zones(s, None).select("company", F.col("value").alias("zone"), "label")


@check(
    """SELECT store_number, shift_date::VARCHAR AS shift_date, CASE WHEN COUNT(*) FILTER (shift_type = 'work') = 0 THEN 0.0
         ELSE COUNT(*) FILTER (is_completed AND shift_type = 'work') / COUNT(*) FILTER (shift_type = 'work') * 100 END AS fill_rate FROM stg_assignment GROUP BY 1, 2"""
)
def fill_rate(s: Staged):
    work = F.col("shift.type") == "work"
    per_day = s.shift_assignments.groupBy(F.col("location.external_id").alias("store_number"), "shift_date").agg(
        F.count_if(work & F.col("assignment.is_completed")).alias("done"), F.count_if(work).alias("n")
    )
    return per_day.select("store_number", "shift_date", numbers.fill_rate(F.col("done"), F.col("n")).alias("fill_rate"))


MARK_SQL = """
c_mark AS (
  SELECT partner_id, shift_date, COUNT(*) AS shifts, CASE WHEN BOOL_OR(assignment_status = 'Completed') THEN 'green'
    WHEN BOOL_OR(assignment_status IN ('Canceled', 'NoShow')) THEN 'red' ELSE 'blue' END AS day_class FROM stg_assignment {where} GROUP BY 1, 2)
"""
GRID_SQL = """
c_month AS (
  SELECT partner_id, CAST(UNNEST(generate_series(date_trunc('month', MIN(shift_date))::TIMESTAMP, date_trunc('month', MAX(shift_date))::TIMESTAMP, INTERVAL 1 MONTH)) AS DATE) AS month_start
  FROM c_mark GROUP BY 1),
c_cell AS (
  SELECT partner_id, month_start, UNNEST(generate_series(0, 41)) AS i, month_start - CAST((isodow(month_start) - 1) AS INTEGER) AS monday FROM c_month),
c_grid AS (
  SELECT c.partner_id, c.month_start::VARCHAR AS month_start, CAST(i // 7 AS BIGINT) AS week, CAST(i % 7 AS BIGINT) AS weekday,
    CAST(CASE WHEN date_trunc('month', monday + CAST(i AS INTEGER)) = month_start THEN day(monday + CAST(i AS INTEGER)) ELSE 0 END AS BIGINT) AS day,
    CASE WHEN date_trunc('month', monday + CAST(i AS INTEGER)) = month_start THEN monday + CAST(i AS INTEGER) END AS cell FROM c_cell c
  WHERE monday + CAST(i - i % 7 AS INTEGER) <= last_day(month_start)),
c_out AS (
  SELECT g.partner_id, g.month_start, g.week, g.weekday, g.day, g.cell::VARCHAR AS shift_date, COALESCE(m.shifts, 0) AS shifts, m.day_class
  FROM c_grid g LEFT JOIN c_mark m ON m.partner_id = g.partner_id AND m.shift_date = g.cell)
"""


@check(
    "WITH " + MARK_SQL.format(where="WHERE shift_date BETWEEN DATE '2023-11-01' AND DATE '2024-03-01'").strip() + "," + GRID_SQL + "SELECT * FROM c_out"
)
def calendar_grid(s: Staged):
    rows = s.shift_assignments.where(F.col("shift_date").between(*[F.lit(d).cast("date") for d in SEASON]))
    return calendars.calendar_grid(calendars.day_marks(rows, "partner_id"), "partner_id")


@check("WITH " + MARK_SQL.format(where="").strip() + "SELECT partner_id, shift_date::VARCHAR AS shift_date, shifts, day_class FROM c_mark")
def day_class(s: Staged):
    return calendars.day_marks(s.shift_assignments, "partner_id")
