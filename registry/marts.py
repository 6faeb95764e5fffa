"""Composite queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from crewline.operators import bitmaps, calendars, counts
from crewline.plans import checks, funnel, markets, partners, shifts, stores, zones
from registry.core import COMPANIES, EVENT_TIE, NAMES, P, check, day, moment
from registry.relational import (
    _SENT, _bonuses, _zones, BONUS_SQL, FIRST, KPI_SQL, LAST, MARKET_SQL, NEAR_SQL, STORE_SQL, ZONE_LIST_SQL, ZONE_SQL,
)
from registry.scalars import _AGE, _AGO, CHECK_SQL, DEACT_SQL, GRID_SQL, MARK_SQL, OVERRIDE_SQL, _coded, _status
from registry.staging import Staged

# The look-up window: 90 days back, 30 ahead.
SINCE, UNTIL = P.day(-90), P.day(30)
CLIENT = f"company_name = 'BUILDING' AND shift_date BETWEEN DATE '{FIRST}' AND DATE '{LAST}'"


@check("SELECT zone_description, priority_cohort_l1, priority_cohort_l2, city, fill_rate_l7d, total_shifts_l7d, filled_shifts_l7d FROM o_market")
def target_markets(s: Staged):
    return markets.target_markets(s.supply_daily_position, s.store_crm, P)


@check(f"SELECT partner_id, status AS bgc_status_raw, COALESCE(result, 'no_bgc') AS bgc_result, {moment('updated_at')} AS bgc_submitted_at FROM o_last")
def bgc_latest(s: Staged):
    return checks.bgc_latest(s.background_checks, EVENT_TIE)


@check(f"SELECT partner_id, event AS bgc_adjudication_event, {moment('updated_at')} AS bgc_adjudication_date FROM o_adj")
def bgc_adjudication(s: Staged):
    return checks.bgc_adjudication(s.background_checks, P.adjudication_from, tie=EVENT_TIE)


@check(
    f"""SELECT b.partner_id, b.status AS bgc_status_raw, b.result AS bgc_result_raw, {moment('b.created_at')} AS bgc_started_at, {moment('b.updated_at')} AS bgc_submitted_at,
          a.event AS bgc_adjudication_event, {moment('a.updated_at')} AS bgc_adjudication_date FROM o_last b LEFT JOIN o_adj a ON a.partner_id = b.partner_id"""
)
def check_facts(s: Staged):
    return checks.check_facts(s.background_checks, P.adjudication_from, False, EVENT_TIE)


@check("SELECT * FROM o_dispatch")
def shift_dispatch(s: Staged):
    target = markets.target_markets(s.supply_daily_position, s.store_crm, P)
    return funnel.shift_dispatch(s.user_shifts, s.partner_throughput, target, P)


@check("SELECT partner_id, completed_shifts FROM o_done")
def completed_shifts(s: Staged):
    return funnel.completed_shifts(s.shift_assignments, P)


@check("SELECT partner_id FROM o_else")
def non_client_s1c(s: Staged):
    return funnel.non_client_s1c(s.partner_throughput, P)


@check("SELECT partner_id, partner_role_tier, lifetime_shifts FROM stg_reliability WHERE ds = DATE '2024-01-31'")
def partner_reliability(s: Staged):
    return funnel.reliability_today(s.partner_reliability, P)


@check(
    """SELECT d.code AS cohort, d.action AS triage_action, COUNT(c.cohort) AS total, COUNT(*) FILTER (c.priority_cohort_l2 LIKE 'C1:%') AS c1_subscale,
         COUNT(*) FILTER (c.priority_cohort_l2 LIKE 'C2a%') AS c2a_fr_below_80, COUNT(*) FILTER (c.priority_cohort_l2 LIKE 'C2b%') AS c2b_storesmart,
         COUNT(*) FILTER (c.priority_cohort_l2 LIKE 'C2c%') AS c2c_t25_fr_80_90
       FROM o_dim d LEFT JOIN o_coded c ON c.cohort = d.code WHERE d.code < '25' GROUP BY 1, 2"""
)
def funnel_summary(s: Staged):
    return funnel.funnel_summary(_coded(s))


ROSTER_SQL = f"""SELECT partner_id, first_name, last_name, NULL::VARCHAR AS phone_number, NULL::VARCHAR AS email, city, zone_description,
  ROUND(closest_store_proximity_miles, 1) AS closest_store_miles, ROUND(fill_rate_l7d, 3) AS fill_rate_l7d, {day('created_date')} AS dl_date,
  {day('oa_date')} AS oa_date, {day('op_date')} AS op_date, NULL::VARCHAR AS s1a_date, {day('s1c_date')} AS s1c_date, NULL::VARCHAR AS m1_date,
  {moment('last_active_at')} AS last_active_at, NULL::VARCHAR AS churn_status, ROUND(churn_probability, 3) AS churn_probability,
  shifts_worked_last_7d, shifts_assigned_next_7d, NULL::BIGINT AS days_since_last_shift_worked, total_shifts_last_4w, NULL::VARCHAR AS volume_label_current,
  NULL::DOUBLE AS evfr_score, NULL::DOUBLE AS pct_shift_success, partner_role_tier AS m1_tier, COALESCE(partner_role_tier = 'M1 - Active', FALSE) AS is_m1,
  bgc_result AS bgc_status, {moment('bgc_submitted_at')} AS bgc_submitted_at, adj_event AS bgc_adjudication_event, sent_l7d AS work_shifts_sent_l7d,
  accepted_l7d AS work_shifts_accepted_l7d, sent AS work_shifts_sent_next_7d, seen AS work_shifts_seen_next_7d, COALESCE(lifetime_shifts, 0) AS lifetime_shifts_worked,
  completed_shifts, cohort_l1, cohort_l2, triage_action, cohort AS cohort_combo, priority_cohort_l2 FROM o_roster"""


@check(ROSTER_SQL)
def funnel_roster(s: Staged):
    return funnel.funnel_roster(_coded(s), P)


@check(
    """SELECT DISTINCT s.hex_city_description AS city_name FROM stg_supply s WHERE s.company_name = 'BUILDING' AND s.shifts > 0
         AND s.snapshot_date = (SELECT MAX(snapshot_date) FROM stg_supply WHERE company_name = 'BUILDING')
         AND s.zone_description IN (SELECT zone_desc FROM stg_store_crm WHERE priority_cohort_l1 <> 'C9: Other')"""
)
def priority_markets(s: Staged):
    return markets.priority_markets(s.supply_daily_position, s.store_crm, "BUILDING")


def _stored(s: Staged):
    """Partners with the cohort, class and counts that a nightly job would have stored with them."""
    coded = _coded(s).withColumn("lifetime_ckp_food_shifts", F.col("lifetime_shifts"))
    stored = (
        "partner_cohort priority_cohort_l1 priority_cohort_l2 partner_role_tier bgc_result bgc_adjudication_event "
        "work_shifts_sent_next_7d work_shifts_seen_next_7d work_shifts_sent_l7d work_shifts_accepted_l7d lifetime_ckp_food_shifts"
    ).split()
    coded = coded.drop("partner_cohort").withColumnRenamed("cohort", "partner_cohort").select("partner_id", *stored)
    client = s.partner_throughput.where("company_name = 'BUILDING'").drop(*stored)
    return client.join(coded, "partner_id", "left")


V2_SQL = f"""partner_id, first_name, last_name, city_description AS city, zone_description, ROUND(closest_store_proximity_miles, 1) AS closest_store_miles,
  {day('created_date')} AS dl_date, {moment('last_active_at')} AS last_active_at, ROUND(churn_probability, 3) AS churn_probability,
  partner_role_tier, CAST(COALESCE(partner_role_tier LIKE 'M1%', FALSE) AS BIGINT) AS is_m1, bgc_result, priority_cohort_l1, priority_cohort_l2,
  sent AS work_shifts_sent_next_7d, lifetime_shifts AS lifetime_ckp_food_shifts,
  {day('oa_date')} AS oa_date, {day('op_date')} AS op_date, {day('s1c_date')} AS s1c_date, shifts_worked_last_7d, shifts_assigned_next_7d,
  total_shifts_last_4w, currently_suspended, currently_deactivated, is_fraud_partner"""
V2_COLUMNS = (
    "partner_id first_name last_name city zone_description closest_store_miles dl_date last_active_at churn_probability partner_role_tier is_m1 "
    "bgc_result priority_cohort_l1 priority_cohort_l2 lifetime_ckp_food_shifts bgc_adjudication_event partner_cohort "
    "oa_date op_date s1c_date shifts_worked_last_7d shifts_assigned_next_7d total_shifts_last_4w currently_suspended currently_deactivated is_fraud_partner"
).split()


def _v2(df):
    return df.select(*V2_COLUMNS, F.coalesce("work_shifts_sent_next_7d", F.lit(0)).alias("work_shifts_sent_next_7d"))


@check(f"SELECT {V2_SQL}, adj_event AS bgc_adjudication_event, cohort AS partner_cohort FROM o_coded WHERE priority_cohort_l2 <> 'C9: Other'")
def funnel_v2(s: Staged):
    return _v2(funnel.funnel_v2(_stored(s), P))


@check(OVERRIDE_SQL + f"SELECT {V2_SQL}, new_event AS bgc_adjudication_event, new_code AS partner_cohort FROM v_over WHERE priority_cohort_l2 <> 'C9: Other'")
def funnel_v2_overrides(s: Staged):
    return _v2(funnel.funnel_v2_overrides(_stored(s), s.user_certs, s.bgc_override, P, cleared_tag="tag_2"))


@check(
    OVERRIDE_SQL
    + """SELECT COUNT(*) AS total_pipeline, COUNT(*) FILTER (new_code[1:2] BETWEEN '01' AND '04') AS s1c_assigned, COUNT(*) FILTER (new_code[1:2] BETWEEN '05' AND '07') AS s1c_not_assigned,
           COUNT(*) FILTER (new_code[1:2] BETWEEN '08' AND '11') AS bgc_passed, COUNT(*) FILTER (new_code[1:2] BETWEEN '12' AND '15') AS op_pending_bgc,
           COUNT(*) FILTER (new_code[1:2] BETWEEN '16' AND '21') AS pre_op FROM v_over WHERE priority_cohort_l2 <> 'C9: Other'"""
)
def funnel_kpis(s: Staged):
    return funnel.funnel_kpis(funnel.funnel_v2_overrides(_stored(s), s.user_certs, s.bgc_override, P, cleared_tag="tag_2"))


@check(
    OVERRIDE_SQL
    + f"""SELECT zone_description, city, priority_cohort_l2, CAST(GROUPING(zone_description, city, priority_cohort_l2) AS BIGINT) AS gid,
           COUNT(*) AS total_pipeline, COUNT(*) FILTER (new_code[1:2] BETWEEN '01' AND '04') AS s1c_assigned, COUNT(*) FILTER (new_code[1:2] BETWEEN '05' AND '07') AS s1c_not_assigned,
           COUNT(*) FILTER (new_code[1:2] BETWEEN '08' AND '11') AS bgc_passed, COUNT(*) FILTER (new_code[1:2] BETWEEN '12' AND '15') AS op_pending_bgc,
           COUNT(*) FILTER (new_code[1:2] BETWEEN '16' AND '21') AS pre_op
    FROM (SELECT *, city_description AS city FROM v_over) WHERE priority_cohort_l2 <> 'C9: Other' GROUP BY CUBE (zone_description, city, priority_cohort_l2)"""
)
def funnel_kpi_cube(s: Staged):
    """Funnel KPIs for every choice of zone, city and class of the funnel page, from one cube."""
    return funnel.funnel_cube(funnel.funnel_v2_overrides(_stored(s), s.user_certs, s.bgc_override, P, cleared_tag="tag_2"))


@check(
    """WITH w_rows AS (SELECT c.cohort, r.cohort_l1, r.priority_cohort_l2 FROM o_coded c JOIN o_roster r ON r.partner_id = c.partner_id WHERE c.priority_cohort_l2 LIKE 'C2%'),
       w_roll AS (SELECT cohort_l1, cohort, COUNT(*) AS partners, CAST(GROUPING(cohort_l1, cohort) AS BIGINT) AS level FROM w_rows GROUP BY ROLLUP (cohort_l1, cohort))
       SELECT w.cohort_l1 AS l1_group, w.cohort, w.partners, w.level, d.label AS cohort_label, d.action AS triage_action,
         ROUND_EVEN(w.partners / (SELECT COUNT(*) FROM w_rows) * 100, 1) AS pct FROM w_roll w LEFT JOIN o_dim d ON d.code = w.cohort
       WHERE w.level = 3 OR w.cohort_l1 <> 'Unclassified'"""
)
def funnel_breakdown(s: Staged):
    chosen = {"priority_cohort_l2": ["C2a: FR<80 (Any)", "C2b: StoreSmart Alpha", "C2c: T25, FR 80-90%"], "city": []}
    return funnel.funnel_breakdown(_coded(s), "cohort", chosen)


@check(
    f"""SELECT partner_id, first_name, last_name, company_name, {day('op_date')} AS op_date, {moment('last_active_at')} AS last_active_at, total_shifts_last_4w, weeks_worked_last_4w,
          partner_lat, partner_lng, COUNT(*) OVER (PARTITION BY partner_id) AS companies, {_AGO} AS last_active_text, COALESCE({_AGE} <= 7, FALSE) AS recently_active,
          CAST(NULL AS VARCHAR) AS email, CAST(NULL AS VARCHAR) AS phone_number, CAST(NULL AS VARCHAR) AS msa, CAST(NULL AS VARCHAR) AS user_company_status FROM stg_partner"""
)
def partner_profile(s: Staged):
    """All columns; contact columns, market and status are not in the staged data and NULL on both sides."""
    return partners.partner_profile(s.partner_throughput, P.as_of_ts)


@check(CHECK_SQL + "SELECT * FROM k_all")
def bgc_status(s: Staged):
    return _status(s)


@check(
    DEACT_SQL
    + """SELECT d_all.event_id, d_all.partner_id, d_all.ds, d_all.is_banned, d_all.is_deactivated, COALESCE(d_all.deactivation_level, 'N/A') AS deactivation_level,
         status, company, last_reactivated, d_all.reactivation_date, x.deactivation_company, CAST(NULL AS VARCHAR) AS internal_reason
       FROM d_all JOIN stg_deactivation x USING (event_id) WHERE rn = 1"""
)
def deactivation_status(s: Staged):
    """All columns; the internal reason is not in the staged data and NULL on both sides."""
    return partners.deactivation_status(s.partner_deactivations, NAMES, EVENT_TIE)


@check(
    DEACT_SQL
    + """SELECT d_all.event_id, d_all.partner_id, d_all.ds, d_all.is_banned, d_all.is_deactivated, d_all.deactivation_level, d_all.reactivation_date, status, company,
         last_reactivated, x.deactivation_company, CAST(NULL AS VARCHAR) AS internal_reason FROM d_all JOIN stg_deactivation x USING (event_id)"""
)
def deactivation_history(s: Staged):
    """All columns; the internal reason is not in the staged data and NULL on both sides."""
    return partners.deactivation_history(s.partner_deactivations, NAMES)


@check(NEAR_SQL + "SELECT partner_id, company_name, rank, store_number, city, state_code, distance_miles, total_active_stores, stores_within_radius FROM n_near")
def nearest_stores(s: Staged):
    return stores.nearest_stores(s.partner_throughput, s.locations, COMPANIES)


OUTLOOK_SQL = """
, n_out AS (
  SELECT company_name, store_number, COUNT(*) FILTER (shift_date <= DATE '2024-01-31') AS l7d_shifts, MIN(shift_date) FILTER (shift_date >= DATE '2024-01-31') AS next_day
  FROM stg_assignment WHERE shift_date BETWEEN DATE '2024-01-24' AND DATE '2024-03-01' GROUP BY 1, 2)
SELECT n.partner_id, n.company_name, n.rank, n.store_number, n.distance_miles, COALESCE(o.l7d_shifts, 0) AS l7d_shifts,
  COALESCE(CAST(o.next_day AS VARCHAR), '—') AS next_shift, n.city || ', ' || n.state_code AS location
FROM n_near n LEFT JOIN n_out o ON o.company_name = n.company_name AND o.store_number = n.store_number"""


@check(NEAR_SQL + OUTLOOK_SQL)
def nearby_outlook(s: Staged):
    near = stores.nearest_stores(s.partner_throughput, s.locations, COMPANIES)
    out = stores.nearby_outlook(near, stores.store_outlook(s.shift_assignments, COMPANIES, P.as_of_date))
    return out.select("partner_id", "company_name", "rank", "store_number", "distance_miles", "l7d_shifts", "next_shift", "location")


def _sent(s: Staged):
    ends = [datetime.combine(d, datetime.min.time()) for d in (SINCE, UNTIL)]
    return partners.shifts_sent(s.user_shifts, *ends, P.as_of_ts, NAMES)


_IN_WINDOW = f"start_at >= TIMESTAMP '{SINCE}' AND start_at < TIMESTAMP '{UNTIL}'"


@check(
    f"""SELECT shift_key, partner_id, title, status, {moment('start_at')} AS shift_start, {moment('sent_at')} AS sent_at, {moment('seen_at')} AS seen_at,
          {moment('assigned_at')} AS assigned_at, {moment('completed_at')} AS completed_at,
          CASE company WHEN '1-URGENT' THEN 'Urgent Works' WHEN '2-HIGH' THEN 'High Works' ELSE company[1:8] || '...' END AS company_name,
          CASE WHEN status IN ('Assigned', 'Completed') OR assigned_at IS NOT NULL THEN 'accepted' WHEN status IN ('Canceled', 'Declined') THEN 'rejected' ELSE 'none' END AS row_class,
          CASE WHEN start_at < TIMESTAMP '2024-01-31 06:00:00' THEN 'past' ELSE 'future' END AS bucket
        FROM stg_user_shift WHERE {_IN_WINDOW}"""
)
def shifts_sent(s: Staged):
    columns = "shift_key partner_id title status shift_start sent_at seen_at assigned_at completed_at company_name row_class bucket".split()
    return _sent(s).select(*columns)


@check(
    f"""SELECT partner_id, 'both' AS rule, {_SENT.format(more='OR assigned_at IS NOT NULL')} FROM stg_user_shift WHERE {_IN_WINDOW} GROUP BY 1
        UNION ALL SELECT partner_id, 'status', {_SENT.format(more='')} FROM stg_user_shift WHERE {_IN_WINDOW} GROUP BY 1"""
)
def shifts_sent_kpis(s: Staged):
    return partners.offer_kpis(_sent(s))


@check(
    BONUS_SQL
    + """SELECT *, CAST(NULL AS VARCHAR) AS bonus_type, CAST(NULL AS VARCHAR) AS valid_from, CAST(NULL AS VARCHAR) AS valid_to,
         CAST(NULL AS BIGINT) AS days_to_complete FROM b_all"""
)
def partner_bonuses(s: Staged):
    """All columns; type and validity of a bonus are not in the staged data and NULL on both sides."""
    return _bonuses(s)


ASSIGNED_SQL = f"""
WITH a_all AS (
  SELECT partner_id, company_name, {day('shift_date')} AS shift_date, shift_id, assignment_status, shift_type, is_remote, {moment('start_at')} AS shift_start,
    {moment("start_at + INTERVAL 4 HOUR")} AS shift_end, 4.0::DOUBLE AS duration, store_number, payment_status, approval_status AS payment_approval,
    rate AS payment_rate, base_amount, shift_bonus_amount, total_amount FROM stg_assignment WHERE shift_date BETWEEN DATE '{SINCE}' AND DATE '{UNTIL}')
"""


@check(
    ASSIGNED_SQL
    + """SELECT * REPLACE (CAST(payment_rate AS DOUBLE) AS payment_rate, CAST(base_amount AS DOUBLE) AS base_amount,
           CAST(shift_bonus_amount AS DOUBLE) AS shift_bonus_amount, CAST(total_amount AS DOUBLE) AS total_amount) FROM a_all"""
)
def assignments(s: Staged):
    return partners.assignments(s.shift_assignments, SINCE, UNTIL)


@check(
    ASSIGNED_SQL
    + """SELECT partner_id, company_name, COUNT(*) AS assignments, CAST(SUM(total_amount) AS DOUBLE) AS total_pay,
           ROUND_EVEN(CAST(SUM(payment_rate) AS DOUBLE) / COUNT(payment_rate), 2) AS avg_rate FROM a_all GROUP BY 1, 2"""
)
def assignments_kpis(s: Staged):
    return counts.assignment_kpis(partners.assignments(s.shift_assignments, SINCE, UNTIL), ["partner_id", "company_name"])


@check(
    "WITH " + MARK_SQL.format(where=f"WHERE shift_date BETWEEN DATE '{SINCE}' AND DATE '{UNTIL}'").strip() + "," + GRID_SQL + "SELECT * FROM c_out"
)
def assignment_calendar(s: Staged):
    listed = partners.assignments(s.shift_assignments, SINCE, UNTIL)
    return calendars.calendar_grid(calendars.day_marks(listed, "partner_id"), "partner_id")


@check(f"SELECT partner_id, tag, title, {moment('updated_at')} AS updated_at FROM stg_user_cert")
def partner_tags(s: Staged):
    return partners.partner_tags(s.user_certs)


@check(f"SELECT partner_id, reporting_company, assessment_status, {moment('account_created')} AS account_created FROM stg_assessment")
def partner_assessments(s: Staged):
    return partners.partner_assessments(s.partner_assessment_status)


@check(MARKET_SQL + f"SELECT * FROM m_all WHERE {CLIENT.replace('DATE ', '')}")
def market_shifts(s: Staged):
    return shifts.market_shifts(shifts.shift_filter(s.shift_assignments, "BUILDING", FIRST, LAST))


@check(KPI_SQL.replace("FROM stg", ", 'exact' AS rule FROM stg") + f" WHERE {CLIENT} AND NOT is_noshow")
def market_shift_kpis(s: Staged):
    rows = shifts.market_shifts(shifts.shift_filter(s.shift_assignments, "BUILDING", FIRST, LAST))
    exact = shifts.market_kpis(rows, ["Completed", "Canceled", "Assigned"])
    return exact.withColumn("rule", F.lit("exact"))


@check(
    f"""SELECT b.zone_description, a.shift_id, a.partner_id, a.store_number, {day('a.shift_date')} AS shift_date FROM stg_assignment a
    JOIN (SELECT DISTINCT company_name, zone_description, store_cluster FROM stg_supply
          WHERE company_name IS NOT NULL AND zone_description IS NOT NULL AND store_cluster IS NOT NULL) b
      ON b.company_name = a.company_name AND b.store_cluster = a.store_cluster WHERE a.{CLIENT.replace(' AND shift_date', ' AND a.shift_date')}"""
)
def zone_shifts(s: Staged):
    """The client's shifts of every zone at once, through the zone-to-cluster bridge."""
    rows = shifts.shift_filter(s.shift_assignments, "BUILDING", FIRST, LAST)
    zoned = shifts.zoned_shifts(rows, shifts.zone_bridge(s.supply_daily_position))
    return zoned.select("zone_description", "shift_id", "partner_id", F.col("location.external_id").alias("store_number"), "shift_date")


# The completion statuses that the market page filters by.
STATUSES = ("Completed", "No Show", "Canceled", "Assigned")
_FILTERS = ", ".join(f"('{f}', '{v}')" for f, v in bitmaps.choices(STATUSES))


@check(
    MARKET_SQL + f""", f(filter, completion_status) AS (VALUES {_FILTERS})
SELECT filter, COUNT(DISTINCT partner_id) AS unique_partners, COUNT(DISTINCT store_number) AS store_count
FROM m_all JOIN f USING (completion_status) WHERE {CLIENT.replace('DATE ', '')} GROUP BY filter"""
)
def status_distinct_counts(s: Staged):
    """Distinct partners and stores of the client's shifts for every choice of statuses, from bitmaps."""
    rows = shifts.market_shifts(shifts.shift_filter(s.shift_assignments, "BUILDING", FIRST, LAST))
    return bitmaps.under_filters(rows, "completion_status", STATUSES, {"unique_partners": "partner_id", "store_count": "store_number"})


@check(
    f"""SELECT shift_id, partner_id, company_name, {day('shift_date')} AS shift_date, shift_title, {moment('start_at')} AS shift_start, store_number, store_name,
          TRIM(COALESCE(first_name, '') || ' ' || COALESCE(last_name, '')) AS partner_name, is_completed, is_noshow, is_canceled, CAST(total_amount AS DOUBLE) AS total_amount,
          CAST(shift_bonus_amount AS DOUBLE) AS shift_bonus_amount, approval_status, payment_status, CASE WHEN is_completed THEN {moment('start_at')} END AS check_in,
          shift_type, {moment("start_at + INTERVAL 4 HOUR")} AS shift_end, store_cluster AS zone, assignment_status, CAST(rate AS DOUBLE) AS rate,
          CAST(base_amount AS DOUBLE) AS base_amount FROM stg_assignment"""
)
def shift_detail(s: Staged):
    columns = (
        "shift_id partner_id company_name shift_date shift_title shift_start store_number store_name partner_name is_completed is_noshow is_canceled "
        "total_amount shift_bonus_amount approval_status payment_status check_in shift_type shift_end zone assignment_status rate base_amount"
    ).split()
    return shifts.shift_detail(s.shift_assignments).select(*columns)


def _client_rows(s: Staged):
    return zones.zone_rows(shifts.shift_filter(s.shift_assignments, "BUILDING", FIRST, LAST))


@check(ZONE_SQL + f" AND {CLIENT} GROUP BY 1")
def zone_summary(s: Staged):
    return zones.zone_summary(_client_rows(s))


@check(STORE_SQL + f" AND {CLIENT} GROUP BY 1, 2, 3")
def store_summary(s: Staged):
    return zones.store_summary(_client_rows(s))


@check(KPI_SQL + f" WHERE {CLIENT}")
def zone_kpis(s: Staged):
    return counts.shift_kpis(_client_rows(s))


@check(ZONE_LIST_SQL + "SELECT company, value, label, max_shifts FROM z_list")
def zone_list(s: Staged):
    return _zones(s, None)
