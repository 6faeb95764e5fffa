"""Scans, filters, joins, aggregates, windows, sorts."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from crewline.functions import bgc, shifts as label
from crewline.functions.text import other_cities, zone_base_city
from crewline.operators import calendars, counts, filters, joins, latest, ordering, rollup
from crewline.operators.nearest import nearest_k as nearest
from crewline.plans import bonuses, checks, funnel, markets, shifts, stores, zones
from crewline.session import shared_dir
from crewline.sources import dimensions as dims, schemas, sinks, tables
from registry.core import COMPANIES, EVENT_TIE, NAMES, P, check, day, moment
from registry.staging import Staged

FIRST, LAST = date(2023, 11, 2), date(2024, 3, 1)
SAVED_AT = datetime(2024, 1, 31, 6)


# --- scans, sources, sinks -------------------------------------------------------------------


@check(f"SELECT partner_id, tag, title, {moment('updated_at')} AS updated_at FROM stg_user_cert")
def read(s: Staged):
    stored = s.user_certs.withColumnsRenamed({new: old for old, new in schemas.renames("user_certs").items()})
    path = shared_dir(s.spark)
    stored.write.parquet(path)
    return tables.read(s.spark, "user_certs", path, ["partner_id", "tag", "title", "updated_at"])


@check(
    """SELECT p.partner_id, p.company_name, o.partner_id IS NOT NULL AS listed, FALSE AS listed_without_source
       FROM stg_partner p LEFT JOIN stg_bgc_override o ON o.partner_id = p.partner_id"""
)
def with_optional(s: Staged):
    schema = schemas.source_schema("bgc_override")
    path = shared_dir(s.spark)
    sinks.materialize(s.bgc_override, path)
    rows = s.partner_throughput.select("partner_id", "company_name")
    rows = joins.flag_exists(rows, tables.with_optional(s.spark, path, schema), "partner_id", "listed")
    absent = tables.with_optional(s.spark, f"{s.folder}/bgc_override.parquet", schema)
    return joins.flag_exists(rows, absent, "partner_id", "listed_without_source")


@check(
    """SELECT d.action AS triage_action, d.l1_group, COUNT(*) AS partners FROM o_coded c JOIN o_dim d ON d.code = c.cohort GROUP BY 1, 2"""
)
def cohort_dim(s: Staged):
    dim = F.broadcast(dims.cohort_dim(s.spark))  # 24 rows
    return funnel.cohorted(s, P, EVENT_TIE).join(dim, "cohort").groupBy("triage_action", "l1_group").agg(F.count("*").alias("partners"))


BASE = "regexp_replace(replace(z.hex_city_description, '_', ' '), ' [^ ]*$', '')"
ZONE_LIST_SQL = f"""
WITH z_last AS (
  SELECT company_name, zone_description, hex_city_description, MAX(shifts) AS max_shifts FROM stg_supply s
  WHERE shifts > 0 AND snapshot_date = (SELECT MAX(snapshot_date) FROM stg_supply x WHERE x.company_name = s.company_name) GROUP BY 1, 2, 3),
z_city AS (
  SELECT DISTINCT s.company_name, s.zone_description, l.city FROM stg_supply s
  JOIN stg_location l ON l.hex = s.store_cluster AND l.company_name = s.company_name
  WHERE s.snapshot_date >= DATE '2024-01-24' AND s.shifts > 0 AND l.is_active AND l.city IS NOT NULL),
z_extra AS (
  SELECT z.company_name, z.zone_description, z.hex_city_description,
    LIST(c.city ORDER BY c.city) FILTER (LOWER(c.city) <> LOWER({BASE})) AS extra
  FROM z_last z LEFT JOIN z_city c ON c.company_name = z.company_name AND c.zone_description = z.zone_description GROUP BY 1, 2, 3),
z_list AS (
  SELECT z.company_name AS company, z.zone_description AS value, z.max_shifts,
    z.hex_city_description || ' | ' || z.zone_description ||
      CASE WHEN len(e.extra) > 0 THEN ' (incl. ' || array_to_string(e.extra[1:3], ', ') || ')' ELSE '' END AS label
  FROM z_last z JOIN z_extra e ON e.company_name = z.company_name AND e.zone_description = z.zone_description
    AND e.hex_city_description = z.hex_city_description)
"""


def _zones(s: Staged, company: str | None):
    return zones.zone_list(s.supply_daily_position, s.locations, company and [company], P.as_of_date)


def _saved_zones(s: Staged) -> str:
    path = shared_dir(s.spark)
    for company in ("BUILDING", "FURNITURE", "BUILDING"):  # the last save replaces one company only
        sinks.save_zones(_zones(s, company), path, SAVED_AT)
    return path


@check(ZONE_LIST_SQL + f"SELECT company, label, value, {moment(repr(str(SAVED_AT)) + '::TIMESTAMP')} AS updated_at FROM z_list WHERE company IN ('BUILDING', 'FURNITURE')")
def save_zones(s: Staged):
    return tables.with_optional(s.spark, _saved_zones(s), sinks.ZONE_LIST).select("company", "label", "value", "updated_at")


@check(ZONE_LIST_SQL + "SELECT label, value, TRUE AS others_absent FROM z_list WHERE company = 'FURNITURE'")
def load_zones(s: Staged):
    path = _saved_zones(s)
    absent = sinks.load_zones(s.spark, path, "MACHINERY") is None and sinks.load_zones(s.spark, path + "-none", "BUILDING") is None
    return sinks.load_zones(s.spark, path, "FURNITURE").select("label", "value", F.lit(absent).alias("others_absent"))


@check(
    """SELECT store_cluster AS zone_hex, COUNT(*) AS total_shifts, COUNT(*) FILTER (is_completed) AS completed
       FROM stg_assignment WHERE store_cluster IS NOT NULL GROUP BY 1"""
)
def export_csv(s: Staged):
    path = shared_dir(s.spark)
    summary = zones.zone_summary(zones.zone_rows(s.shift_assignments)).select("zone_hex", "total_shifts", "completed")
    sinks.export_csv(summary, path)
    return s.spark.read.option("header", True).schema(summary.schema).csv(path)


@check(
    """SELECT 'zone' AS part, store_cluster AS item, COUNT(*) AS n FROM stg_assignment WHERE store_cluster IS NOT NULL GROUP BY 2
       UNION ALL SELECT 'all', NULL, COUNT(*) FROM stg_assignment"""
)
def materialize(s: Staged):
    rows = sinks.materialize(zones.zone_rows(s.shift_assignments))
    summary = zones.zone_summary(rows).select(F.lit("zone").alias("part"), F.col("zone_hex").alias("item"), F.col("total_shifts").alias("n"))
    total = rows.agg(F.count("*").alias("n")).select(F.lit("all").alias("part"), F.lit(None).cast("string").alias("item"), "n")
    return summary.union(total)


# --- projections, filters, predicates --------------------------------------------------------


@check(f"SELECT partner_id, {day('created_date')} AS dl_date, zone_description AS zone, {day('s1c_date')} AS first_completed FROM stg_partner")
def project_rename(s: Staged):
    return s.partner_throughput.select(
        "partner_id", F.col("created_date").alias("dl_date"), F.col("zone_description").alias("zone"), F.col("s1c_date").alias("first_completed")
    )


@check(
    f"""SELECT shift_id, shift_type, {moment('start_at')} AS shift_start, {moment("start_at + INTERVAL 4 HOUR")} AS shift_end,
        store_number, store_cluster AS zone, is_completed, CAST(rate AS DOUBLE) AS rate, first_name FROM stg_assignment"""
)
def nested_projection(s: Staged):
    return s.shift_assignments.select(
        "shift_id", F.col("shift.type").alias("shift_type"), F.col("shift.start").alias("shift_start"), F.col("shift.end").alias("shift_end"),
        F.col("location.external_id").alias("store_number"), F.col("location.store_cluster").alias("zone"),
        "assignment.is_completed", "payment.rate", "partner.first_name",
    )


@check(
    """SELECT store_num, priority_cohort_l2 FROM stg_store_crm
       WHERE priority_cohort_l1 IN ('C1: Root Cause Diagnosis', 'C2: Unblock Partner Funnel')"""
)
def isin_filter(s: Staged):
    return s.store_crm.where(F.col("priority_cohort_l1").isin(dims.TARGET_L1)).select("store_num", "priority_cohort_l2")


@check(
    """SELECT partner_id, company_name, 'one' AS scope FROM stg_partner WHERE company_name = 'MACHINERY'
       UNION ALL SELECT partner_id, company_name, 'all' FROM stg_partner"""
)
def for_key(s: Staged):
    rows = s.partner_throughput.select("partner_id", "company_name")
    one = filters.for_key(rows, "company_name", "MACHINERY").withColumn("scope", F.lit("one"))
    return one.union(filters.for_key(rows, "company_name").withColumn("scope", F.lit("all")))


@check(f"SELECT partner_id, shift_id, {day('shift_date')} AS shift_date FROM stg_assignment WHERE shift_date BETWEEN DATE '{FIRST}' AND DATE '{LAST}'")
def between_dates(s: Staged):
    return filters.between_dates(s.shift_assignments, "shift_date", FIRST, LAST).select("partner_id", "shift_id", "shift_date")


@check(f"SELECT shift_key, {moment('start_at')} AS start FROM stg_user_shift WHERE start_at >= TIMESTAMP '{FIRST}' AND start_at < TIMESTAMP '{LAST}'")
def in_window(s: Staged):
    ends = [datetime.combine(d, datetime.min.time()) for d in (FIRST, LAST)]
    return filters.in_window(s.user_shifts, "start", *ends).select("shift_key", "start")


@check(f"SELECT partner_id, company_name, {moment('last_active_at')} AS last_active_at FROM stg_partner WHERE last_active_at >= TIMESTAMP '2024-01-17 06:00:00'")
def active_since(s: Staged):
    return filters.active_since(s.partner_throughput, "last_active_at", P.as_of_ts, 14).select("partner_id", "company_name", "last_active_at")


@check(
    f"""SELECT company_name, zone_description, {day('snapshot_date')} AS date, shifts FROM stg_supply WHERE snapshot_date BETWEEN DATE '2024-01-24' AND DATE '2024-01-30'
        UNION ALL SELECT 'tier', partner_role_tier, {day('ds')}, lifetime_shifts FROM stg_reliability WHERE ds = DATE '2024-01-31'"""
)
def at_snapshot(s: Staged):
    week = filters.at_snapshot(s.supply_daily_position, "date", P.day(-7), P.day(-1)).select("company_name", "zone_description", "date", "shifts")
    today = filters.at_snapshot(s.partner_reliability, "ds", P.as_of_date)
    return week.union(today.select(F.lit("tier"), "partner_role_tier", "ds", "lifetime_shifts"))


@check(
    f"""SELECT zone_description, store_cluster, {day('snapshot_date')} AS date, shifts FROM stg_supply WHERE company_name = 'BUILDING'
        AND snapshot_date = (SELECT MAX(snapshot_date) FROM stg_supply WHERE company_name = 'BUILDING')"""
)
def latest_snapshot(s: Staged):
    rows = filters.latest_snapshot(s.supply_daily_position, "date", F.col("company_name") == "BUILDING", F.col("position") == "All")
    return rows.select("zone_description", "store_cluster", "date", "shifts")


@check("SELECT partner_id, shift_id, shift_type FROM stg_assignment WHERE shift_type <> 'orientation' OR shift_type IS NULL")
def ne_or_null(s: Staged):
    rows = s.shift_assignments.select("partner_id", "shift_id", F.col("shift.type").alias("shift_type"))
    return rows.where(filters.ne_or_null(F.col("shift_type"), "orientation"))


@check("SELECT shift_key, title FROM stg_user_shift WHERE LOWER(title) NOT LIKE '%orientation%' AND LOWER(title) NOT LIKE '%shadow%'")
def is_work_shift(s: Staged):
    return s.user_shifts.where(label.is_work_shift(F.col("title"))).select("shift_key", "title")


@check("SELECT partner_id, partner_role_tier LIKE '%M1%Active%' AS senior FROM stg_reliability")
def is_m1_active(s: Staged):
    return s.partner_reliability.select("partner_id", label.is_m1_active(F.col("partner_role_tier")).alias("senior"))


@check("SELECT external_id, lat, lng FROM stg_location WHERE lat IS NOT NULL AND lng IS NOT NULL AND city IS NULL")
def null_filter(s: Staged):
    return s.locations.where(F.col("lat").isNotNull() & F.col("lng").isNotNull() & F.col("city").isNull()).select("external_id", "lat", "lng")


@check(
    """SELECT event_id, COALESCE(updated_at >= TIMESTAMP '2024-01-10' AND (event LIKE '%adverse_action' OR (event = 'report.engaged' AND result = 'consider')), FALSE) AS decided,
         COALESCE(event LIKE '%adverse_action' OR (event = 'report.engaged' AND (result = 'consider' OR updated_at < TIMESTAMP '2024-01-10')), FALSE) AS decided_ever
       FROM stg_background_check"""
)
def adjudication_pred(s: Staged):
    args = [F.col("result"), F.col("event"), F.col("updated_at"), P.adjudication_from]
    no = F.lit(False)
    return s.background_checks.select(
        "event_id", F.coalesce(bgc.adjudication_pred(*args), no).alias("decided"), F.coalesce(bgc.adjudication_pred(*args, legacy=True), no).alias("decided_ever")
    )


@check(
    """WITH cases AS (
         SELECT 'dates' AS kind, shift_id FROM stg_assignment WHERE company_name = 'BUILDING' AND shift_date BETWEEN DATE '2023-11-02' AND DATE '2024-03-01'
         UNION ALL SELECT 'zone', shift_id FROM stg_assignment WHERE company_name = 'BUILDING'
           AND store_cluster IN (SELECT store_cluster FROM stg_supply WHERE zone_description = 'NATION_1' AND company_name = 'BUILDING')
         UNION ALL SELECT 'store', shift_id FROM stg_assignment WHERE store_number = '7'
         UNION ALL SELECT 'none', shift_id FROM stg_assignment)
       SELECT kind, shift_id, COUNT(*) AS n FROM cases GROUP BY 1, 2"""
)
def shift_filter(s: Staged):
    rows, supply = s.shift_assignments, s.supply_daily_position
    kinds = {
        "dates": dict(company="BUILDING", first=FIRST, last=LAST),
        "zone": dict(company="BUILDING", zone="NATION_1", supply=supply),
        "store": dict(store=" 7 "),
        "none": {},
    }
    parts = [shifts.shift_filter(rows, **kw).select(F.lit(kind).alias("kind"), "shift_id") for kind, kw in kinds.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.groupBy("kind", "shift_id").agg(F.count("*").alias("n"))


@check("SELECT partner_id, company_name, zone_description FROM stg_partner WHERE zone_description IN ('NATION_1', 'NATION_2', 'NATION_3') AND company_name = 'BUILDING'")
def filter_in(s: Staged):
    chosen = {"zone_description": ["NATION_1", "NATION_2", "NATION_3"], "company_name": ["BUILDING"], "city_description": []}
    return filters.filter_in(s.partner_throughput, chosen).select("partner_id", "company_name", "zone_description")


@check(
    f"""SELECT partner_id, first_name, last_name, city, zone_description, closest_store_proximity_miles AS closest_store_miles,
          {day('op_date')} AS op_date, bgc_result AS bgc_status, {moment('bgc_submitted_at')} AS bgc_submitted_at, adj_event AS bgc_adjudication_event,
          CAST(NULL AS VARCHAR) AS email, CAST(NULL AS VARCHAR) AS phone_number, ROUND(fill_rate_l7d, 3) AS fill_rate_l7d, priority_cohort_l2
        FROM o_roster WHERE cohort_l1 = 'OP, Not BGC Finalized'"""
)
def roster_view(s: Staged):
    return funnel.roster_view(funnel.funnel_roster(funnel.cohorted(s, P, EVENT_TIE), P), "OP, Not BGC Finalized")


# How the oracle's roster holds each detail column of the roster views.
_DETAIL_SQL = {
    "s1c_date": day("s1c_date"), "completed_shifts": "COALESCE(completed_shifts, 0)", "m1_tier": "partner_role_tier",
    "shifts_worked_last_7d": "shifts_worked_last_7d", "shifts_assigned_next_7d": "shifts_assigned_next_7d",
    "work_shifts_sent_next_7d": "COALESCE(sent, 0)", "work_shifts_seen_next_7d": "COALESCE(seen, 0)", "churn_status": "CAST(NULL AS VARCHAR)",
    "op_date": day("op_date"), "bgc_status": "bgc_result", "s1a_date": "CAST(NULL AS VARCHAR)", "bgc_submitted_at": moment("bgc_submitted_at"),
    "bgc_adjudication_event": "adj_event", "oa_date": day("oa_date"), "dl_date": day("created_date"), "last_active_at": moment("last_active_at"),
}


def _views_sql() -> str:
    groups = funnel.ROSTER_DETAIL
    detail = list(dict.fromkeys(c for columns in groups.values() for c in columns))
    shown = [
        f"CASE WHEN cohort_l1 IN ({', '.join(repr(g) for g, cols in groups.items() if c in cols)}) THEN {_DETAIL_SQL[c]} END AS {c}" for c in detail
    ]
    return f"""SELECT cohort_l1, partner_id, first_name, last_name, city, zone_description, closest_store_proximity_miles AS closest_store_miles,
          {', '.join(shown)}, CAST(NULL AS VARCHAR) AS email, CAST(NULL AS VARCHAR) AS phone_number, ROUND(fill_rate_l7d, 3) AS fill_rate_l7d,
          priority_cohort_l2 FROM o_roster WHERE cohort_l1 IN ({', '.join(repr(g) for g in groups)})"""


@check(_views_sql())
def roster_views(s: Staged):
    """The roster views of all seven groups, one row per partner of a group."""
    return funnel.roster_views(funnel.funnel_roster(funnel.cohorted(s, P, EVENT_TIE), P))


# --- joins -----------------------------------------------------------------------------------


@check(
    f"""SELECT z.zone_description, z.best[2] AS priority_cohort_l2, s.company_name, {day('s.snapshot_date')} AS date, s.shifts
        FROM o_zone z JOIN stg_supply s ON s.zone_description = z.zone_description"""
)
def zone_supply_join(s: Staged):
    supply = s.supply_daily_position.select("zone_description", "company_name", "date", "shifts")
    return supply.join(markets.zone_cohorts(s.store_crm).drop("priority_cohort_l1"), "zone_description")


@check("SELECT p.partner_id, p.company_name, m.city, m.priority_cohort_l2 FROM stg_partner p JOIN o_market m ON m.zone_description = p.zone_description")
def partner_market_join(s: Staged):
    target = markets.target_markets(s.supply_daily_position, s.store_crm, P)
    return s.partner_throughput.select("partner_id", "company_name", "zone_description").drop("priority_cohort_l2").join(
        target.select("zone_description", "city", "priority_cohort_l2"), "zone_description"
    ).drop("zone_description")


@check(
    """SELECT p.partner_id, p.company_name, b.event AS adj_event, r.partner_role_tier, c.completed_shifts, e.partner_id IS NOT NULL AS elsewhere
       FROM stg_partner p LEFT JOIN o_adj b ON b.partner_id = p.partner_id LEFT JOIN stg_reliability r ON r.partner_id = p.partner_id
       LEFT JOIN o_done c ON c.partner_id = p.partner_id LEFT JOIN o_else e ON e.partner_id = p.partner_id"""
)
def enrich(s: Staged):
    base = s.partner_throughput.select("partner_id", "company_name")
    found = joins.enrich(
        base,
        "partner_id",
        [
            checks.bgc_adjudication(s.background_checks, P.adjudication_from, tie=EVENT_TIE).withColumnRenamed("bgc_adjudication_event", "adj_event"),
            s.partner_reliability.select("partner_id", "partner_role_tier"),
            funnel.completed_shifts(s.shift_assignments, P),
            funnel.non_client_s1c(s.partner_throughput, P).withColumn("hit", F.lit(True)),
        ],
    )
    return found.select("partner_id", "company_name", "adj_event", "partner_role_tier", "completed_shifts", F.col("hit").isNotNull().alias("elsewhere"))


@check(
    """SELECT shift_key, partner_id FROM stg_user_shift WHERE partner_id IN
       (SELECT partner_id FROM stg_partner WHERE company_name = 'BUILDING' AND zone_description IN (SELECT zone_description FROM o_market))"""
)
def scope(s: Staged):
    target = markets.target_markets(s.supply_daily_position, s.store_crm, P)
    keys = joins.scope(s.partner_throughput.where("company_name = 'BUILDING'"), target, "zone_description")
    return joins.scope(s.user_shifts, keys, "partner_id").select("shift_key", "partner_id")


@check(
    """SELECT partner_id, shift_id, store_cluster FROM stg_assignment
       WHERE store_cluster IN (SELECT store_cluster FROM stg_supply WHERE zone_description = 'NATION_2')"""
)
def semi_in(s: Staged):
    rows = s.shift_assignments.select("partner_id", "shift_id", F.col("location.store_cluster").alias("store_cluster"))
    return joins.semi_in(rows, "store_cluster", s.supply_daily_position.where("zone_description = 'NATION_2'"), "store_cluster")


@check(
    """SELECT p.partner_id, p.company_name, EXISTS (SELECT 1 FROM stg_user_cert c WHERE c.partner_id = p.partner_id AND c.tag = 'tag_2') AS certified
       FROM stg_partner p"""
)
def flag_exists(s: Staged):
    rows = s.partner_throughput.select("partner_id", "company_name")
    return joins.flag_exists(rows, s.user_certs.where("tag = 'tag_2'"), "partner_id", "certified")


@check(
    """SELECT z.n_name AS zone_description, COUNT(a.shift_id) AS shifts FROM nation z
       LEFT JOIN stg_supply s ON s.zone_description = z.n_name AND s.company_name = 'BUILDING' AND s.snapshot_date = DATE '2024-01-30'
       LEFT JOIN stg_assignment a ON a.store_cluster = s.store_cluster AND a.shift_date = s.snapshot_date AND a.company_name = 'BUILDING' GROUP BY 1"""
)
def zero_fill(s: Staged):
    skeleton = s.raw("nation").select(F.col("n_name").alias("zone_description"))
    day_rows = s.supply_daily_position.where("company_name = 'BUILDING' AND date = DATE '2024-01-30'")
    return joins.zero_fill(skeleton, day_rows.groupBy("zone_description").agg(F.sum("shifts").alias("shifts")), "zone_description", ["shifts"])


@check(
    """SELECT b.partner_id, b.result, COALESCE(a.event, 'none') AS event FROM o_last b LEFT JOIN o_adj a ON a.partner_id = b.partner_id"""
)
def left_one(s: Staged):
    last = latest.latest_per_key(s.background_checks, ["partner_id"], "updated_at", EVENT_TIE).select("partner_id", "result")
    decided = checks.bgc_adjudication(s.background_checks, P.adjudication_from, tie=EVENT_TIE)
    return joins.left_one(last, decided.select("partner_id", F.col("bgc_adjudication_event").alias("event")), "partner_id", {"event": "none"})


_MILES = """ROUND(2 * 6371008.8 * ASIN(SQRT(LEAST(POW(SIN(RADIANS({b}.lat - {a}.lat) / 2), 2)
  + COS(RADIANS({a}.lat)) * COS(RADIANS({b}.lat)) * POW(SIN(RADIANS({b}.lng - {a}.lng) / 2), 2), 1.0))) / 1609.34, 1)"""
NEAR_SQL = f"""
WITH n_home AS (SELECT DISTINCT partner_id, partner_lat AS lat, partner_lng AS lng FROM stg_partner),
n_dist AS (
  SELECT h.partner_id, l.company_name, l.external_id AS store_number, l.city, l.state_code, {_MILES.format(a='h', b='l')} AS distance_miles
  FROM n_home h JOIN stg_location l ON l.is_active AND l.company_name IN ('BUILDING', 'FURNITURE', 'MACHINERY') AND l.lng IS NOT NULL),
n_rank AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY partner_id, company_name ORDER BY distance_miles, store_number) AS rank,
    COUNT(*) OVER (PARTITION BY partner_id, company_name) AS total_active_stores,
    COUNT(*) FILTER (distance_miles <= 25) OVER (PARTITION BY partner_id, company_name) AS stores_within_radius FROM n_dist),
n_near AS (SELECT * FROM n_rank WHERE rank <= 5)
"""


@check(
    f"""WITH n_dist AS (
          SELECT a.external_id, l.company_name, l.external_id AS store_number, {_MILES.format(a='a', b='l')} AS distance_miles
          FROM stg_location a JOIN stg_location l ON a.lng IS NOT NULL AND l.lng IS NOT NULL AND l.company_name IN ('BUILDING', 'FURNITURE', 'MACHINERY'))
        SELECT external_id, company_name, store_number, distance_miles, stores_within_radius FROM (
          SELECT *, ROW_NUMBER() OVER (PARTITION BY external_id, company_name ORDER BY distance_miles, store_number) AS rank,
            COUNT(*) FILTER (distance_miles <= 40) OVER (PARTITION BY external_id, company_name) AS stores_within_radius FROM n_dist) WHERE rank <= 3"""
)
def nearest_k(s: Staged):
    places = s.locations.select("external_id", "lat", "lng")
    shops = s.locations.select("company_name", F.col("external_id").alias("store_number"), "lat", "lng")
    return nearest(places, shops, COMPANIES, k=3, radius=40.0).select("external_id", "company_name", "store_number", "distance_miles", "stores_within_radius")


@check(
    """SELECT l.company_name, l.external_id AS store_number, COALESCE(o.l7d_shifts, 0) AS l7d_shifts FROM stg_location l LEFT JOIN
       (SELECT company_name, store_number, COUNT(*) FILTER (shift_date <= DATE '2024-01-31') AS l7d_shifts FROM stg_assignment
        WHERE shift_date BETWEEN DATE '2024-01-24' AND DATE '2024-03-01' GROUP BY 1, 2) o ON o.company_name = l.company_name AND o.store_number = l.external_id"""
)
def outlook_join(s: Staged):
    outlook = stores.store_outlook(s.shift_assignments, COMPANIES, P.as_of_date).drop("next_shift_date")
    shops = s.locations.select("company_name", F.col("external_id").alias("store_number"))
    return joins.left_one(shops, outlook, ["company_name", "store_number"], {"l7d_shifts": 0})


@check(
    """SELECT s.company_name, s.zone_description, COALESCE(array_to_string(LIST(DISTINCT l.city ORDER BY l.city) FILTER (l.city IS NOT NULL), ','), '') AS cities
       FROM (SELECT DISTINCT company_name, zone_description, store_cluster FROM stg_supply) s
       LEFT JOIN stg_location l ON l.hex = s.store_cluster AND l.company_name = s.company_name GROUP BY 1, 2"""
)
def cluster_city_join(s: Staged):
    """Store cities of every zone of every company, through the zone's clusters."""
    clusters = s.supply_daily_position.select("company_name", "zone_description", "store_cluster").distinct()
    shops = s.locations.select("company_name", F.col("hex").alias("store_cluster"), "city").distinct()
    pairs = clusters.join(shops, ["company_name", "store_cluster"], "left").select("company_name", "zone_description", "city").distinct()
    return pairs.groupBy("company_name", "zone_description").agg(F.array_join(F.sort_array(F.collect_set("city")), ",").alias("cities"))


# --- aggregations ----------------------------------------------------------------------------


@check(
    """SELECT partner_id, COUNT(*) FILTER (sent_at IS NOT NULL) AS sent, COUNT(*) FILTER (assigned_at IS NOT NULL AND title = 'Work Shift') AS accepted,
         COUNT(*) FILTER (seen_at >= TIMESTAMP '2024-01-31') AS seen_later FROM stg_user_shift GROUP BY 1"""
)
def cond_counts(s: Staged):
    work = label.is_work_shift(F.col("title"))
    return counts.cond_counts(
        s.user_shifts,
        ["partner_id"],
        {
            "sent": F.col("sent_at").isNotNull(),
            "accepted": F.col("assigned_at").isNotNull() & work,
            "seen_later": F.col("seen_at") >= filters.ntz(P.midnight(0)),
        },
    )


@check("SELECT partner_id, COUNT(*) FILTER (is_completed) AS completed, COUNT(*) FILTER (is_noshow) AS noshows FROM stg_assignment GROUP BY 1")
def outcome_counts(s: Staged):
    preds = {"completed": F.col("assignment.is_completed"), "noshows": F.col("assignment.is_noshow")}
    return counts.cond_counts(s.shift_assignments, ["partner_id"], preds)


@check(
    """SELECT cohort, COUNT(*) AS total, COUNT(*) FILTER (priority_cohort_l2 LIKE 'C1:%') AS c1_subscale, COUNT(*) FILTER (priority_cohort_l2 LIKE 'C2a%') AS c2a_fr_below_80,
         COUNT(*) FILTER (priority_cohort_l2 LIKE 'C2b%') AS c2b_storesmart, COUNT(*) FILTER (priority_cohort_l2 LIKE 'C2c%') AS c2c_t25_fr_80_90
       FROM o_coded GROUP BY 1"""
)
def cohort_counts(s: Staged):
    return funnel.cohort_counts(funnel.cohorted(s, P, EVENT_TIE))


@check(
    """SELECT zone_description, MAX(hex_city_description) AS city, CAST(SUM(filled) AS DOUBLE) / SUM(shifts) AS fill_rate_l7d,
         CAST(SUM(shifts) AS BIGINT) AS total_shifts_l7d, CAST(SUM(filled) AS BIGINT) AS filled_shifts_l7d FROM stg_supply GROUP BY 1"""
)
def market_fill_rate(s: Staged):
    return markets.market_fill_rate(s.supply_daily_position)


@check("SELECT zone_description, best[2] AS priority_cohort_l2, best[3] AS priority_cohort_l1 FROM o_zone")
def pick_by_priority(s: Staged):
    return markets.zone_cohorts(s.store_crm)


@check(
    f"""SELECT company_name, store_number, COUNT(*) FILTER (shift_date <= DATE '2024-01-31') AS l7d_shifts,
          {day("MIN(shift_date) FILTER (shift_date >= DATE '2024-01-31')")} AS next_shift_date FROM stg_assignment
        WHERE shift_date BETWEEN DATE '2024-01-24' AND DATE '2024-03-01' AND company_name IN ('BUILDING', 'FURNITURE', 'MACHINERY') GROUP BY 1, 2"""
)
def store_outlook(s: Staged):
    return stores.store_outlook(s.shift_assignments, COMPANIES, P.as_of_date)


@check("SELECT DISTINCT partner_id, tag FROM stg_user_cert")
def distinct_projection(s: Staged):
    return s.user_certs.select("partner_id", "tag").distinct()


@check("SELECT zone_description, hex_city_description FROM stg_supply GROUP BY 1, 2")
def group_dedup(s: Staged):
    return s.supply_daily_position.select("zone_description", "hex_city_description").distinct()


@check(ZONE_LIST_SQL + "SELECT company_name, zone_description, hex_city_description, max_shifts FROM z_last")
def zone_peaks(s: Staged):
    return zones.zone_peaks(s.supply_daily_position, None)


_TOTALS = """COUNT(*) AS total_shifts, COUNT(*) FILTER (is_completed) AS completed, COUNT(*) FILTER (is_noshow) AS noshows,
  COUNT(*) FILTER (is_canceled) AS canceled, CAST(COALESCE(SUM(total_amount), 0) AS DOUBLE) AS total_pay"""
ZONE_SQL = f"""SELECT store_cluster AS zone_hex, {_TOTALS}, ROUND_EVEN(CAST(SUM(rate) AS DOUBLE) / COUNT(rate), 2) AS avg_rate,
  COUNT(DISTINCT partner_id) AS unique_partners, COUNT(DISTINCT store_number) AS store_count,
  ROUND_EVEN(COUNT(*) FILTER (is_completed) / COUNT(*) * 100, 1) AS fill_rate FROM stg_assignment WHERE store_cluster IS NOT NULL"""
STORE_SQL = f"""SELECT store_cluster AS zone_hex, store_number, store_name, {_TOTALS.replace("COUNT(*) FILTER (is_canceled) AS canceled,", "")},
  COUNT(DISTINCT partner_id) AS unique_partners, ROUND_EVEN(COUNT(*) FILTER (is_completed) / COUNT(*) * 100, 1) AS fill_rate
  FROM stg_assignment WHERE store_cluster IS NOT NULL"""
KPI_SQL = f"""SELECT {_TOTALS}, COUNT(DISTINCT partner_id) AS unique_partners, COUNT(DISTINCT store_number) AS store_count,
  COUNT(*) FILTER (is_completed) / COUNT(*) * 100 AS fill_rate FROM stg_assignment"""


@check(ZONE_SQL + " GROUP BY 1")
def zone_aggregates(s: Staged):
    return zones.zone_summary(zones.zone_rows(s.shift_assignments))


@check(STORE_SQL + " GROUP BY 1, 2, 3")
def store_aggregates(s: Staged):
    return zones.store_summary(zones.zone_rows(s.shift_assignments))


@check(KPI_SQL)
def shift_kpis(s: Staged):
    return counts.shift_kpis(zones.zone_rows(s.shift_assignments))


@check(
    """SELECT partner_id, COUNT(*) AS assignments, CAST(SUM(total_amount) AS DOUBLE) AS total_pay,
         ROUND_EVEN(CAST(SUM(rate) AS DOUBLE) / COUNT(rate), 2) AS avg_rate FROM stg_assignment GROUP BY 1"""
)
def assignment_kpis(s: Staged):
    flat = s.shift_assignments.select("partner_id", "payment.total_amount", F.col("payment.rate").alias("payment_rate"))
    return counts.assignment_kpis(flat)


_SENT = """COUNT(*) AS total, COUNT(*) FILTER (status IN ('Assigned', 'Accepted', 'Completed') {more}) AS accepted,
  COUNT(seen_at) AS seen, COUNT(completed_at) AS completed, COUNT(*) FILTER (status IN ('Canceled', 'Declined')) AS dropped"""


@check(
    f"""SELECT partner_id, {_SENT.format(more='OR assigned_at IS NOT NULL')}, 'both' AS rule FROM stg_user_shift GROUP BY 1
        UNION ALL SELECT partner_id, {_SENT.format(more='')}, 'status' FROM stg_user_shift GROUP BY 1"""
)
def sent_kpis(s: Staged):
    wide = counts.sent_kpis(s.user_shifts).withColumn("rule", F.lit("both"))
    return wide.union(counts.sent_kpis(s.user_shifts, include_assigned_at=False).withColumn("rule", F.lit("status")))


BONUS_SQL = """
WITH b_info AS (
  SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY bonus_id ORDER BY updated_at DESC, event_id DESC) AS rn FROM stg_bonus_progress) WHERE rn = 1),
b_all AS (
  SELECT e.partner_id, e.bonus_id, i.title AS bonus_name, i.amount, i.shifts_required, COALESCE(p.count_progress, 0) AS shifts_completed,
    COALESCE(p.is_complete, FALSE) AS is_complete, p.is_viewed AS viewed_by_partner,
    COALESCE(p.count_progress, 0) || '/' || COALESCE(CAST(i.shifts_required AS VARCHAR), '?') AS progress,
    CASE WHEN p.is_viewed THEN 'Yes' ELSE 'No' END AS opted_in, CASE WHEN p.is_complete THEN 'Complete' ELSE 'In Progress' END AS status,
    CASE WHEN p.is_complete OR p.is_viewed THEN 'in' ELSE 'not_in' END AS row_class,
    CASE WHEN i.companies IS NULL THEN 'N/A' ELSE array_to_string(list_transform(i.companies, lambda c: CASE c WHEN 'unit_0' THEN 'Unit Zero'
      WHEN 'unit_1' THEN 'Unit One' ELSE c[1:8] || '...' END), ', ') END AS companies
  FROM stg_bonus_eligible e JOIN b_info i ON i.bonus_id = e.bonus_id
  LEFT JOIN stg_bonus_progress p ON p.bonus_id = e.bonus_id AND p.partner_id = e.partner_id)
"""


def _bonuses(s: Staged):
    return bonuses.partner_bonuses(s.bonus_eligible_users, s.bonus_progress, NAMES, EVENT_TIE)


@check(
    BONUS_SQL
    + """SELECT partner_id, COUNT(*) AS total_bonuses, COUNT(*) FILTER (opted_in = 'Yes') AS opted_in, COUNT(*) FILTER (opted_in = 'No') AS not_opted_in,
           COUNT(*) FILTER (status = 'Complete') AS completed FROM b_all GROUP BY 1"""
)
def bonus_kpis(s: Staged):
    return counts.bonus_kpis(_bonuses(s))


@check(
    """SELECT CASE WHEN GROUPING(l1_group) = 0 THEN l1_group END AS l1_group, CASE WHEN GROUPING(cohort) = 0 THEN cohort END AS cohort,
         COUNT(*) AS partners, CAST(GROUPING(l1_group, cohort) AS BIGINT) AS level
       FROM (SELECT cohort, cohort_l1 AS l1_group FROM o_roster) GROUP BY ROLLUP (l1_group, cohort)"""
)
def funnel_rollup(s: Staged):
    return rollup.funnel_rollup(funnel.cohorted(s, P, EVENT_TIE))


@check(
    """SELECT assignment_status, COUNT(*) AS n, ROUND_EVEN(COUNT(*) / (SELECT COUNT(*) FROM stg_assignment) * 100, 1) AS pct FROM stg_assignment GROUP BY 1"""
)
def pct_of_total(s: Staged):
    return rollup.pct_of_total(s.shift_assignments.groupBy("assignment_status").agg(F.count("*").alias("n")), "n")


@check(
    f"""SELECT partner_id, {day('shift_date')} AS shift_date, CAST(SUM(n) AS BIGINT) AS shifts,
          array_to_string(LIST(company_name || '/' || COALESCE(shift_type, '-') || '/' || assignment_status || '/' || store_number || 'x' || n
            ORDER BY company_name, shift_type NULLS FIRST, assignment_status, store_number), ';') AS entries
        FROM (SELECT partner_id, shift_date, company_name, shift_type, assignment_status, store_number, COUNT(*) AS n FROM stg_assignment GROUP BY ALL) GROUP BY 1, 2"""
)
def day_lists(s: Staged):
    flat = s.shift_assignments.select(
        "partner_id", "shift_date", "company_name", F.col("shift.type").alias("shift_type"), "assignment_status", F.col("location.external_id").alias("store_number")
    )
    lists = calendars.day_lists(flat, ["partner_id", "shift_date"], ["company_name", "shift_type", "assignment_status", "store_number"])

    def text(e):
        return F.concat(
            e.company_name, F.lit("/"), F.coalesce(e.shift_type, F.lit("-")), F.lit("/"), e.assignment_status, F.lit("/"), e.store_number, F.lit("x"), e.n.cast("string")
        )

    return lists.withColumn("entries", F.array_join(F.transform("entries", text), ";"))


@check(
    ZONE_LIST_SQL + "SELECT company_name, zone_description, array_to_string(LIST(city ORDER BY city), ',') AS store_cities FROM z_city GROUP BY 1, 2"
)
def zone_cities(s: Staged):
    cities = zones.zone_cities(s.supply_daily_position, s.locations, None, P.day(-7))
    return cities.withColumn("store_cities", F.array_join("store_cities", ","))


@check("SELECT DISTINCT city FROM stg_location WHERE city IS NOT NULL ORDER BY 1")
def options(s: Staged):
    return counts.options(s.locations, "city")


# --- windows ---------------------------------------------------------------------------------


@check("SELECT partner_id, event_id, result FROM o_last")
def latest_per_key(s: Staged):
    return latest.latest_per_key(s.background_checks, ["partner_id"], "updated_at", EVENT_TIE).select("partner_id", "event_id", "result")


@check("SELECT partner_id, event_id, result FROM o_last")
def latest_merged(s: Staged):
    """The latest check per partner kept up day by day: the state of the day before the last, merged with the last day."""
    rows = s.background_checks
    cut = F.lit(P.day(-1)).cast("timestamp_ntz")
    before = latest.latest_per_key(rows.where(F.col("updated_at") < cut), ["partner_id"], "updated_at", EVENT_TIE)
    day = rows.where(~(F.col("updated_at") < cut) | F.col("updated_at").isNull())
    merged = latest.merge_latest(before, day, ["partner_id"], "updated_at", EVENT_TIE)
    return merged.select("partner_id", "event_id", "result")


@check("SELECT partner_id, event_id, event FROM o_adj")
def latest_after_filter(s: Staged):
    rows = s.background_checks
    rows = rows.where(bgc.adjudication_pred(F.col("result"), F.col("event"), F.col("updated_at"), P.adjudication_from))
    return latest.latest_per_key(rows, ["partner_id"], "updated_at", EVENT_TIE).select("partner_id", "event_id", "event")


@check(BONUS_SQL + "SELECT bonus_id, title, amount, shifts_required FROM b_info")
def dedup_latest(s: Staged):
    return latest.dedup_latest(s.bonus_progress, ["bonus_id"], "updated_at", ["title", "amount", "shifts_required"], EVENT_TIE)


@check(
    """SELECT company_name, external_id, lat, position FROM (
         SELECT *, ROW_NUMBER() OVER (PARTITION BY company_name ORDER BY lat DESC, external_id) AS position FROM stg_location) WHERE position <= 5"""
)
def top_k_per_group(s: Staged):
    best = latest.top_k_per_group(s.locations, ["company_name"], [F.col("lat").desc(), "external_id"], 5, rank="position")
    return best.select("company_name", "external_id", "lat", "position")


@check(
    """SELECT partner_id, shift_id, COUNT(*) OVER (PARTITION BY store_cluster) AS zone_shifts, COUNT(*) FILTER (is_completed) OVER (PARTITION BY store_cluster) AS zone_done
       FROM stg_assignment"""
)
def partition_counts(s: Staged):
    rows = s.shift_assignments.select("partner_id", "shift_id", F.col("location.store_cluster").alias("zone"), "assignment.is_completed")
    counted = latest.partition_counts(rows, ["zone"], {"zone_shifts": None, "zone_done": F.col("is_completed")})
    return counted.drop("zone", "is_completed")


# --- sorts and limits ------------------------------------------------------------------------


@check("SELECT company_name, city, external_id, state_code FROM stg_location ORDER BY company_name, city NULLS FIRST, external_id DESC")
def multi_key_sort(s: Staged):
    return s.locations.select("company_name", "city", "external_id", "state_code").orderBy("company_name", "city", F.col("external_id").desc())


MARKET_SQL = f"""
WITH m_all AS (
  SELECT company_name, {day('shift_date')} AS shift_date, shift_id, shift_title, shift_type, {moment('start_at')} AS shift_time,
    {moment("start_at + INTERVAL 4 HOUR")} AS shift_end, store_number, store_cluster AS zone, store_name, partner_id,
    TRIM(COALESCE(first_name, '') || ' ' || COALESCE(last_name, '')) AS partner_name, assignment_status,
    CASE WHEN is_completed THEN 'Completed' WHEN is_noshow THEN 'No Show' WHEN is_canceled THEN 'Canceled' ELSE 'Assigned' END AS completion_status,
    CAST(rate AS DOUBLE) AS rate, CAST(base_amount AS DOUBLE) AS base_pay, CAST(COALESCE(shift_bonus_amount, 0) AS DOUBLE) AS bonus,
    CAST(total_amount AS DOUBLE) AS total_pay, approval_status AS payment_approval, payment_status
  FROM stg_assignment)
"""


@check(MARKET_SQL + "SELECT * FROM m_all ORDER BY shift_date, shift_time, shift_id, store_number, partner_id, total_pay LIMIT 2000")
def top_n(s: Staged):
    first = ordering.top_n(s.shift_assignments, [*shifts.ORDER, "payment.total_amount"], 2000)
    return shifts.market_shifts(first)


@check(MARKET_SQL + "SELECT shift_id, store_number, partner_id, total_pay FROM m_all ORDER BY shift_id, store_number, partner_id, total_pay LIMIT 1")
def first_record(s: Staged):
    keys = ["shift_id", "store_number", "partner_id", "total_pay"]
    return ordering.top_n(shifts.market_shifts(s.shift_assignments).select(*keys), keys, 1)


@check(
    f"""SELECT partner_id, event_id, {day('ds')} AS ds FROM (
          SELECT *, ROW_NUMBER() OVER (PARTITION BY partner_id ORDER BY ds DESC, event_id DESC) AS rn FROM stg_deactivation) WHERE rn = 1"""
)
def current_record(s: Staged):
    return latest.latest_per_key(s.partner_deactivations, ["partner_id"], "ds", EVENT_TIE).select("partner_id", "event_id", "ds")


@check("SELECT store_number, COUNT(*) AS n FROM stg_assignment GROUP BY 1 ORDER BY n DESC, store_number")
def sort_by_measure(s: Staged):
    per_store = s.shift_assignments.groupBy(F.col("location.external_id").alias("store_number")).agg(F.count("*").alias("n"))
    return per_store.orderBy(F.col("n").desc(), "store_number")


@check(
    f"""SELECT shift_key, {moment('start_at')} AS start, CASE WHEN start_at < TIMESTAMP '2024-01-31 06:00:00' THEN 'past' ELSE 'future' END AS bucket FROM stg_user_shift"""
)
def split_past_future(s: Staged):
    past, future = ordering.split_past_future(s.user_shifts, "start", P.as_of_ts, ["shift_key"])
    return past.union(future).select("shift_key", "start", "bucket")


# --- set operations --------------------------------------------------------------------------


@check("SELECT DISTINCT hex_city_description AS city_name FROM stg_supply WHERE shifts > 0")
def distinct_rows(s: Staged):
    return s.supply_daily_position.where("shifts > 0").select(F.col("hex_city_description").alias("city_name")).distinct()


@check(
    f"""SELECT s.company_name, s.zone_description, s.hex_city_description,
          COALESCE(array_to_string(list_sort(list_filter(LIST(DISTINCT l.city) FILTER (l.city IS NOT NULL), lambda c: LOWER(c) <> LOWER(s.base))), ','), '') AS others
        FROM (SELECT DISTINCT z.company_name, z.zone_description, z.hex_city_description, z.store_cluster, {BASE} AS base FROM stg_supply z) s
        LEFT JOIN stg_location l ON l.hex = s.store_cluster AND l.company_name = s.company_name
        GROUP BY s.company_name, s.zone_description, s.hex_city_description, s.base"""
)
def set_minus_in_row(s: Staged):
    """The store cities of each zone other than the zone's own city (of its hex city), whatever their case."""
    zones = s.supply_daily_position.select("company_name", "zone_description", "hex_city_description", "store_cluster").distinct()
    shops = s.locations.select("company_name", F.col("hex").alias("store_cluster"), "city")
    keys = ["company_name", "zone_description", "hex_city_description"]
    cities = zones.join(shops, ["company_name", "store_cluster"], "left").groupBy(*keys).agg(F.sort_array(F.collect_set("city")).alias("cities"))
    base = zone_base_city(F.col("hex_city_description"))
    return cities.select(*keys, F.array_join(other_cities(F.col("cities"), base), ",").alias("others"))
