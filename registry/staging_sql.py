"""The same staging as views for the oracle (flat), and the funnel steps that several oracles share."""

STAGING = """
stg_events AS (SELECT *, event_id % (SELECT COUNT(*) FROM customer) AS k FROM events),
stg_partner AS (
  SELECT CAST(c.c_custkey AS VARCHAR) AS partner_id, c.c_name AS first_name, c.c_mktsegment AS last_name, x.company_name,
    n.n_name AS zone_description, r.r_name || '_' || n.n_name AS city_description,
    CASE WHEN c.c_custkey % 4 = 1 THEN a.seen_ts - INTERVAL 8 DAY
         WHEN c.c_custkey % 20 = 3 THEN a.seen_ts - INTERVAL 20 DAY ELSE a.seen_ts END AS last_active_at,
    DATE '2023-06-02' AS created_date,
    CASE WHEN c.c_custkey % 10 < 8 THEN DATE '2023-07-01' END AS oa_date,
    CASE WHEN c.c_custkey % 10 < 7 THEN DATE '2023-08-01' END AS op_date,
    CASE WHEN c.c_custkey % 10 < 4 OR (c.c_custkey % 10 = 8 AND x.company_name <> 'BUILDING') THEN DATE '2023-09-01' END AS s1c_date,
    CASE WHEN c.c_custkey % 97 = 5 THEN NULL ELSE (c.c_custkey % 7) * (c.c_custkey % 3) END AS shifts_assigned_next_7d,
    c.c_custkey % 8 AS shifts_worked_last_7d, c.c_custkey % 13 AS total_shifts_last_4w, c.c_custkey % 5 AS weeks_worked_last_4w,
    c.c_custkey % 53 = 11 AS currently_suspended, c.c_custkey % 47 = 13 AS currently_deactivated, c.c_custkey % 61 = 17 AS is_fraud_partner,
    (c.c_custkey * 29 % 500) / 10.0::DOUBLE AS closest_store_proximity_miles,
    CAST(c.c_custkey % 1000 AS DOUBLE) / 999 AS churn_probability,
    30 + CAST(c.c_custkey * 37 % 1000 AS DOUBLE) / 1000 AS partner_lat,
    -120 + CAST(c.c_custkey * 91 % 3000 AS DOUBLE) / 1000 AS partner_lng
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
  JOIN (SELECT c_custkey AS k, c_mktsegment AS company_name FROM customer UNION ALL
        SELECT c_custkey, 'BUILDING' FROM customer WHERE c_custkey % 2 = 0 AND c_mktsegment <> 'BUILDING') x ON x.k = c.c_custkey
  LEFT JOIN (SELECT k, MAX(ts) AS seen_ts FROM stg_events GROUP BY k) a ON a.k = c.c_custkey),
stg_background_check AS (
  SELECT CAST(k AS VARCHAR) AS partner_id, ts AS updated_at, ts - INTERVAL 3 DAY AS created_at, event_id,
    CASE event_type WHEN 'purchase' THEN 'clear' WHEN 'view' THEN 'consider' WHEN 'click' THEN 'pending' WHEN 'error' THEN 'suspended' END AS result,
    CASE WHEN event_id % 2 = 0 THEN 'report_clear' WHEN event_id % 3 = 0 THEN 'report_consider' ELSE 'invitation_pending' END AS status,
    CASE WHEN event_id % 29 = 3 THEN 'report.pre_adverse_action' WHEN event_id % 31 = 3 THEN 'report.post_adverse_action'
         WHEN event_id % 5 = 1 THEN 'report.engaged' END AS event
  FROM stg_events WHERE event_id % 3 <> 0),
stg_user_shift AS (
  SELECT CAST(o_custkey AS VARCHAR) AS partner_id, o_orderkey AS shift_key, o_orderpriority AS company,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Orientation' WHEN '2-HIGH' THEN 'Shadow Shift' ELSE 'Work Shift' END AS title,
    CASE WHEN o_orderkey % 6 = 0 THEN 'Canceled' WHEN o_orderkey % 6 = 1 THEN 'Declined' WHEN o_orderkey % 6 = 2 THEN 'Completed'
         WHEN o_orderkey % 6 = 3 THEN 'Assigned' ELSE 'Sent' END AS status,
    o_orderdate + INTERVAL 9496 DAY AS start_at,
    CASE WHEN o_orderkey % 10 <> 0 THEN o_orderdate + INTERVAL 9491 DAY END AS sent_at,
    CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + INTERVAL 9492 DAY END AS seen_at,
    CASE WHEN o_orderkey % 6 IN (2, 3) THEN o_orderdate + INTERVAL 9493 DAY END AS assigned_at,
    CASE WHEN o_orderkey % 6 = 2 THEN o_orderdate + INTERVAL 9496 DAY END AS completed_at
  FROM orders),
stg_assignment AS (
  SELECT CAST(o.o_custkey AS VARCHAR) AS partner_id, c.c_mktsegment AS company_name,
    CAST(l.l_orderkey * 8 + l.l_linenumber AS VARCHAR) AS shift_id, 'Shift ' || l.l_linenumber AS shift_title,
    CAST(l.l_shipdate + INTERVAL 9496 DAY AS DATE) AS shift_date,
    l.l_shipdate + INTERVAL 9496 DAY + l.l_linenumber * INTERVAL 1 HOUR AS start_at, l.l_linenumber = 7 AS is_remote,
    CASE WHEN l.l_partkey % 9 = 0 THEN NULL WHEN l.l_partkey % 9 = 1 THEN 'orientation' ELSE 'work' END AS shift_type,
    l.l_returnflag = 'R' AS is_completed, l.l_returnflag = 'A' AND l.l_linestatus = 'F' AS is_noshow,
    l.l_returnflag = 'A' AND l.l_linestatus = 'O' AS is_canceled,
    CASE WHEN l.l_returnflag = 'R' THEN 'Completed' WHEN l.l_returnflag = 'A' AND l.l_linestatus = 'F' THEN 'NoShow'
         WHEN l.l_returnflag = 'A' THEN 'Canceled' ELSE 'Assigned' END AS assignment_status,
    CAST(s.s_suppkey AS VARCHAR) AS store_number, s.s_name AS store_name,
    CASE WHEN s.s_suppkey % 20 = 7 THEN NULL ELSE 'hex_' || s.s_nationkey END AS store_cluster,
    CASE WHEN c.c_custkey % 6 <> 0 THEN c.c_name END AS first_name, CASE WHEN c.c_custkey % 5 <> 0 THEN c.c_mktsegment END AS last_name,
    CAST(l.l_quantity AS DECIMAL(12,2)) AS rate, CAST(l.l_extendedprice AS DECIMAL(12,2)) AS base_amount,
    CASE WHEN l.l_discount > 0.02 THEN CAST(l.l_discount * 100 AS DECIMAL(12,2)) END AS shift_bonus_amount,
    CAST(l.l_extendedprice AS DECIMAL(12,2)) AS total_amount,
    CASE WHEN l.l_linestatus = 'O' THEN 'Pending' ELSE 'Approved' END AS approval_status,
    CASE WHEN l.l_returnflag = 'R' THEN 'Paid' END AS payment_status
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey),
stg_supply AS (
  SELECT a.company_name, 'All' AS position_name, a.shift_date AS snapshot_date, n.n_name AS zone_description,
    r.r_name || '_' || n.n_name AS hex_city_description, a.store_cluster, COUNT(*) AS shifts, COUNT(*) FILTER (a.is_completed) AS filled
  FROM stg_assignment a JOIN nation n ON a.store_cluster = 'hex_' || n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
  GROUP BY 1, 2, 3, 4, 5, 6),
stg_store_crm AS (
  SELECT CAST(s.s_suppkey AS VARCHAR) AS store_num, n.n_name AS zone_desc,
    CASE WHEN s.s_suppkey % 6 < 2 THEN 'C1: Root Cause Diagnosis' WHEN s.s_suppkey % 6 < 5 THEN 'C2: Unblock Partner Funnel' ELSE 'C9: Other' END AS priority_cohort_l1,
    CASE s.s_suppkey % 6 WHEN 0 THEN 'C1: Subscale Deep Dives' WHEN 1 THEN 'C2a: FR<80 (Any)' WHEN 2 THEN 'C2b: StoreSmart Alpha'
         WHEN 3 THEN 'C2c: T25, FR 80-90%' ELSE 'C9: Other' END AS priority_cohort_l2
  FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey),
stg_location AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS external_id,
    CASE s_suppkey % 3 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'FURNITURE' ELSE 'MACHINERY' END AS company_name, 'hex_' || s_nationkey AS hex,
    CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE 'City ' || s_suppkey % 17 END AS city,
    CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE 'S' || s_suppkey % 5 END AS state_code, s_suppkey % 10 <> 9 AS is_active,
    30 + CAST(s_suppkey * 53 % 1000 AS DOUBLE) / 1000 AS lat,
    CASE WHEN s_suppkey % 25 = 24 THEN NULL ELSE -120 + CAST(s_suppkey * 71 % 3000 AS DOUBLE) / 1000 END AS lng
  FROM supplier),
stg_reliability AS (
  SELECT CAST(c_custkey AS VARCHAR) AS partner_id, DATE '2024-01-31' AS ds, c_custkey % 11 AS lifetime_shifts,
    CASE c_custkey % 4 WHEN 0 THEN 'M1 - Active' WHEN 1 THEN 'M1 - Lapsed' WHEN 2 THEN 'Standard' END AS partner_role_tier FROM customer),
stg_bonus_eligible AS (
  SELECT DISTINCT CAST(event_id % 40 AS VARCHAR) AS bonus_id, CAST(k AS VARCHAR) AS partner_id FROM stg_events WHERE event_type IN ('signup', 'purchase')),
stg_bonus_progress AS (
  SELECT event_id, CAST(event_id % 40 AS VARCHAR) AS bonus_id, CAST(k AS VARCHAR) AS partner_id, ts AS updated_at,
    'Bonus ' || event_id % 40 AS title, event_id % 7 AS count_progress, CAST(CASE WHEN event_id % 9 <> 0 THEN 5 END AS BIGINT) AS shifts_required,
    value AS amount, event_id % 7 >= 5 AS is_complete, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 3 = 1 END AS is_viewed,
    CASE WHEN event_id % 5 <> 0 THEN ['unit_' || event_id % 3, 'department_' || event_id % 4] END AS companies
  FROM stg_events WHERE event_type IN ('signup', 'purchase')),
stg_deactivation AS (
  SELECT event_id, CAST(k AS VARCHAR) AS partner_id, CAST(ts AS DATE) AS ds, event_id % 9 = 0 AS is_banned, event_id % 4 <> 0 AS is_deactivated,
    CASE WHEN event_id % 2 = 0 THEN 'company' END AS deactivation_level,
    CASE event_id % 3 WHEN 1 THEN 'unit_' || event_id % 4 WHEN 2 THEN 'department_of_long_names_' || event_id % 7 END AS deactivation_company,
    CASE WHEN event_id % 5 = 0 THEN CAST(ts + INTERVAL 3 DAY AS DATE) END AS reactivation_date
  FROM stg_events WHERE event_type = 'error' AND event_id % 4 <= 1),
stg_user_cert AS (
  SELECT CAST(k AS VARCHAR) AS partner_id, 'tag_' || event_id % 6 AS tag, 'Cert ' || event_id % 7 AS title, MAX(ts) AS updated_at
  FROM stg_events WHERE event_type = 'click' GROUP BY 1, 2, 3),
stg_assessment AS (
  SELECT CAST(c_custkey AS VARCHAR) AS partner_id, c_mktsegment AS reporting_company,
    CASE c_custkey % 3 WHEN 0 THEN 'passed' WHEN 1 THEN 'failed' END AS assessment_status,
    TIMESTAMP '2023-01-01 00:00:00' + c_custkey * INTERVAL 1 HOUR AS account_created FROM customer),
stg_bgc_override AS (SELECT CAST(c_custkey AS VARCHAR) AS partner_id FROM customer WHERE c_custkey % 71 = 1)
"""

# Steps of the funnel oracle. The facts are turned into yes / no marks first; the code is then
# looked up by the first mark set that holds.
FUNNEL = """
o_zone AS (
  SELECT zone_desc AS zone_description, MIN((pri, priority_cohort_l2, priority_cohort_l1)) AS best
  FROM (SELECT *, CASE WHEN priority_cohort_l2 LIKE 'C1:%' THEN 1 WHEN priority_cohort_l2 LIKE 'C2a%' THEN 2
                       WHEN priority_cohort_l2 LIKE 'C2b%' THEN 3 WHEN priority_cohort_l2 LIKE 'C2c%' THEN 4 ELSE 99 END AS pri
        FROM stg_store_crm WHERE priority_cohort_l1 <> 'C9: Other') GROUP BY 1),
o_market AS (
  SELECT z.zone_description, z.best[2] AS priority_cohort_l2, z.best[3] AS priority_cohort_l1, MAX(s.hex_city_description) AS city,
    CAST(SUM(s.filled) AS DOUBLE) / SUM(s.shifts) AS fill_rate_l7d, CAST(SUM(s.shifts) AS BIGINT) AS total_shifts_l7d,
    CAST(SUM(s.filled) AS BIGINT) AS filled_shifts_l7d
  FROM o_zone z JOIN stg_supply s ON s.zone_description = z.zone_description
  WHERE s.company_name = 'BUILDING' AND s.snapshot_date BETWEEN DATE '2024-01-24' AND DATE '2024-01-30' AND s.shifts > 0
  GROUP BY 1, 2, 3),
o_last AS (
  SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY partner_id ORDER BY updated_at DESC, event_id DESC) AS rn FROM stg_background_check) WHERE rn = 1),
o_adj AS (
  SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY partner_id ORDER BY updated_at DESC, event_id DESC) AS rn FROM stg_background_check
    WHERE updated_at >= TIMESTAMP '2024-01-10 00:00:00'
      AND (event LIKE '%adverse_action' OR (event = 'report.engaged' AND result = 'consider'))) WHERE rn = 1),
o_dispatch AS (
  SELECT partner_id, COUNT(*) FILTER (recent) AS total_shifts_sent_l7d, COUNT(*) FILTER (recent AND work) AS work_shifts_sent_l7d,
    COUNT(*) FILTER (recent AND work AND assigned_at IS NOT NULL) AS work_shifts_accepted_l7d,
    COUNT(*) FILTER (coming AND work) AS work_shifts_sent_next_7d,
    COUNT(*) FILTER (coming AND work AND seen_at IS NOT NULL) AS work_shifts_seen_next_7d
  FROM (SELECT *, title = 'Work Shift' AS work, sent_at >= TIMESTAMP '2024-01-31' - INTERVAL 180 DAY AS recent,
          start_at >= TIMESTAMP '2024-01-31' AS coming
        FROM stg_user_shift WHERE sent_at IS NOT NULL AND start_at >= TIMESTAMP '2024-01-31' - INTERVAL 180 DAY
          AND start_at < TIMESTAMP '2024-01-31' + INTERVAL 180 DAY)
  WHERE partner_id IN (SELECT partner_id FROM stg_partner WHERE company_name = 'BUILDING' AND zone_description IN (SELECT zone_description FROM o_market))
  GROUP BY 1),
o_done AS (
  SELECT partner_id, COUNT(*) FILTER (assignment_status = 'Completed') AS completed_shifts FROM stg_assignment
  WHERE company_name = 'BUILDING' AND shift_type IS DISTINCT FROM 'orientation' GROUP BY 1),
o_else AS (SELECT DISTINCT partner_id FROM stg_partner WHERE company_name <> 'BUILDING' AND s1c_date IS NOT NULL),
o_facts AS (
  SELECT p.*, m.city, m.fill_rate_l7d, m.priority_cohort_l2, m.priority_cohort_l1, COALESCE(b.result, 'no_bgc') AS bgc_result,
    b.updated_at AS bgc_submitted_at, a.event AS adj_event, r.partner_role_tier, r.lifetime_shifts,
    COALESCE(d.work_shifts_sent_l7d, 0) AS sent_l7d, COALESCE(d.work_shifts_accepted_l7d, 0) AS accepted_l7d,
    COALESCE(d.work_shifts_sent_next_7d, 0) AS sent, COALESCE(d.work_shifts_seen_next_7d, 0) AS seen,
    COALESCE(c.completed_shifts, 0) AS completed_shifts, e.partner_id IS NOT NULL AS elsewhere,
    (DATE_DIFF('second', p.last_active_at, TIMESTAMP '2024-01-31 06:00:00')) / 3600.0 AS idle_hours
  FROM stg_partner p JOIN o_market m ON m.zone_description = p.zone_description
  LEFT JOIN o_last b ON b.partner_id = p.partner_id LEFT JOIN o_adj a ON a.partner_id = p.partner_id
  LEFT JOIN o_dispatch d ON d.partner_id = p.partner_id LEFT JOIN stg_reliability r ON r.partner_id = p.partner_id
  LEFT JOIN o_done c ON c.partner_id = p.partner_id LEFT JOIN o_else e ON e.partner_id = p.partner_id
  WHERE p.company_name = 'BUILDING' AND p.last_active_at >= TIMESTAMP '2024-01-17 06:00:00'),
o_stage AS (
  SELECT *, CASE WHEN currently_suspended THEN 'S' WHEN currently_deactivated OR is_fraud_partner THEN 'D'
      WHEN adj_event LIKE '%adverse_action' THEN 'F'
      WHEN s1c_date IS NOT NULL AND shifts_assigned_next_7d > 0 THEN 'A' WHEN s1c_date IS NOT NULL AND shifts_assigned_next_7d = 0 THEN 'N'
      WHEN op_date IS NOT NULL AND s1c_date IS NULL THEN
        CASE WHEN adj_event = 'report.engaged' OR (adj_event IS NULL AND bgc_result = 'clear') THEN 'P' ELSE 'B' END
      WHEN oa_date IS NOT NULL AND op_date IS NULL THEN 'O' WHEN oa_date IS NULL THEN 'X' ELSE 'U' END AS stage,
    CASE WHEN sent = 0 THEN 0 WHEN seen = 0 THEN 1 ELSE 2 END AS offer,
    CASE WHEN elsewhere THEN '17_not_oa_non_ckp_s1c' WHEN last_active_at >= TIMESTAMP '2024-01-30 06:00:00' THEN '18_not_oa_active_24h'
         WHEN last_active_at >= TIMESTAMP '2024-01-28 06:00:00' THEN '19_not_oa_active_72h'
         WHEN last_active_at >= TIMESTAMP '2024-01-24 06:00:00' THEN '20_not_oa_active_7d' ELSE '21_not_oa_active_7d_plus' END AS idle_code
  FROM o_facts),
o_coded AS (
  SELECT *, CASE stage WHEN 'S' THEN '24_former_suspended' WHEN 'D' THEN '23_former_deactivated' WHEN 'F' THEN '22_former_failed_bgc'
    WHEN 'A' THEN CASE WHEN shifts_worked_last_7d >= 5 THEN '01_s1c_assigned_champion' WHEN completed_shifts < 3 THEN '04_s1c_assigned_not_s3c'
                       WHEN partner_role_tier = 'M1 - Active' THEN '03_s1c_assigned_m1_s3c' ELSE '02_s1c_assigned_non_m1_s3c' END
    WHEN 'N' THEN ['07_s1c_not_assigned_not_sent', '06_s1c_not_assigned_sent_not_seen', '05_s1c_not_assigned_sent_seen'][offer + 1]
    WHEN 'P' THEN CASE WHEN shifts_assigned_next_7d > 0 THEN '08_bgc_passed_s1a_assigned'
                       ELSE ['11_bgc_passed_not_sent', '10_bgc_passed_sent_not_seen', '09_bgc_passed_sent_seen'][offer + 1] END
    WHEN 'B' THEN CASE WHEN bgc_result = 'consider' AND adj_event IS NULL THEN '12_op_bgc_consider' WHEN bgc_result <> 'pending' THEN '15_op_bgc_not_submitted'
                       WHEN bgc_submitted_at < TIMESTAMP '2024-01-30 06:00:00' THEN '13_op_bgc_pending_gt24h' ELSE '14_op_bgc_pending_lt24h' END
    WHEN 'O' THEN '16_oa_not_op' WHEN 'X' THEN idle_code ELSE '99_unclassified' END AS cohort
  FROM o_stage),
o_dim AS (
  SELECT * FROM (VALUES
    ('01_s1c_assigned_champion', 'Champion (5+ weekly shifts)', 'S1C, Assigned', 'Maximize output'),
    ('02_s1c_assigned_non_m1_s3c', 'Non-M1, S3C', 'S1C, Assigned', 'Work more'),
    ('03_s1c_assigned_m1_s3c', 'M1, S3C', 'S1C, Assigned', 'Work more'),
    ('04_s1c_assigned_not_s3c', 'Not S3C', 'S1C, Assigned', 'Work more'),
    ('05_s1c_not_assigned_sent_seen', 'Sent, Seen', 'S1C, Not Assigned', 'Pick up shifts (seen)'),
    ('06_s1c_not_assigned_sent_not_seen', 'Sent, Not Seen', 'S1C, Not Assigned', 'Pick up shifts (not seen)'),
    ('07_s1c_not_assigned_not_sent', 'Not Sent', 'S1C, Not Assigned', 'Show shifts'),
    ('08_bgc_passed_s1a_assigned', 'S1A, Currently Assigned', 'BGC Passed, Not S1C', 'S1A (shift coming)'),
    ('09_bgc_passed_sent_seen', 'Sent, Seen', 'BGC Passed, Not S1C', 'Pick up shifts (BGC clear)'),
    ('10_bgc_passed_sent_not_seen', 'Sent, Not Seen', 'BGC Passed, Not S1C', 'Pick up shifts (BGC clear)'),
    ('11_bgc_passed_not_sent', 'Not Sent', 'BGC Passed, Not S1C', 'Show shifts (BGC clear)'),
    ('12_op_bgc_consider', 'Consider', 'OP, Not BGC Finalized', 'Escalate for review'),
    ('13_op_bgc_pending_gt24h', 'Pending > 24H', 'OP, Not BGC Finalized', 'BGC stuck (>24h)'),
    ('14_op_bgc_pending_lt24h', 'Pending < 24H', 'OP, Not BGC Finalized', 'BGC processing (<24h)'),
    ('15_op_bgc_not_submitted', 'Not Submitted', 'OP, Not BGC Finalized', 'Submit BGC'),
    ('16_oa_not_op', 'All', 'OA, Not OP', 'Complete orientation'),
    ('17_not_oa_non_ckp_s1c', 'Non CKP S1C', 'Not OA', 'Cross-sell to CKP'),
    ('18_not_oa_active_24h', 'Active 24hrs No OA', 'Not OA', 'OA (active)'),
    ('19_not_oa_active_72h', 'Active 72hrs No OA', 'Not OA', 'OA (active)'),
    ('20_not_oa_active_7d', 'Active 7 Days No OA', 'Not OA', 'OA (active)'),
    ('21_not_oa_active_7d_plus', 'Active +7 Days No OA', 'Not OA', 'OA (inactive)'),
    ('22_former_failed_bgc', 'Failed BGC', 'Former', 'No action (failed BGC)'),
    ('23_former_deactivated', 'Deactivated', 'Former', 'No action'),
    ('24_former_suspended', 'Suspended', 'Former', 'No action'),
    ('25_former_failed_bgc', 'Failed BGC (Override)', 'Former', 'No action (failed BGC)')) t(code, label, l1_group, action)),
o_roster AS (
  SELECT c.*, COALESCE(d.l1_group, 'Unclassified') AS cohort_l1, COALESCE(d.action, 'OA (inactive)') AS triage_action,
    CASE WHEN cohort = '15_op_bgc_not_submitted' AND bgc_result NOT IN ('no_bgc', 'cancelled')
         THEN CASE WHEN oa_date IS NULL THEN i.label ELSE 'Unclassified' END ELSE COALESCE(d.label, 'Unclassified') END AS cohort_l2
  FROM o_coded c LEFT JOIN o_dim d ON d.code = c.cohort LEFT JOIN o_dim i ON i.code = c.idle_code)
"""
