"""The driver's tables in the shapes of the declared sources (FIXTURES.md, Part B).

Columns that the views of Part B lack are filled where an operator needs them; ids are text.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from crewline.sources.sinks import materialize
from crewline.sources.tables import conform

MOVE = "INTERVAL 9496 DAY"

# Declared schemas spare a job per table that would read footers.
RAW = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": """o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,
        o_orderdate timestamp_ntz, o_orderpriority string""",
    "lineitem": """l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,
        l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,
        l_shipdate timestamp_ntz""",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def _named(made: dict[str, str]) -> list[str]:
    return [f"{text} AS `{name}`" for name, text in made.items()]


class Staged:
    """Lazy frames over one folder of test tables; behaves as a mapping from table name to frame."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._raw: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._raw:
            self._raw[name] = self.spark.read.schema(RAW[name]).parquet(f"{self.folder}/{name}.parquet")
        return self._raw[name]

    def __getitem__(self, name: str) -> DataFrame:
        return getattr(self, name)

    @cached_property
    def _events(self) -> DataFrame:
        customers = self.raw("customer").agg(F.count("*")).scalar()
        return self.raw("events").withColumn("k", F.col("event_id") % customers)

    @cached_property
    def partner_throughput(self) -> DataFrame:
        customer = self.raw("customer")
        homes = customer.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("company_name"))
        extra = homes.where("k % 2 = 0 AND company_name <> 'BUILDING'").select("k", F.lit("BUILDING").alias("company_name"))
        seen = self._events.groupBy("k").agg(F.max("ts").alias("seen_ts"))
        rows = (
            customer.join(self.raw("nation"), F.expr("c_nationkey = n_nationkey"))
            .join(self.raw("region"), F.expr("n_regionkey = r_regionkey"))
            .join(homes.unionByName(extra), F.expr("c_custkey = k"))
            .drop("k")
            .join(seen, F.expr("c_custkey = k"), "left")
        )
        made = {
            "partner_id": "c_custkey",
            "first_name": "c_name",
            "last_name": "c_mktsegment",
            "zone_description": "n_name",
            "city_description": "r_name || '_' || n_name",
            "last_active_at": """CASE WHEN c_custkey % 4 = 1 THEN seen_ts - INTERVAL 8 DAY
                                      WHEN c_custkey % 20 = 3 THEN seen_ts - INTERVAL 20 DAY ELSE seen_ts END""",
            "created_date": "DATE '2023-06-02'",
            "oa_date": "CASE WHEN c_custkey % 10 < 8 THEN DATE '2023-07-01' END",
            "op_date": "CASE WHEN c_custkey % 10 < 7 THEN DATE '2023-08-01' END",
            "s1c_date": """CASE WHEN c_custkey % 10 < 4 OR (c_custkey % 10 = 8 AND company_name <> 'BUILDING')
                                THEN DATE '2023-09-01' END""",
            "shifts_assigned_next_7d": "CASE WHEN c_custkey % 97 <> 5 THEN (c_custkey % 7) * (c_custkey % 3) END",
            "shifts_worked_last_7d": "c_custkey % 8",
            "total_shifts_last_4w": "c_custkey % 13",
            "weeks_worked_last_4w": "c_custkey % 5",
            "currently_suspended": "c_custkey % 53 = 11",
            "currently_deactivated": "c_custkey % 47 = 13",
            "is_fraud_partner": "c_custkey % 61 = 17",
            "closest_store_proximity_miles": "CAST((c_custkey * 29 % 500) / 10 AS DOUBLE)",
            "churn_probability": "CAST(c_custkey % 1000 AS DOUBLE) / 999",
            "partner_lat": "30 + CAST(c_custkey * 37 % 1000 AS DOUBLE) / 1000",
            "partner_lng": "-120 + CAST(c_custkey * 91 % 3000 AS DOUBLE) / 1000",
        }
        return conform(rows.selectExpr("company_name", *_named(made)), "partner_throughput")

    @cached_property
    def background_checks(self) -> DataFrame:
        rows = self._events.where("event_id % 3 <> 0").select(
            F.col("k").alias("partner_id"),
            F.col("ts").alias("updated_at"),
            F.expr("ts - INTERVAL 3 DAY").alias("created_at"),
            "event_id",
            F.expr(
                """CASE event_type WHEN 'purchase' THEN 'clear' WHEN 'view' THEN 'consider'
                   WHEN 'click' THEN 'pending' WHEN 'error' THEN 'suspended' END"""
            ).alias("result"),
            F.expr(
                """CASE WHEN event_id % 2 = 0 THEN 'report_clear' WHEN event_id % 3 = 0 THEN 'report_consider'
                   ELSE 'invitation_pending' END"""
            ).alias("status"),
            F.expr(
                """CASE WHEN event_id % 29 = 3 THEN 'report.pre_adverse_action'
                   WHEN event_id % 31 = 3 THEN 'report.post_adverse_action'
                   WHEN event_id % 5 = 1 THEN 'report.engaged' END"""
            ).alias("event"),
        )
        return conform(rows, "background_checks", "event_id")

    @cached_property
    def user_shifts(self) -> DataFrame:
        made = {
            "partner_id": "o_custkey",
            "shift_key": "o_orderkey",
            "company": "o_orderpriority",
            "title": """CASE o_orderpriority WHEN '1-URGENT' THEN 'Orientation' WHEN '2-HIGH' THEN 'Shadow Shift'
                             ELSE 'Work Shift' END""",
            "status": """CASE o_orderkey % 6 WHEN 0 THEN 'Canceled' WHEN 1 THEN 'Declined' WHEN 2 THEN 'Completed'
                              WHEN 3 THEN 'Assigned' ELSE 'Sent' END""",
            "start": f"o_orderdate + {MOVE}",
            "sent_at": "CASE WHEN o_orderkey % 10 <> 0 THEN o_orderdate + INTERVAL 9491 DAY END",
            "seen_at": "CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + INTERVAL 9492 DAY END",
            "assigned_at": "CASE WHEN o_orderkey % 6 IN (2, 3) THEN o_orderdate + INTERVAL 9493 DAY END",
            "completed_at": f"CASE WHEN o_orderkey % 6 = 2 THEN o_orderdate + {MOVE} END",
        }
        rows = self.raw("orders").selectExpr(*_named(made))
        return conform(rows, "user_shifts", "shift_key")

    @cached_property
    def shift_assignments(self) -> DataFrame:
        # Orders meet their customers first, so line items are shuffled once whatever the size of the customers. Both are facts: they are
        # merged also where one would still fit a broadcast, so what is shuffled grows in proportion.
        placed = self.raw("orders").join(self.raw("customer"), F.expr("o_custkey = c_custkey"))
        rows = (
            self.raw("lineitem")
            .join(placed.hint("merge"), F.expr("l_orderkey = o_orderkey"))
            .join(self.raw("supplier"), F.expr("l_suppkey = s_suppkey"))
        )
        start = F.expr(f"l_shipdate + {MOVE} + l_linenumber * INTERVAL 1 HOUR")
        money = "decimal(12,2)"
        done, kept = F.col("l_returnflag") == "R", F.col("l_linestatus") == "O"
        lost = F.col("l_returnflag") == "A"
        return conform(
            rows.select(
                F.col("c_mktsegment").alias("company_name"),
                F.expr("l_orderkey * 8 + l_linenumber").alias("shift_id"),
                F.expr("'Shift ' || l_linenumber").alias("shift_title"),
                F.col("o_custkey").alias("partner_id"),
                F.expr(f"CAST(l_shipdate + {MOVE} AS DATE)").alias("shift_date"),
                F.when(done, "Completed").when(lost & ~kept, "NoShow").when(lost, "Canceled").otherwise("Assigned").alias("assignment_status"),
                F.struct(
                    F.expr("CASE l_partkey % 9 WHEN 0 THEN NULL WHEN 1 THEN 'orientation' ELSE 'work' END").alias("type"),
                    start.alias("start"),
                    (start + F.expr("INTERVAL 4 HOUR")).alias("end"),
                    F.lit(4.0).alias("duration"),
                    F.expr("l_linenumber = 7").alias("is_remote"),
                ).alias("shift"),
                F.struct(
                    F.col("s_suppkey").cast("string").alias("external_id"),
                    F.expr("CASE WHEN s_suppkey % 20 <> 7 THEN 'hex_' || s_nationkey END").alias("store_cluster"),
                    F.col("s_name").alias("saved_location_name"),
                ).alias("location"),
                F.struct(
                    F.expr("CASE WHEN c_custkey % 6 <> 0 THEN c_name END").alias("first_name"),
                    F.expr("CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END").alias("last_name"),
                ).alias("partner"),
                F.struct(done.alias("is_completed"), (lost & ~kept).alias("is_noshow"), (lost & kept).alias("is_canceled")).alias("assignment"),
                F.struct(
                    F.col("l_quantity").cast(money).alias("rate"),
                    F.col("l_extendedprice").cast(money).alias("base_amount"),
                    F.expr(f"CASE WHEN l_discount > 0.02 THEN CAST(l_discount * 100 AS {money}) END").alias("shift_bonus_amount"),
                    F.col("l_extendedprice").cast(money).alias("total_amount"),
                    F.when(kept, "Pending").otherwise("Approved").alias("approval_status"),
                    F.when(done, "Paid").alias("status"),
                ).alias("payment"),
                F.struct(
                    F.when(done, start).alias("check_in_at"), F.lit(None).cast("timestamp_ntz").alias("check_out_at")
                ).alias("attendance"),
            ),
            "shift_assignments",
        )

    @cached_property
    def supply_daily_position(self) -> DataFrame:
        zones = self.raw("nation").join(self.raw("region"), F.expr("n_regionkey = r_regionkey"))
        zones = zones.select(
            F.expr("'hex_' || n_nationkey").alias("store_cluster"),
            F.col("n_name").alias("zone_description"),
            F.expr("r_name || '_' || n_name").alias("hex_city_description"),
        )
        daily = self.shift_assignments.groupBy(
            "company_name", F.col("shift_date").alias("date"), F.col("location.store_cluster").alias("store_cluster")
        ).agg(F.count("*").alias("shifts"), F.count_if("assignment.is_completed").alias("filled"))
        # A stored table in the original; written once here, as plans read it several times and its days are few.
        return materialize(conform(daily.join(zones, "store_cluster").withColumn("position", F.lit("All")), "supply_daily_position"))

    @cached_property
    def store_crm(self) -> DataFrame:
        rows = self.raw("supplier").join(self.raw("nation"), F.expr("s_nationkey = n_nationkey"))
        l2 = """CASE s_suppkey % 6 WHEN 0 THEN 'C1: Subscale Deep Dives' WHEN 1 THEN 'C2a: FR<80 (Any)'
                WHEN 2 THEN 'C2b: StoreSmart Alpha' WHEN 3 THEN 'C2c: T25, FR 80-90%' ELSE 'C9: Other' END"""
        l1 = """CASE WHEN s_suppkey % 6 < 2 THEN 'C1: Root Cause Diagnosis'
                WHEN s_suppkey % 6 < 5 THEN 'C2: Unblock Partner Funnel' ELSE 'C9: Other' END"""
        return conform(
            rows.select(
                F.col("n_name").alias("zone_desc"), F.col("s_suppkey").alias("store_num"),
                F.expr(l1).alias("priority_cohort_l1"), F.expr(l2).alias("priority_cohort_l2"),
            ),
            "store_crm",
        )

    @cached_property
    def locations(self) -> DataFrame:
        made = {
            "external_id": "s_suppkey",
            "company_name": "CASE s_suppkey % 3 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'FURNITURE' ELSE 'MACHINERY' END",
            "hex": "'hex_' || s_nationkey",
            "city": "CASE WHEN s_suppkey % 11 <> 0 THEN 'City ' || s_suppkey % 17 END",
            "state_code": "CASE WHEN s_suppkey % 7 <> 0 THEN 'S' || s_suppkey % 5 END",
            "is_active": "s_suppkey % 10 <> 9",
            "lat": "30 + CAST(s_suppkey * 53 % 1000 AS DOUBLE) / 1000",
            "lng": "CASE WHEN s_suppkey % 25 <> 24 THEN -120 + CAST(s_suppkey * 71 % 3000 AS DOUBLE) / 1000 END",
        }
        return conform(self.raw("supplier").selectExpr(*_named(made)), "locations")

    @cached_property
    def partner_reliability(self) -> DataFrame:
        made = {
            "partner_id": "c_custkey",
            "ds": "DATE '2024-01-31'",
            "partner_role_tier": "CASE c_custkey % 4 WHEN 0 THEN 'M1 - Active' WHEN 1 THEN 'M1 - Lapsed' WHEN 2 THEN 'Standard' END",
            "lifetime_shifts": "c_custkey % 11",
        }
        return conform(self.raw("customer").selectExpr(*_named(made)), "partner_reliability")

    @cached_property
    def _bonus_events(self) -> DataFrame:
        return self._events.where("event_type IN ('signup', 'purchase')").withColumn("bonus_id", F.expr("event_id % 40"))

    @cached_property
    def bonus_eligible_users(self) -> DataFrame:
        rows = self._bonus_events.select("bonus_id", F.col("k").alias("partner_id")).distinct()
        return conform(rows, "bonus_eligible_users")

    @cached_property
    def bonus_progress(self) -> DataFrame:
        made = {
            "bonus_id": "bonus_id",
            "partner_id": "k",
            "updated_at": "ts",
            "title": "'Bonus ' || bonus_id",
            "count_progress": "event_id % 7",
            "shifts_required": "CASE WHEN event_id % 9 <> 0 THEN 5 END",
            "amount": "value",
            "is_complete": "event_id % 7 >= 5",
            "is_viewed": "CASE WHEN event_id % 3 <> 0 THEN event_id % 3 = 1 END",
            "companies": "CASE WHEN event_id % 5 <> 0 THEN array('unit_' || event_id % 3, 'department_' || event_id % 4) END",
            "event_id": "event_id",
        }
        rows = self._bonus_events.selectExpr(*_named(made))
        return conform(rows, "bonus_progress", "event_id")

    @cached_property
    def partner_deactivations(self) -> DataFrame:
        made = {
            "partner_id": "k",
            "ds": "CAST(ts AS DATE)",
            "is_banned": "event_id % 9 = 0",
            "is_deactivated": "event_id % 4 <> 0",
            "deactivation_level": "CASE WHEN event_id % 2 = 0 THEN 'company' END",
            "deactivation_company": """CASE event_id % 3 WHEN 1 THEN 'unit_' || event_id % 4
                                            WHEN 2 THEN 'department_of_long_names_' || event_id % 7 END""",
            "reactivation_date": "CASE WHEN event_id % 5 = 0 THEN CAST(ts + INTERVAL 3 DAY AS DATE) END",
            "event_id": "event_id",
        }
        rows = self._events.where("event_type = 'error' AND event_id % 4 <= 1")
        return conform(rows.selectExpr(*_named(made)), "partner_deactivations", "event_id")

    @cached_property
    def user_certs(self) -> DataFrame:
        rows = self._events.where("event_type = 'click'").groupBy(
            F.col("k").alias("partner_id"),
            F.expr("'tag_' || event_id % 6").alias("tag"),
            F.expr("'Cert ' || event_id % 7").alias("title"),
        )
        return conform(rows.agg(F.max("ts").alias("updated_at")), "user_certs")

    @cached_property
    def partner_assessment_status(self) -> DataFrame:
        made = {
            "partner_id": "c_custkey",
            "reporting_company": "c_mktsegment",
            "assessment_status": "CASE c_custkey % 3 WHEN 0 THEN 'passed' WHEN 1 THEN 'failed' END",
            "ts_account_created": "TIMESTAMP_NTZ '2023-01-01 00:00:00' + c_custkey * INTERVAL 1 HOUR",
        }
        return conform(self.raw("customer").selectExpr(*_named(made)), "partner_assessment_status")

    @cached_property
    def bgc_override(self) -> DataFrame:
        return conform(self.raw("customer").where("c_custkey % 71 = 1").select(F.col("c_custkey").alias("partner_id")), "bgc_override")
