"""Places where the obvious reading goes wrong."""

from datetime import date, datetime
from decimal import Decimal


from crewline.operators.counts import sent_kpis, shift_kpis
from crewline.plans import bonuses, funnel, partners, stores, zones
from crewline.sources import dimensions as dims, tables
from registry.core import P


def test_last_priority_class_is_counted(spark):
    df = spark.createDataFrame([("16_oa_not_op", "C2c: T25, FR 80-90%")], "cohort string, priority_cohort_l2 string")
    assert funnel.cohort_counts(df).first().c2c_t25_fr_80_90 == 1


def test_missing_override_list_changes_nothing_and_duplicates_do_not_fan_out(spark):
    person = spark.createDataFrame(
        [("p1", P.company, dims.ROSTER_L2[0], P.as_of_ts, "12_op_bgc_consider", 1), ("p2", P.company, dims.ROSTER_L2[4], P.as_of_ts, None, None)],
        "partner_id string, company_name string, priority_cohort_l2 string, last_active_at timestamp_ntz, partner_cohort string, work_shifts_sent_next_7d bigint",
    )
    person = tables.conform(person, "partner_throughput")
    certs = spark.createDataFrame([("p1", "t", "a"), ("p1", "t", "b")], "partner_id string, tag string, title string")
    none = spark.createDataFrame([], "partner_id string")
    got = {r.partner_id: r.partner_cohort for r in funnel.funnel_v2_overrides(person, certs, none, P, "t").collect()}
    assert got == {"p1": "10_bgc_passed_sent_not_seen", "p2": None}
    over = spark.createDataFrame([("p1",), ("p1",)], "partner_id string")
    out = funnel.funnel_v2_overrides(person, certs, over, P, "t").orderBy("partner_id").collect()
    assert [(r.partner_cohort, r.bgc_adjudication_event) for r in out] == [("25_former_failed_bgc", "report.pre_adverse_action"), (None, None)]


def test_progress_rows_fan_out(spark):
    eligible = spark.createDataFrame([("b", "p"), ("b", "p"), ("b", "q"), ("c", "q")], "bonus_id string, partner_id string")
    moment = datetime(2024, 1, 1)
    progress = tables.conform(
        spark.createDataFrame(
            [("b", "p", 1, moment), ("b", "p", 2, moment), ("b", "x", 3, datetime(2024, 1, 2))],
            "bonus_id string, partner_id string, count_progress bigint, updated_at timestamp_ntz",
        ),
        "bonus_progress",
    )
    got = sorted((r.partner_id, r.bonus_id, r.progress, r.opted_in) for r in bonuses.partner_bonuses(eligible, progress).collect())
    assert got == [("p", "b", "1/?", "No"), ("p", "b", "2/?", "No"), ("q", "b", "0/?", "No")]


def test_distance_is_rounded_before_the_radius(spark):
    # 25.04 miles along a meridian shows as 25.0 and counts as within.
    north = 25.04 * 1609.34 / 6371008.8 * 180 / 3.141592653589793
    partner = spark.createDataFrame([("p", 0.0, 0.0)], "partner_id string, partner_lat double, partner_lng double")
    shop = tables.conform(
        spark.createDataFrame(
            [("7", "A", north, 0.0, True), ("10", "A", north, 0.0, True), ("8", "A", 0.0, 0.0, False)],
            "external_id string, company_name string, lat double, lng double, is_active boolean",
        ),
        "locations",
    )
    out = stores.nearest_stores(partner, shop, ["A"]).orderBy("rank").collect()
    assert [(r.store_number, r.distance_miles, r.stores_within_radius) for r in out] == [("10", 25.0, 2), ("7", 25.0, 2)]


def test_one_home_per_partner_and_zero_rows(spark):
    partner = spark.createDataFrame([("p", 0.0, 0.0), ("p", 1.0, 0.0), ("q", None, None)], "partner_id string, partner_lat double, partner_lng double")
    shop = tables.conform(spark.createDataFrame([("7", "A", 1.0, 0.0, True)], "external_id string, company_name string, lat double, lng double, is_active boolean"), "locations")
    out = sorted((r.partner_id, r.company_name, r["rank"] or 0, r.store_number, r.stores_within_radius, r.total_active_stores) for r in stores.nearest_stores(partner, shop, ["A", "B"]).collect())
    assert out == [("p", "A", 1, "7", 1, 1), ("p", "B", 0, None, 0, 0)]


def test_outlook_is_joined_on_company_and_store(spark):
    near = spark.createDataFrame([("p", "A", "1", "X", None), ("p", "B", "1", "X", "S")], "partner_id string, company_name string, store_number string, city string, state_code string")
    outlook = spark.createDataFrame([("A", "1", 4, date(2024, 2, 1))], "company_name string, store_number string, l7d_shifts bigint, next_shift_date date")
    out = {r.company_name: (r.l7d_shifts, r.next_shift, r.location) for r in stores.nearby_outlook(near, outlook).collect()}
    assert out == {"A": (4, "2024-02-01", None), "B": (0, "—", "X, S")}


def test_two_meanings_of_accepted(spark):
    df = spark.createDataFrame(
        [("p", "Sent", datetime(2024, 1, 1), None, None), ("p", "Completed", None, None, None), ("p", None, None, None, None)],
        "partner_id string, status string, assigned_at timestamp_ntz, seen_at timestamp_ntz, completed_at timestamp_ntz",
    )
    assert sent_kpis(df).first().accepted == 2
    assert sent_kpis(df, include_assigned_at=False).first().accepted == 1


def test_rows_without_zone_count_in_the_total_only(spark):
    money = Decimal("10.00")
    df = spark.createDataFrame(
        [("h", "1", "S", True, False, False, money, None, "p"), (None, "2", "S", None, False, False, None, money, "q"), ("h", None, None, False, True, False, None, None, None)],
        "zone_hex string, store_number string, store_name string, is_completed boolean, is_noshow boolean, is_canceled boolean, total_amount decimal(12,2), rate decimal(12,2), partner_id string",
    )
    zone = zones.zone_summary(df).collect()
    assert [(r.zone_hex, r.total_shifts, r.completed, r.noshows, r.fill_rate, r.avg_rate, r.unique_partners, r.store_count) for r in zone] == [
        ("h", 2, 1, 1, 50.0, None, 1, 1)
    ]
    assert [(r.store_number, r.total_shifts) for r in zones.store_summary(df).collect()] == [("1", 1)]
    total = shift_kpis(df).first()
    assert (total.total_shifts, total.total_pay, total.unique_partners, total.store_count) == (3, money, 2, 2)
    empty = shift_kpis(df.where("false")).first()
    assert (empty.total_shifts, empty.total_pay, empty.fill_rate) == (0, 0, 0.0)


def test_array_columns_survive_dedup(spark):
    df = tables.conform(
        spark.createDataFrame(
            [("b", "p", ["x"], datetime(2024, 1, 1)), ("b", "q", ["x", "y"], datetime(2024, 1, 2))],
            "bonus_id string, partner_id string, companies array<string>, updated_at timestamp_ntz",
        ),
        "bonus_progress",
    )
    assert [r.companies for r in bonuses.bonus_info(df).collect()] == [["x", "y"]]


def test_equal_update_times_have_one_winner(spark):
    same = datetime(2024, 1, 1)
    df = tables.conform(
        spark.createDataFrame([("p", same, True, None), ("p", same, False, True)], "partner_id string, ds timestamp_ntz, is_banned boolean, is_deactivated boolean"),
        "partner_deactivations",
    )
    out = partners.deactivation_status(df).collect()
    assert [(r.status, r.deactivation_level, r.company, r.last_reactivated) for r in out] == [("BANNED", "N/A", "N/A", "Never")]
