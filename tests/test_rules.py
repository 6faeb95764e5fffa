"""Hand-made rows, one per branch, and NULL in every input."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from crewline.functions import bgc, funnel as rules, shifts, text, times
from crewline.sources import dimensions as dims

NOW = datetime(2024, 1, 31, 6)
D = date(2024, 1, 1)
SCHEMA = """currently_suspended boolean, currently_deactivated boolean, is_fraud_partner boolean, oa_date date, op_date date,
  s1c_date date, last_active_at timestamp_ntz, shifts_assigned_next_7d bigint, shifts_worked_last_7d bigint, partner_role_tier string,
  bgc_result string, bgc_submitted_at timestamp_ntz, bgc_adjudication_event string, work_shifts_sent_next_7d bigint,
  work_shifts_seen_next_7d bigint, completed_shifts bigint, s1c_elsewhere boolean"""
WORKED = dict(oa_date=D, op_date=D, s1c_date=D)
ORIENTED = dict(oa_date=D, op_date=D)
CLEAR = dict(ORIENTED, bgc_result="clear")

# (row, code, label); the label differs from the code's own only where it is spelled out.
CASES = [
    (dict(currently_suspended=True, currently_deactivated=True), "24", None),
    (dict(currently_deactivated=True), "23", None),
    (dict(is_fraud_partner=True), "23", None),
    (dict(WORKED, bgc_adjudication_event=bgc.PRE_ADVERSE), "22", None),
    (dict(bgc_adjudication_event=bgc.POST_ADVERSE), "22", None),
    (dict(WORKED, shifts_assigned_next_7d=1, shifts_worked_last_7d=5, completed_shifts=9), "01", None),
    (dict(WORKED, shifts_assigned_next_7d=1, completed_shifts=3), "02", None),
    (dict(WORKED, shifts_assigned_next_7d=1, completed_shifts=3, partner_role_tier="M1 - Lapsed"), "02", None),
    (dict(WORKED, shifts_assigned_next_7d=1, completed_shifts=3, partner_role_tier="M1 - Active"), "03", None),
    (dict(WORKED, shifts_assigned_next_7d=1, completed_shifts=2, shifts_worked_last_7d=4), "04", None),
    (dict(WORKED, shifts_assigned_next_7d=1), "04", None),
    (dict(WORKED, shifts_assigned_next_7d=0, work_shifts_sent_next_7d=2, work_shifts_seen_next_7d=1), "05", None),
    (dict(WORKED, shifts_assigned_next_7d=0, work_shifts_sent_next_7d=2), "06", None),
    (dict(WORKED, shifts_assigned_next_7d=0, work_shifts_seen_next_7d=2), "07", None),
    (dict(CLEAR, shifts_assigned_next_7d=1), "08", None),
    (dict(CLEAR, work_shifts_sent_next_7d=1, work_shifts_seen_next_7d=1), "09", None),
    (dict(CLEAR, work_shifts_sent_next_7d=1, work_shifts_seen_next_7d=0), "10", None),
    (dict(CLEAR), "11", None),
    (dict(ORIENTED, bgc_result="consider", bgc_adjudication_event=bgc.ENGAGED), "11", None),
    (dict(ORIENTED, bgc_adjudication_event=bgc.ENGAGED), "11", None),
    (dict(ORIENTED, bgc_result="consider"), "12", None),
    (dict(ORIENTED, bgc_result="pending", bgc_submitted_at=NOW - timedelta(hours=25)), "13", None),
    (dict(ORIENTED, bgc_result="pending", bgc_submitted_at=NOW - timedelta(hours=24)), "14", None),
    (dict(ORIENTED, bgc_result="pending"), "14", None),
    (dict(ORIENTED), "15", None),
    (dict(ORIENTED, bgc_result="no_bgc"), "15", None),
    (dict(ORIENTED, bgc_result="cancelled"), "15", None),
    (dict(ORIENTED, bgc_result="suspended"), "15", "Unclassified"),
    (dict(op_date=D, bgc_result="suspended", last_active_at=NOW - timedelta(hours=60)), "15", "Active 72hrs No OA"),
    (dict(op_date=D, bgc_result="suspended", s1c_elsewhere=True), "15", "Non CKP S1C"),
    (dict(oa_date=D), "16", None),
    (dict(s1c_elsewhere=True, last_active_at=NOW), "17", None),
    (dict(last_active_at=NOW - timedelta(hours=24)), "18", None),
    (dict(last_active_at=NOW - timedelta(days=3)), "19", None),
    (dict(last_active_at=NOW - timedelta(days=7)), "20", None),
    (dict(last_active_at=NOW - timedelta(days=7, seconds=1)), "21", None),
    (dict(), "21", None),
    # An unknown number of coming shifts is neither "some" nor "none".
    (dict(WORKED), "99", "Unclassified"),
    (dict(s1c_date=D, oa_date=D), "16", None),
]


@pytest.fixture(scope="module")
def coded(spark):
    rows = [tuple(row.get(name) for name in rules.FACTS) for row, _, _ in CASES]
    order = [part.split()[0] for part in SCHEMA.split(",")]
    assert order == list(rules.FACTS)
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], f"i int, {SCHEMA}")
    code = rules.cohort_code(NOW)
    out = df.withColumn("code", code).select(
        "i", "code", rules.cohort_l1(F.col("code")).alias("l1"), rules.cohort_l2(F.col("code"), NOW).alias("l2"),
        rules.triage_action(F.col("code")).alias("action"),
    )
    return {r.i: r for r in out.collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_cohort(coded, i):
    _, number, label = CASES[i]
    got = coded[i]
    assert got.code[:2] == number
    assert got.l2 == (label or dims.LABEL_OF[got.code])
    assert got.l1 == dims.GROUP_OF.get(got.code, "Unclassified")
    assert got.action == dims.ACTION_OF.get(got.code, "OA (inactive)")


def test_every_code_is_reached(coded):
    assert {r.code for r in coded.values()} == set(dims.LABEL_OF) - set(dims.OVERRIDE_ONLY) | {dims.UNCLASSIFIED}


def ask(spark, schema, rows, *columns):
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], f"i int, {schema}")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def test_override(spark):
    rows = [
        ("12_op_bgc_consider", True, True, 1),
        ("12_op_bgc_consider", False, True, 1),
        ("12_op_bgc_consider", False, True, 0),
        ("12_op_bgc_consider", False, True, None),
        ("12_op_bgc_consider", False, False, 1),
        ("16_oa_not_op", False, True, 1),
        (None, False, False, None),
    ]
    code = rules.override_cohort(F.col("c"), F.col("o"), F.col("k"), F.col("n"))
    got = [r[0] for r in ask(spark, "c string, o boolean, k boolean, n bigint", rows, code)]
    assert got == [
        "25_former_failed_bgc", "10_bgc_passed_sent_not_seen", "11_bgc_passed_not_sent", "11_bgc_passed_not_sent",
        "12_op_bgc_consider", "16_oa_not_op", None,
    ]


def test_bgc_labels(spark):
    rows = [
        ("clear", None), ("consider", None), ("pending", None), ("suspended", None), ("cancelled", None), ("no_bgc", None), (None, None),
        ("consider", bgc.ENGAGED), ("clear", bgc.PRE_ADVERSE), (None, bgc.POST_ADVERSE),
    ]
    r, e = F.col("r"), F.col("e")
    got = ask(spark, "r string, e string", rows, bgc.bgc_display(r, e), bgc.bgc_passed(r, e), bgc.bgc_delta(r, e))
    assert got == [
        ("Clear", True, "Passed"), ("Consider (Pending Review)", False, "Review needed"), ("Pending", False, "In progress"),
        ("Suspended", False, None), ("Cancelled", False, None), ("Not Submitted", False, None), ("Not Submitted", False, None),
        ("Cleared (Adjudicated)", True, "Cleared"), ("Failed (Post-Adverse)", False, "Failed"), ("Failed (Post-Adverse)", False, "Failed"),
    ]


def test_bgc_result_of_legacy_status(spark):
    rows = [(None, s) for s in ["report_clear", "report_cancelled", "invitation_expired", "else", None]] + [("clear", "report_consider")]
    got = ask(spark, "r string, s string", rows, bgc.bgc_result(F.col("r"), F.col("s")))
    assert [g[0] for g in got] == ["clear", "cancelled", "pending", "no_bgc", "no_bgc", "clear"]


def test_adjudication(spark):
    old, new = datetime(2024, 1, 9, 23), datetime(2024, 1, 10)
    rows = [
        ("consider", bgc.ENGAGED, new), ("clear", bgc.ENGAGED, new), (None, bgc.PRE_ADVERSE, new), ("clear", bgc.POST_ADVERSE, old),
        ("clear", bgc.ENGAGED, old), ("consider", None, new), ("consider", bgc.ENGAGED, None),
    ]
    args = [F.col("r"), F.col("e"), F.col("u"), date(2024, 1, 10)]
    no = F.lit(False)
    got = ask(
        spark, "r string, e string, u timestamp_ntz", rows,
        F.coalesce(bgc.adjudication_pred(*args), no), F.coalesce(bgc.adjudication_pred(*args, legacy=True), no),
    )
    assert got == [(True, True), (False, False), (True, True), (False, True), (False, True), (False, False), (False, False)]


def test_adjudication_label(spark):
    rows = [(bgc.PRE_ADVERSE, datetime(2024, 1, 5, 7)), ("other", None), (None, datetime(2024, 1, 5))]
    got = ask(spark, "e string, u timestamp_ntz", rows, bgc.adj_label(F.col("e"), F.col("u")))
    assert [g[0] for g in got] == ["Pre-Adverse (2024-01-05)", "other (?)", None]


def test_completion_and_classes(spark):
    rows = [(True, True, True), (None, True, True), (False, None, True), (None, None, None)]
    cols = [F.col("a"), F.col("b"), F.col("c")]
    got = ask(spark, "a boolean, b boolean, c boolean", rows, shifts.completion_status(*cols), shifts.deact_status(*cols[:2]), shifts.bonus_class(*cols[:2]))
    assert got == [
        ("Completed", "BANNED", "in"), ("No Show", "Deactivated", "in"), ("Canceled", "Active", "not_in"), ("Assigned", "Active", "not_in"),
    ]


def test_row_class(spark):
    rows = [("completed", None), ("Sent", NOW), ("DECLINED", None), ("Declined", NOW), ("Sent", None), (None, None)]
    s, a = F.col("s"), F.col("a")
    got = ask(spark, "s string, a timestamp_ntz", rows, shifts.row_class(s, a), shifts.is_accepted(s, a), shifts.is_accepted(s, a, False))
    assert got == [
        ("accepted", False, False), ("accepted", True, False), ("rejected", False, False), ("accepted", True, False), ("none", False, False), ("none", False, False),
    ]


def test_names_and_labels(spark):
    rows = [("Ann", "Lee"), (None, "Lee"), ("Ann", None), (None, None)]
    assert [r[0] for r in ask(spark, "a string, b string", rows, text.full_name(F.col("a"), F.col("b")))] == ["Ann Lee", "Lee", "Ann", ""]
    names = {"abc": "Alpha"}
    ids = [(["abc", "0123456789"],), ([],), (None,)]
    assert [r[0] for r in ask(spark, "x array<string>", ids, text.map_companies(F.col("x"), names))] == ["Alpha, 01234567...", "", "N/A"]
    long = [("abc",), ("0123456789012345678901",), ("None",), (None,)]
    assert [r[0] for r in ask(spark, "x string", long, text.map_company_long(F.col("x"), names))] == ["Alpha", "01234567890123456789", "N/A", "N/A"]
    zones = [("Oak_Park_IL", "z", ["oak park", "B", "A", "D", "C"]), ("Oak_IL", "z", ["OAK"]), ("Oak", "z", []), (None, "z", ["A"])]
    label = text.zone_label(F.col("c"), F.col("z"), F.col("x"))
    assert [r[0] for r in ask(spark, "c string, z string, x array<string>", zones, label)] == [
        "Oak_Park_IL | z (incl. A, B, C)", "Oak_IL | z", "Oak | z", "None | z (incl. A)",
    ]
    parts = [(3, 5), (None, 5), (3, None)]
    assert [r[0] for r in ask(spark, "a bigint, b bigint", parts, text.progress(F.col("a"), F.col("b")))] == ["3/5", "0/5", "3/?"]


def test_ages(spark):
    ages = [timedelta(0), timedelta(hours=23, minutes=59), timedelta(hours=24), timedelta(hours=47), timedelta(days=2), timedelta(microseconds=-1)]
    rows = [(NOW - a,) for a in ages] + [(None,)]
    got = ask(spark, "t timestamp_ntz", rows, times.days_ago(F.col("t"), NOW), times.recently_active(F.col("t"), NOW))
    assert got == [
        ("Today", True), ("Today", True), ("Yesterday", True), ("Yesterday", True), ("2d ago", True), ("-1d ago", True), ("Unknown", False),
    ]


def test_titles_and_tiers(spark):
    rows = [("Orientation day",), ("SHADOW shift",), ("Stocking",), (None,)]
    assert [r[0] for r in ask(spark, "t string", rows, shifts.is_work_shift(F.col("t")))] == [False, False, True, None]
    tiers = [("M1 - Active",), ("Active M1",), ("m1 active",), (None,)]
    got = ask(spark, "t string", tiers, shifts.is_m1_active(F.col("t")), shifts.is_m1_any(F.col("t")))
    assert got == [(True, 1), (False, 1), (False, 1), (None, 0)]


def test_lenient_timestamps_and_rounding(spark):
    rows = [("2024-01-31 06:00:00",), ("soon",), (None,)]
    assert [r[0] for r in ask(spark, "t string", rows, times.try_ts(F.col("t")))] == [NOW, None, None]
    row = ask(spark, "x double", [(12.25,)], F.round("x", 1), F.bround("x", 1))
    assert row == [(12.3, 12.2)]


def test_as_of_in_a_zone():
    from datetime import timezone

    assert times.as_of(datetime(2024, 1, 31, 3, tzinfo=timezone.utc), "America/New_York") == (date(2024, 1, 30), datetime(2024, 1, 30, 22))
