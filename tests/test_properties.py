"""Relations that hold whatever the data."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from crewline.operators import calendars, counts, joins, latest, ordering, rollup
from crewline.plans import checks, funnel, shifts, zones
from crewline.sources import dimensions as dims
from registry.core import EVENT_TIE, P


@pytest.fixture(scope="module")
def coded(staged):
    return funnel.cohorted(staged, P, EVENT_TIE).persist()


def test_summary_and_roster_agree(coded):
    summary = funnel.funnel_summary(coded).collect()
    assert [r.cohort for r in summary] == sorted(set(dims.LABEL_OF) - set(dims.OVERRIDE_ONLY))
    lost = coded.where(F.col("cohort") == dims.UNCLASSIFIED).count()
    assert sum(r.total for r in summary) + lost == funnel.funnel_roster(coded, P).count()
    for r in summary:
        assert sum(r[name] for name in dims.L2_COUNT_COLUMNS) <= r.total


def test_rollup_adds_up(coded):
    rows = rollup.funnel_rollup(coded).collect()
    level = {n: sum(r.partners for r in rows if r.level == n) for n in (0, 1, 3)}
    assert level[0] == level[1] == level[3] == coded.count()


def test_breakdown_hides_unmapped_codes_but_counts_them(spark):
    rows = [("01_s1c_assigned_champion",)] * 3 + [("98_unknown",)]
    df = spark.createDataFrame(rows, "partner_cohort string")
    out = {(r.level, r.l1_group): (r.partners, r.pct) for r in funnel.funnel_breakdown(df).collect()}
    assert out == {(0, "S1C, Assigned"): (3, 75.0), (1, "S1C, Assigned"): (3, 75.0), (3, None): (4, 100.0)}
    kpi = funnel.funnel_kpis(df).first()
    assert (kpi.total_pipeline, kpi.s1c_assigned) == (4, 3)


def test_latest_does_not_depend_on_input_order(spark):
    rows = [(k % 3, datetime(2024, 1, 1 + k % 2), k) for k in range(30)] + [(None, datetime(2024, 1, 1), 99)]
    df = spark.createDataFrame(rows, "key int, at timestamp_ntz, id int")
    for shuffled in (df, df.orderBy(F.col("id").desc()), df.repartition(7)):
        got = {(r.key, r.id) for r in latest.latest_per_key(shuffled, ["key"], "at", ["id"]).collect()}
        assert got == {(0, 27), (1, 25), (2, 29), (None, 99)}


def test_one_pass_facts_equal_two_windows(staged):
    c = staged.background_checks
    for legacy in (False, True):
        facts = checks.check_facts(c, P.adjudication_from, legacy, EVENT_TIE)
        last = checks.bgc_latest(c, EVENT_TIE).join(checks.bgc_adjudication(c, P.adjudication_from, legacy, EVENT_TIE), "partner_id", "left")
        one = facts.select("partner_id", F.coalesce("bgc_result_raw", F.lit("no_bgc")), "bgc_submitted_at", "bgc_adjudication_event", "bgc_adjudication_date")
        two = last.select("partner_id", "bgc_result", "bgc_submitted_at", "bgc_adjudication_event", "bgc_adjudication_date")
        assert one.exceptAll(two).count() == two.exceptAll(one).count() == 0


def test_one_hot_key(spark):
    """A third of the rows under one key, and NULL keys: nothing is lost."""
    df = spark.range(90_000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.col("id").cast("string")).alias("key"), "id"
    )
    counted = latest.partition_counts(df, ["key"], {"n": None, "even": F.col("id") % 2 == 0})
    got = counted.groupBy("key").agg(F.count("*").alias("rows"), F.max("n").alias("n"), F.max("even").alias("even"))
    hot = {r.key: (r.rows, r.n, r.even) for r in got.where("key = 'hot' OR key IS NULL").collect()}
    assert hot == {"hot": (30_000, 30_000, 15_000), None: (30_000, 30_000, 15_000)}
    assert counted.count() == 90_000
    assert latest.top_k_per_group(df, ["key"], [F.col("id").desc()], 5).where("key = 'hot'").count() == 5
    lists = calendars.day_lists(df.withColumn("kind", F.col("id") % 4), ["key"], ["kind"]).where("key = 'hot'").first()
    assert lists.shifts == 30_000 and len(lists.entries) == 4 and sum(e.n for e in lists.entries) == 30_000


def test_flags_do_not_multiply_rows(spark):
    base = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    keys = spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "k string, x int")
    out = {(r.k, r.hit) for r in joins.flag_exists(base, keys, "k", "hit").collect()}
    assert out == {("a", True), ("b", False), (None, False)}


def test_priority_pick_takes_values_of_one_row(spark):
    df = spark.createDataFrame([("z", 2, "b", "x"), ("z", 1, "c", "y"), ("z", 1, "a", "w")], "zone string, prio int, l2 string, l1 string")
    assert counts.pick_by_priority(df, ["zone"], ["l2", "l1"], "prio").first() == ("z", "a", "w")


def test_split_is_sorted(staged):
    past, future = ordering.split_past_future(staged.user_shifts.select("shift_key", "start"), "start", P.as_of_ts, ["shift_key"])
    gone, coming = [r.start for r in past.collect()], [r.start for r in future.collect()]
    assert gone == sorted(gone, reverse=True) and coming == sorted(coming)
    assert max(gone) < P.as_of_ts <= min(coming)


def test_sorted_marts(staged, coded):
    roster = [(r.cohort_combo, r.fill_rate_l7d, r.city) for r in funnel.funnel_roster(coded, P).collect()]
    assert roster == sorted(roster)
    sizes = [r.total_shifts for r in zones.zone_summary(zones.zone_rows(staged.shift_assignments)).collect()]
    assert sizes == sorted(sizes, reverse=True)


def test_calendar_cells(spark):
    rows = [("p", date(2024, 2, 10), "Completed"), ("p", date(2024, 2, 10), "NoShow"), ("p", date(2024, 3, 1), "NoShow"), ("q", date(2023, 12, 31), "Assigned")]
    df = spark.createDataFrame(rows, "partner_id string, shift_date date, assignment_status string")
    cells = calendars.calendar_grid(calendars.day_marks(df, "partner_id"), "partner_id").collect()
    feb = [c for c in cells if c.partner_id == "p" and c.month_start == date(2024, 2, 1)]
    assert len(feb) == 35 and sum(c.day > 0 for c in feb) == 29
    first = next(c for c in feb if c.day == 1)
    assert (first.week, first.weekday) == (0, 3)  # a Thursday
    tenth = next(c for c in feb if c.day == 10)
    assert (tenth.shifts, tenth.day_class, tenth.weekday) == (2, "green", 5)
    assert {c.month_start for c in cells if c.partner_id == "q"} == {date(2023, 12, 1)}
    assert next(c for c in cells if c.shift_date == date(2024, 3, 1)).day_class == "red"


def test_kpis_count_all_shifts(staged):
    rows = shifts.market_shifts(staged.shift_assignments)
    assert shifts.market_kpis(rows).first().total_shifts == 6000
    done = shifts.market_kpis(rows, ["Completed"]).first()
    assert done.total_shifts == done.completed > 0 and done.fill_rate == 100.0
    assert shifts.market_kpis(rows, ["nothing"]).first().fill_rate == 0.0
