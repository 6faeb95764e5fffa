"""The partner funnel: summary, roster, roll-ups and the roster of stored cohorts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from crewline.functions import funnel as rules
from crewline.functions.shifts import is_m1_active, is_m1_any, is_work_shift
from crewline.functions.times import ntz
from crewline.operators.counts import cond_counts
from crewline.operators.filters import active_since, at_snapshot, filter_in, in_window, ne_or_null
from crewline.operators.joins import enrich, flag_exists, scope, zero_fill
from crewline.operators.rollup import funnel_rollup, pct_of_total
from crewline.params import FunnelParams
from crewline.plans.checks import TIE, check_facts
from crewline.plans.markets import target_markets
from crewline.sources import dimensions as dims
from crewline.sources.sinks import materialize

# The roster columns of each group, between the common head and tail, as the page shows them.
ROSTER_HEAD = ["partner_id", "first_name", "last_name", "city", "zone_description", "closest_store_miles"]
ROSTER_TAIL = ["email", "phone_number", "fill_rate_l7d", "priority_cohort_l2"]
ROSTER_DETAIL = {
    "S1C, Assigned": [
        "s1c_date", "completed_shifts", "m1_tier", "shifts_worked_last_7d", "shifts_assigned_next_7d",
        "work_shifts_sent_next_7d", "work_shifts_seen_next_7d", "churn_status",
    ],
    "S1C, Not Assigned": [
        "s1c_date", "completed_shifts", "m1_tier", "shifts_worked_last_7d", "shifts_assigned_next_7d",
        "work_shifts_sent_next_7d", "work_shifts_seen_next_7d", "churn_status",
    ],
    "BGC Passed, Not S1C": [
        "op_date", "bgc_status", "s1a_date", "shifts_assigned_next_7d", "work_shifts_sent_next_7d", "work_shifts_seen_next_7d",
    ],
    "OP, Not BGC Finalized": ["op_date", "bgc_status", "bgc_submitted_at", "bgc_adjudication_event"],
    "OA, Not OP": ["oa_date", "op_date"],
    "Not OA": ["dl_date", "last_active_at"],
    "Former": ["bgc_adjudication_event", "churn_status"],
}


def offer_counts(user_shifts: DataFrame, p: FunnelParams) -> DataFrame:
    """Offers per partner around the as-of day, combined on the map side."""
    work, start = is_work_shift(F.col("title")), F.col("start")
    coming = (start >= ntz(p.midnight(0))) & (start < ntz(p.midnight(p.dispatch_days)))
    recent = F.col("sent_at") >= ntz(p.midnight(-p.dispatch_days))
    near = in_window(user_shifts, "start", p.midnight(-p.dispatch_days), p.midnight(p.dispatch_days))
    return cond_counts(
        near.where(F.col("sent_at").isNotNull()),
        ["partner_id"],
        {
            "total_shifts_sent_l7d": recent,
            "work_shifts_sent_l7d": work & recent,
            "work_shifts_accepted_l7d": work & recent & F.col("assigned_at").isNotNull(),
            "work_shifts_sent_next_7d": work & coming,
            "work_shifts_seen_next_7d": work & coming & F.col("seen_at").isNotNull(),
        },
    )


def shift_dispatch(user_shifts: DataFrame, partners: DataFrame, markets: DataFrame, p: FunnelParams) -> DataFrame:
    """The same for partners of the target markets only.

    The scope is applied to one row per partner; when it is small enough to broadcast, Catalyst moves
    it below the aggregate by itself.
    """
    in_market = scope(partners.where(F.col("company_name") == p.company), markets, "zone_description")
    return scope(offer_counts(user_shifts, p), in_market, "partner_id")


def completed_shifts(assignments: DataFrame, p: FunnelParams) -> DataFrame:
    """Completed work shifts per partner at the client company."""
    rows = assignments.where(
        (F.col("company_name") == p.company)
        & (F.col("shift_date") >= F.lit(p.completed_from))
        & ne_or_null(F.col("shift.type"), "orientation")
        & F.col("partner_id").isNotNull()
    )
    return cond_counts(rows, ["partner_id"], {"completed_shifts": F.col("assignment_status") == "Completed"})


def non_client_s1c(partners: DataFrame, p: FunnelParams) -> DataFrame:
    """Partners who worked a first shift at another company."""
    return partners.where((F.col("company_name") != p.company) & F.col("s1c_date").isNotNull()).select("partner_id").distinct()


def reliability_today(reliability: DataFrame, p: FunnelParams) -> DataFrame:
    return at_snapshot(reliability, "ds", p.as_of_date).select("partner_id", "partner_role_tier", "lifetime_shifts")


def cohorted(
    src: Mapping[str, DataFrame], p: FunnelParams, tie: Sequence[str] = TIE, markets: DataFrame | None = None
) -> DataFrame:
    """Active partners of the target markets with their facts and cohort code.

    The market table is written first unless it is given. Its size is then known when the partners
    are joined: Spark broadcasts it below its threshold and does not shuffle the partners by zone.
    Offers need no scope of their own here, for the join keeps partners of the markets only.
    """
    partners = src["partner_throughput"]
    if markets is None:
        markets = materialize(target_markets(src["supply_daily_position"], src["store_crm"], p))
    active = active_since(partners.where(F.col("company_name") == p.company), "last_active_at", p.as_of_ts, p.active_days)
    base = active.drop(
        "priority_cohort_l1", "priority_cohort_l2", "partner_role_tier", "bgc_result", "bgc_adjudication_event",
        "work_shifts_sent_l7d", "work_shifts_accepted_l7d", "work_shifts_sent_next_7d", "work_shifts_seen_next_7d",
    ).join(markets, "zone_description")
    facts = enrich(
        base,
        "partner_id",
        [
            check_facts(src["background_checks"], p.adjudication_from, False, tie),
            offer_counts(src["user_shifts"], p),
            reliability_today(src["partner_reliability"], p),
            completed_shifts(src["shift_assignments"], p),
            non_client_s1c(partners, p).withColumn("s1c_elsewhere", F.lit(True)),
        ],
    )
    return facts.withColumn("bgc_result", F.coalesce("bgc_result_raw", F.lit(rules.bgc.NO_CHECK))).withColumn(
        "cohort", rules.cohort_code(p.as_of_ts)
    )


def cohort_counts(coded: DataFrame) -> DataFrame:
    """Partners per code, in total and per store priority class."""
    return coded.groupBy("cohort").agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("priority_cohort_l2") == l2).alias(name) for name, l2 in dims.L2_COUNT_COLUMNS.items()],
    )


def funnel_summary(coded: DataFrame) -> DataFrame:
    """All 24 cohorts with their counts, zero where no partner is; unclassified partners do not show."""
    skeleton = dims.cohort_dim(coded.sparkSession).select("cohort", "triage_action")
    counts = cohort_counts(coded)
    return zero_fill(skeleton, counts, "cohort", ["total", *dims.L2_COUNT_COLUMNS]).orderBy("cohort")


def funnel_roster(coded: DataFrame, p: FunnelParams) -> DataFrame:
    """One row per active partner with labels and measures."""
    code = F.col("cohort")
    zeroed = [
        F.coalesce(name, F.lit(0)).alias(alias)
        for name, alias in [
            ("work_shifts_sent_l7d", "work_shifts_sent_l7d"),
            ("work_shifts_accepted_l7d", "work_shifts_accepted_l7d"),
            ("work_shifts_sent_next_7d", "work_shifts_sent_next_7d"),
            ("work_shifts_seen_next_7d", "work_shifts_seen_next_7d"),
            ("lifetime_shifts", "lifetime_shifts_worked"),
            ("completed_shifts", "completed_shifts"),
        ]
    ]
    return coded.select(
        "partner_id", "first_name", "last_name", "phone_number", "email", "city", "zone_description",
        F.round("closest_store_proximity_miles", 1).alias("closest_store_miles"),
        F.round("fill_rate_l7d", 3).alias("fill_rate_l7d"),
        F.col("created_date").alias("dl_date"),
        "oa_date", "op_date", "s1a_date", "s1c_date", "m1_date", "last_active_at", "churn_status",
        F.round("churn_probability", 3).alias("churn_probability"),
        "shifts_worked_last_7d", "shifts_assigned_next_7d", "days_since_last_shift_worked",
        "total_shifts_last_4w", "volume_label_current",
        F.round("evfr_score", 3).alias("evfr_score"),
        F.round("pct_shift_success", 3).alias("pct_shift_success"),
        F.col("partner_role_tier").alias("m1_tier"),
        F.coalesce(is_m1_active(F.col("partner_role_tier")), F.lit(False)).alias("is_m1"),
        F.col("bgc_result").alias("bgc_status"),
        "bgc_submitted_at", "bgc_adjudication_event",
        *zeroed,
        rules.cohort_l1(code).alias("cohort_l1"),
        rules.cohort_l2(code, p.as_of_ts).alias("cohort_l2"),
        rules.triage_action(code).alias("triage_action"),
        code.alias("cohort_combo"),
        "priority_cohort_l2",
    ).orderBy("cohort_combo", "fill_rate_l7d", "city", "closest_store_miles", "partner_id")


def roster_view(roster: DataFrame, group: str) -> DataFrame:
    """The rows and columns that matter for one group, emptiest market first."""
    wanted = [*ROSTER_HEAD, *ROSTER_DETAIL[group], *ROSTER_TAIL]
    shown = roster.where(F.col("cohort_l1") == group).select(*[c for c in wanted if c in roster.columns])
    return shown.orderBy("fill_rate_l7d", "partner_id")


def roster_views(roster: DataFrame) -> DataFrame:
    """The views of all seven groups at once: ``cohort_l1``, the head, every detail column of any group (NULL
    where the row's group does not show it) and the tail. Partners of no group are left out."""
    detail = list(dict.fromkeys(c for columns in ROSTER_DETAIL.values() for c in columns))
    group = F.col("cohort_l1")
    shown = [F.when(group.isin([g for g, cols in ROSTER_DETAIL.items() if c in cols]), F.col(c)).alias(c) for c in detail]
    rows = roster.where(group.isin(list(ROSTER_DETAIL)))
    return rows.select("cohort_l1", *ROSTER_HEAD, *shown, *ROSTER_TAIL)


def stored_roster(partners: DataFrame, p: FunnelParams) -> DataFrame:
    """Roster of partners whose cohort is stored with them."""
    rows = active_since(partners.where(F.col("company_name") == p.company), "last_active_at", p.as_of_ts, p.active_days)
    return rows.where(F.col("priority_cohort_l2").isin(dims.ROSTER_L2))


def _roster_columns(rows: DataFrame) -> DataFrame:
    return rows.select(
        "partner_id", "first_name", "last_name", "phone_number", "email",
        F.col("city_description").alias("city"), "zone_description", "closest_store_cluster",
        F.round("closest_store_proximity_miles", 1).alias("closest_store_miles"),
        F.col("created_date").alias("dl_date"), "oa_date", "oa_shift_type", "op_date", "op_shift_type",
        "s1a_date", "s1c_date", "m1_date", "last_active_at", "churn_status",
        F.round("churn_probability", 3).alias("churn_probability"),
        "shifts_worked_last_7d", "shifts_assigned_next_7d", "days_since_last_shift_worked",
        "total_shifts_last_4w", "volume_label_current", "currently_suspended", "currently_deactivated",
        "is_fraud_partner",
        F.round("rolling_l50shifts_reliability_score", 3).alias("reliability_score"),
        F.round("evfr_score", 3).alias("evfr_score"),
        F.round("pct_shift_success", 3).alias("pct_shift_success"),
        "partner_role_tier", is_m1_any(F.col("partner_role_tier")).alias("is_m1"),
        "bgc_result", "bgc_adjudication_event", "work_shifts_sent_l7d", "work_shifts_accepted_l7d",
        "work_shifts_sent_next_7d", "work_shifts_seen_next_7d", "lifetime_ckp_food_shifts",
        F.col("ckp_food_completed_flag").alias("completed_ckp_shifts"),
        "priority_cohort_l1", "priority_cohort_l2", "partner_cohort",
    ).orderBy("partner_cohort", "city", "closest_store_miles", "partner_id")


def funnel_v2(partners: DataFrame, p: FunnelParams) -> DataFrame:
    return _roster_columns(stored_roster(partners, p))


def funnel_v2_overrides(
    partners: DataFrame, certs: DataFrame, overrides: DataFrame, p: FunnelParams, cleared_tag: str = dims.CLEARED_TAG
) -> DataFrame:
    """The same with hand-kept lists: overridden partners failed, cleared ones moved on.

    An empty override list changes nothing. Each list is reduced to its partners, so nobody shows twice.
    """
    rows = flag_exists(stored_roster(partners, p), overrides, "partner_id", "overridden")
    rows = flag_exists(rows, certs.where(F.col("tag") == cleared_tag), "partner_id", "cleared")
    event = rules.override_event(F.col("bgc_adjudication_event"), F.col("overridden"))
    code = rules.override_cohort(
        F.col("partner_cohort"), F.col("overridden"), F.col("cleared"), F.col("work_shifts_sent_next_7d")
    )
    return _roster_columns(rows.withColumns({"bgc_adjudication_event": event, "partner_cohort": code}))


def funnel_kpis(roster: DataFrame, code: str = "partner_cohort", choices: Mapping | None = None) -> DataFrame:
    """One row of pipeline counts; codes outside the dimension count in the total only."""
    group = rules.cohort_l1(F.col(code))
    names = {
        "s1c_assigned": ["S1C, Assigned"],
        "s1c_not_assigned": ["S1C, Not Assigned"],
        "bgc_passed": ["BGC Passed, Not S1C"],
        "op_pending_bgc": ["OP, Not BGC Finalized"],
        "pre_op": ["OA, Not OP", "Not OA"],
    }
    return filter_in(roster, choices or {}).agg(
        F.count("*").alias("total_pipeline"), *[F.count_if(group.isin(g)).alias(n) for n, g in names.items()]
    )


KPI_GROUPS = {
    "s1c_assigned": ["S1C, Assigned"],
    "s1c_not_assigned": ["S1C, Not Assigned"],
    "bgc_passed": ["BGC Passed, Not S1C"],
    "op_pending_bgc": ["OP, Not BGC Finalized"],
    "pre_op": ["OA, Not OP", "Not OA"],
}
CUBE = ("zone_description", "city", "priority_cohort_l2")


def funnel_cube(roster: DataFrame, code: str = "partner_cohort") -> DataFrame:
    """Pipeline counts for every choice of zone, city and L2 class at once (a CUBE of the three).

    ``gid`` tells which of ``CUBE`` are chosen (bit set: that column is rolled up, as ``grouping_id``), so
    a null of the data and "any" stay apart. A filter on several classes is the sum of the rows of those
    classes with the same zone and city choice (``kpis_for``). One shuffle of the cube's rows, which are
    few: partners are combined on the map side.
    """
    group = rules.cohort_l1(F.col(code))
    counts = [F.count(F.lit(1)).alias("total_pipeline"), *[F.count_if(group.isin(g)).alias(n) for n, g in KPI_GROUPS.items()]]
    return roster.cube(*CUBE).agg(F.grouping_id().cast("long").alias("gid"), *counts)


def kpis_for(cube: DataFrame, zone: str | None = None, city: str | None = None, classes: Sequence[str] = ()) -> DataFrame:
    """The one row of ``funnel_kpis`` under the page's filters, summed from ``funnel_cube`` rows."""
    chosen = {"zone_description": zone, "city": city}
    rolled = {"zone_description": zone is None, "city": city is None, "priority_cohort_l2": not classes}
    gid = sum(1 << (len(CUBE) - 1 - i) for i, c in enumerate(CUBE) if rolled[c])
    rows = cube.where(F.col("gid") == gid)
    for column, value in chosen.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    if classes:
        rows = rows.where(F.col("priority_cohort_l2").isin(list(classes)))
    names = ["total_pipeline", *KPI_GROUPS]
    return rows.agg(*[F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(n) for n in names])


def funnel_breakdown(roster: DataFrame, code: str = "partner_cohort", choices: Mapping | None = None) -> DataFrame:
    """Counts and shares per cohort and group.

    The share is of all filtered rows. Codes outside the dimension form no group of their own.
    """
    rows = filter_in(roster, choices or {})
    totals = funnel_rollup(rows, code)
    grand = totals.where(F.col("level") == 3)
    known = totals.where((F.col("level") == 3) | F.col("l1_group").isin(dims.GROUP_ORDER))
    labelled = known.withColumns(
        {
            "cohort_label": rules.lookup(F.col("cohort"), dims.LABEL_OF),
            "triage_action": rules.lookup(F.col("cohort"), dims.ACTION_OF),
        }
    )
    return pct_of_total(labelled, "partners", grand).orderBy("level", "l1_group", "cohort")
