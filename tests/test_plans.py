"""Physical plans are the ones we want at scale."""

import re

import pytest

from conftest import SMALL
from registry import marts, relational, scalars  # noqa: F401
from registry.core import QUERIES
from registry.staging import Staged


def plan_of(spark, name):
    return QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["latest_per_key", "latest_after_filter", "dedup_latest", "top_k_per_group", "current_record", "bgc_latest"])
def test_group_limit_runs_before_the_shuffle(spark, name):
    plan = plan_of(spark, name)
    assert re.search(r"WindowGroupLimit.*Partial", plan) and re.search(r"WindowGroupLimit.*Final", plan)


@pytest.mark.parametrize("name", ["scope", "semi_in", "shift_dispatch"])
def test_scopes_stay_semi_joins(spark, name):
    assert "LeftSemi" in plan_of(spark, name)


@pytest.mark.parametrize("name", ["top_n", "first_record"])
def test_sort_with_limit_keeps_n_rows_per_task(spark, name):
    assert "TakeOrderedAndProject" in plan_of(spark, name)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_and_no_all_pairs(spark, name):
    plan = plan_of(spark, name)
    for banned in ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert banned not in plan, banned


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(spark, "in_window")
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in plan
    assert "IsNotNull(o_orderdate)" in plan


def test_markets_are_broadcast_by_their_written_size(spark):
    plan = plan_of(spark, "cohort_code")
    assert re.search(r"BroadcastHashJoin \[zone_description", plan)


def test_calendar_cells_are_not_shuffled(spark):
    plan = plan_of(spark, "assignment_calendar")
    above = plan.split("Exchange")[0]
    assert above.count("Generate explode") == 2 and "Join" not in above


def test_facts_are_merged_at_any_size_and_customers_meet_the_orders(spark):
    # At this scale orders would be broadcast; a switch to a shuffle at a larger one is growth beyond that of the tables.
    for name in ("nested_projection", "top_n"):
        plan = plan_of(spark, name)
        assert re.search(r"SortMergeJoin \[l_orderkey#\d+L\], \[o_orderkey#\d+L\]", plan), name
        assert plan.index("SortMergeJoin") < plan.index("HashJoin [o_custkey"), name


def test_supply_positions_are_counted_once(spark):
    staged = Staged(spark, SMALL)
    plan = staged.supply_daily_position._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "Join" not in plan and "lineitem" not in plan
    peaks = relational.zones.zone_peaks(staged.supply_daily_position, None)
    assert "lineitem" not in peaks._jdf.queryExecution().executedPlan().toString()
