"""Snapshot sources partitioned by day: the day filters reach the scan as partition filters."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from crewline.operators import filters
from crewline.sources import schemas
from crewline.sources.warehouse import Warehouse
from registry.core import P


def _formatted(df) -> str:
    """The formatted plan, as ``explain("formatted")`` prints it."""
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.fixture(scope="module")
def partitioned(spark, staged, tmp_path_factory):
    """supply_daily_position by ``date`` and partner_reliability by ``ds``, with a second position on a later day."""
    base = str(tmp_path_factory.mktemp("snapshots"))
    plain = str(tmp_path_factory.mktemp("plain"))
    for name, day in (("supply_daily_position", "date"), ("partner_reliability", "ds")):
        back = {new: old for old, new in schemas.renames(name).items()}
        df = staged[name].select(*schemas.mart_schema(name).names).withColumnsRenamed(back)
        if name == "supply_daily_position":
            last = df.agg(F.max("date")).first()[0]
            later = df.where(F.col("date") == last).withColumns({"position": F.lit("Lead"), "date": F.date_add("date", 2)})
            earlier = df.where(F.col("date") == last).withColumns({"date": F.date_sub("date", 30)})
            df = df.unionByName(later).unionByName(earlier)
        else:
            df = df.unionByName(df.withColumn("ds", F.date_sub("ds", 1))).unionByName(df.withColumn("ds", F.date_sub("ds", 2)))
        df.write.partitionBy(day).parquet(f"{base}/{name}")
        df.write.parquet(f"{plain}/{name}")
    return Warehouse(spark, base), Warehouse(spark, plain)


def _same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_a_day_range_is_a_partition_filter(partitioned):
    split, plain = partitioned
    week = filters.at_snapshot(split["supply_daily_position"], "date", P.day(-7), P.day(-1))
    plan = _formatted(week)
    scan = plan[plan.index("Scan parquet") :]
    assert "PartitionFilters: [isnotnull(date" in scan and "date#" in scan.split("PartitionFilters:")[1].split("\n")[0]
    assert _same(week, filters.at_snapshot(plain["supply_daily_position"], "date", P.day(-7), P.day(-1)))
    day = filters.at_snapshot(split["partner_reliability"], "ds", P.as_of_date)
    assert "PartitionFilters: [isnotnull(ds" in _formatted(day)
    assert _same(day, filters.at_snapshot(plain["partner_reliability"], "ds", P.as_of_date))


def test_the_latest_day_prunes_at_run_time(partitioned):
    split, plain = partitioned
    preds = (F.col("company_name") == "BUILDING", F.col("position") == "All")
    rows = filters.latest_snapshot(split["supply_daily_position"], "date", *preds)
    partition_filters = [line for line in _formatted(rows).splitlines() if line.startswith("PartitionFilters:")]
    assert any("date#" in line and "subquery" in line.lower() for line in partition_filters), partition_filters
    assert _same(rows, filters.latest_snapshot(plain["supply_daily_position"], "date", *preds))
    # The second position lies two days later; the predicate keeps it out of the latest day.
    days = {r.date for r in rows.select("date").distinct().collect()}
    lead = {r.date for r in split["supply_daily_position"].where("position = 'Lead'").select("date").distinct().collect()}
    assert len(days) == 1 and days.isdisjoint(lead) and max(lead) > max(days)
