"""Partner tables bucketed by the partner key: the funnel meets its facts without shuffling them."""

import re

import pytest
from pyspark.sql import functions as F

from crewline.plans import funnel
from crewline.sources import schemas, tables
from crewline.sources.dimensions import ROSTER_L2
from crewline.sources.warehouse import Warehouse
from registry.core import P


@pytest.fixture(scope="module")
def bucketed(spark, staged, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("raw"))
    for name in schemas.TABLES:
        if name == "bgc_override":
            continue
        back = {new: old for old, new in schemas.renames(name).items()}
        df = staged[name].select(*schemas.mart_schema(name).names).withColumnsRenamed(back)
        if name == "partner_throughput":
            df = df.withColumns({"partner_cohort": F.lit("16_oa_not_op"), "priority_cohort_l2": F.lit(ROSTER_L2[0])})
        df.write.parquet(f"{base}/{name}")
    place = str(tmp_path_factory.mktemp("catalog"))
    spark.sql(f"CREATE DATABASE IF NOT EXISTS bucketed LOCATION '{place}'")
    tables.save_bucketed(spark, base, "bucketed", 8)
    return Warehouse(spark, base), Warehouse(spark, database="bucketed")


def _partner_exchanges(df) -> int:
    plan = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return len(re.findall(r"Exchange\n.*\nArguments: hashpartitioning\(partner_id", plan)) + plan.count("hashpartitioning(partner_id")


def test_funnel_joins_without_exchange(spark, bucketed):
    plain, cat = bucketed
    assert _partner_exchanges(funnel.cohorted(plain, P)) > 0
    coded = funnel.cohorted(cat, P)
    assert _partner_exchanges(coded) == 0
    one, two = funnel.cohorted(plain, P), coded
    assert one.exceptAll(two).count() == 0 and two.exceptAll(one).count() == 0


def test_partner_columns():
    assert tables.partner_column("background_checks") == "userId"
    assert tables.partner_column("partner_throughput") == "partner_id"
    assert tables.partner_column("store_crm") is None
