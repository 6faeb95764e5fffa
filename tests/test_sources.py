"""Scans, optional sources and sinks."""

from datetime import datetime

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from crewline.session import shared_dir
from crewline.sources import schemas, sinks, tables


@pytest.mark.parametrize("name", sorted(schemas.TABLES))
def test_declared_tables_round_trip(spark, tmp_path, name):
    path = str(tmp_path / name)
    spark.createDataFrame([], schemas.source_schema(name)).write.parquet(path)
    assert tables.read(spark, name, path).schema.names == schemas.mart_schema(name).names


@pytest.mark.parametrize("change, problem", [
    (lambda d: d.drop("shift_title"), "shift_title is missing"),
    (lambda d: d.withColumnRenamed("partner_id", "worker"), "partner_id is missing"),
    (lambda d: d.withColumn("shift_date", F.col("shift_date").cast("string")), "shift_date is string"),
    (lambda d: d.withColumn("payment", F.col("payment").dropFields("total_amount")), "payment.total_amount is missing"),
])
def test_files_that_differ_fail_early(spark, tmp_path, change, problem):
    changed = change(spark.createDataFrame([], schemas.source_schema("shift_assignments")))
    changed.write.parquet(str(tmp_path / "a"))
    changed.createOrReplaceTempView("changed_assignments")
    with pytest.raises(ValueError, match=problem):
        tables.read(spark, "shift_assignments", str(tmp_path / "a"))
    with pytest.raises(ValueError, match=problem):
        tables.read_table(spark, "shift_assignments", "changed_assignments")


def test_only_asked_columns_are_read(spark, tmp_path):
    path = str(tmp_path / "a")
    spark.createDataFrame([], schemas.source_schema("shift_assignments")).write.parquet(path)
    df = tables.read(spark, "shift_assignments", path, ["partner_id", "payment.total_amount"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<partner_id:string,payment:struct<total_amount:decimal(12,2)>>" in plan


def test_catalog_table_is_checked(spark):
    spark.createDataFrame([("z", "1")], "zone_desc string, store_num string").createOrReplaceTempView("crm_narrow")
    with pytest.raises(ValueError, match="priority_cohort_l1"):
        tables.read_table(spark, "store_crm", "crm_narrow")
    spark.createDataFrame([], schemas.source_schema("user_certs")).createOrReplaceTempView("certs_full")
    assert "partner_id" in tables.read_table(spark, "user_certs", "certs_full").columns


def test_optional_source(spark, tmp_path):
    schema = "partner_id string"
    assert tables.with_optional(spark, str(tmp_path / "absent"), schema).count() == 0
    spark.createDataFrame([("p",)], schema).write.parquet(str(tmp_path / "there"))
    assert tables.with_optional(spark, str(tmp_path / "there"), schema).count() == 1
    with pytest.raises(AnalysisException):
        tables.with_optional(spark, "nosuchscheme://x/y", "broken schema here(")


def test_zone_lists_are_replaced_per_company(spark, tmp_path):
    path = str(tmp_path / "zones")
    assert sinks.load_zones(spark, path, "A") is None

    def zones(*rows):
        return spark.createDataFrame(rows, "company string, label string, value string")

    sinks.save_zones(zones(("A", "C | z1", "z1"), ("B", "C | z2", "z2")), path, datetime(2024, 1, 1))
    sinks.save_zones(zones(("A", "C | z3", "z3")), path, datetime(2024, 1, 2))
    assert [(r.value, r.updated_at) for r in sinks.load_zones(spark, path, "A").collect()] == [("z3", datetime(2024, 1, 2))]
    assert [r.value for r in sinks.load_zones(spark, path, "B").collect()] == ["z2"]
    assert sinks.load_zones(spark, path, "C") is None
    sinks.save_zones(zones(("D", None, "z4")), path, datetime(2024, 1, 2))  # no labels: an old list
    assert sinks.load_zones(spark, path, "D") is None


def test_csv_has_a_header(spark, tmp_path):
    path = str(tmp_path / "csv")
    sinks.export_csv(spark.createDataFrame([("a, b", 1), (None, 2)], "x string, y bigint").orderBy("y"), path)
    back = spark.read.option("header", True).schema("x string, y bigint").csv(path)
    assert sorted(back.collect(), key=lambda r: r.y) == [("a, b", 1), (None, 2)]


def test_materialized_copy_does_not_recompute(spark):
    once = sinks.materialize(spark.range(5).withColumn("r", F.rand()))
    assert once.collect() == once.collect()
    assert "FileScan" in once._jdf.queryExecution().executedPlan().toString()


def test_shared_folder_follows_the_session(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    first, second = shared_dir(spark), shared_dir(spark)
    assert first.startswith(base) and second.startswith(base) and first != second
