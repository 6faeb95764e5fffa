"""All marts are written from declared source tables and can be written again."""

import dataclasses
import os
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from crewline.plans import zones
from crewline.refresh import Publisher, marts, refresh
from crewline.sources import schemas, sinks
from crewline.sources.dimensions import ROSTER_L2
from crewline.sources.warehouse import Warehouse
from registry.core import COMPANIES, P


@pytest.fixture(scope="module")
def warehouse(spark, staged, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("raw"))
    for name in schemas.TABLES:
        if name == "bgc_override":
            continue  # the optional source is absent
        back = {new: old for old, new in schemas.renames(name).items()}
        df = staged[name].select(*schemas.mart_schema(name).names).withColumnsRenamed(back)
        if name == "partner_throughput":
            df = df.withColumns({"partner_cohort": F.lit("16_oa_not_op"), "priority_cohort_l2": F.lit(ROSTER_L2[0])})
        df.write.parquet(f"{base}/{name}")
    return Warehouse(spark, base)


def test_refresh_writes_every_mart_and_replaces_one_day(spark, warehouse, tmp_path, monkeypatch):
    out = str(tmp_path)
    p = dataclasses.replace(P, as_of_ts=datetime(2024, 1, 31, 6))
    calls = []
    monkeypatch.setattr(zones, "zone_list", lambda *a, _z=zones.zone_list: calls.append(1) or _z(*a))
    publisher = Publisher(spark, out, p)
    builders = marts(warehouse, p, COMPANIES, publish=publisher)
    refresh(builders, p, out, publisher=publisher)
    assert sorted(publisher.published) == sorted(builders)  # every mart written once
    assert len(calls) == 1  # the zone lists are saved from the written mart
    sizes = {name: spark.read.parquet(f"{out}/{name}").count() for name in builders}
    assert all(sizes.values()), sizes
    later = dataclasses.replace(p, as_of_date=date(2024, 2, 1), as_of_ts=datetime(2024, 2, 1, 6))
    for day in (later, later, p):
        refresh(marts(warehouse, day, COMPANIES), day, out, ["bgc_status", "zone_list"])
    both = spark.read.parquet(f"{out}/bgc_status")
    assert {(str(r.as_of), r["count"]) for r in both.groupBy("as_of").count().collect()} == {
        ("2024-01-31", sizes["bgc_status"]),
        ("2024-02-01", sizes["bgc_status"]),
    }


def test_two_companies_on_one_day_and_old_shifts(spark, warehouse, staged, tmp_path):
    out = str(tmp_path)
    for company in ("BUILDING", "FURNITURE"):
        p = dataclasses.replace(P, company=company, as_of_ts=datetime(2024, 1, 31, 6))
        refresh(marts(warehouse, p, COMPANIES), p, out, ["zone_kpis", "zone_summary", "store_summary", "target_markets", "zone_list", "shift_detail"])
    for name in ("zone_kpis", "zone_summary", "store_summary", "target_markets", "zone_list"):
        companies = {r.company for r in spark.read.parquet(f"{out}/{name}").select("company").distinct().collect()}
        assert companies >= {"BUILDING", "FURNITURE"}, name
    for company in COMPANIES:
        assert sinks.load_zones(spark, f"{out}/saved_zones", company) is not None
    every = spark.read.parquet(f"{out}/shift_detail")
    assert every.count() == staged.shift_assignments.count()
    assert every.where("shift_date < DATE '2023-07-01'").count() > 0


def test_scratch_is_deleted_and_lookups_skip_files(spark, warehouse, tmp_path, monkeypatch):
    # The folders this test takes, by name: other sessions on the machine may use the shared folder meanwhile.
    import uuid

    from crewline import session

    taken = []

    class Names:
        @staticmethod
        def uuid4():
            name = uuid.uuid4()
            taken.append(name.hex)
            return name

    monkeypatch.setattr(session, "uuid", Names)
    base = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    p = dataclasses.replace(P, as_of_ts=datetime(2024, 1, 31, 6))
    refresh(marts(warehouse, p, COMPANIES), p, str(tmp_path), ["shifts_sent", "nearest_stores"])
    with pytest.raises(ZeroDivisionError):
        refresh({"broken": lambda: sinks.materialize(spark.range(1)).withColumn("x", F.lit(1 / 0))}, p, str(tmp_path))
    assert taken and not [name for name in taken if os.path.exists(f"{base.rstrip('/')}/{name}")]
    files = spark.read.parquet(f"{tmp_path}/shifts_sent").groupBy(F.input_file_name()).agg(F.min("partner_id").alias("lo"), F.max("partner_id").alias("hi"))
    ranges = sorted((r.lo, r.hi) for r in files.collect())
    assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:]))


def test_same_results_as_from_staging(warehouse, staged):
    from crewline.plans import checks

    one = checks.bgc_status(warehouse["background_checks"], P.adjudication_from)
    two = checks.bgc_status(staged["background_checks"], P.adjudication_from)
    assert one.exceptAll(two).count() == two.exceptAll(one).count() == 0


def test_warehouse_names(spark, warehouse):
    assert set(warehouse) == set(schemas.TABLES)
    assert warehouse["bgc_override"].count() == 0
    with pytest.raises(KeyError):
        warehouse["other"]
    with pytest.raises(ValueError):
        Warehouse(spark)


def test_an_empty_rerun_leaves_no_rows(spark, warehouse, tmp_path):
    out = str(tmp_path)
    p = dataclasses.replace(P, as_of_ts=datetime(2024, 1, 31, 6))
    later = dataclasses.replace(p, as_of_date=date(2024, 2, 1), as_of_ts=datetime(2024, 2, 1, 6))
    for day in (p, later):
        refresh(marts(warehouse, day, COMPANIES), day, out, ["bgc_status", "zone_summary"])
    full = marts(warehouse, p, COMPANIES)
    empty = {name: (lambda b=full[name]: b().limit(0)) for name in ("bgc_status", "zone_summary")}
    refresh(empty, p, out)
    for name in empty:
        table = spark.read.parquet(f"{out}/{name}")
        days = {str(r.as_of): r["count"] for r in table.groupBy("as_of").count().collect()}
        assert "2024-01-31" not in days and days["2024-02-01"] > 0, (name, days)
        data = [c for c in spark.read.parquet(f"{out}/{name}/as_of=2024-02-01").columns if c != "company"]
        assert [c for c in table.columns if c not in ("as_of", "company")] == data
    assert not [f for f in os.listdir(f"{out}/_staging")]  # staging folders are moved, none is left


def _row_groups(spark, folder, column, value):
    """Row groups that a Parquet reader with statistics, dictionary and bloom filters still reads."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    api = jvm.org.apache.parquet.filter2.predicate.FilterApi
    wanted = jvm.org.apache.parquet.filter2.compat.FilterCompat.get(api.eq(api.binaryColumn(column), jvm.org.apache.parquet.io.api.Binary.fromString(value)))
    options = jvm.org.apache.parquet.HadoopReadOptions.builder(conf).withRecordFilter(wanted).useStatsFilter(True).useDictionaryFilter(True).useBloomFilter(True).build()
    read = total = 0
    for name in sorted(os.listdir(folder)):
        if name.endswith(".parquet"):
            place = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
            for use, count in ((options, "read"), (jvm.org.apache.parquet.HadoopReadOptions.builder(conf).build(), "total")):
                reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(place, conf), use)
                n = reader.getRowGroups().size()
                reader.close()
                read, total = (read + n, total) if count == "read" else (read, total + n)
    return read, total


def test_a_shift_lookup_reads_one_row_group(spark, warehouse, staged, tmp_path):
    out = str(tmp_path)
    p = dataclasses.replace(P, as_of_ts=datetime(2024, 1, 31, 6))
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("parquet.block.size", str(16 * 1024))
    try:
        refresh(marts(warehouse, p, COMPANIES), p, out, ["shift_detail", "market_shifts"])
    finally:
        conf.unset("parquet.block.size")
    folder = f"{out}/shift_detail/as_of=2024-01-31"
    ids = sorted(r.shift_id for r in staged.shift_assignments.select("shift_id").distinct().collect())
    for shift in ids[:: max(1, len(ids) // 5)]:
        read, total = _row_groups(spark, folder, "shift_id", shift)
        assert total > 4 and read == 1, (shift, read, total)
    # Inside the range of a row group, an id that is not there is ruled out by the bloom filter.
    absent = ids[len(ids) // 2] + "~"
    assert _row_groups(spark, folder, "shift_id", absent)[0] == 0
    one = spark.read.parquet(f"{out}/shift_detail").where(F.col("shift_id") == ids[0])
    assert one.count() == staged.shift_assignments.where(F.col("shift_id") == ids[0]).count()
    stores = spark.read.parquet(f"{out}/market_shifts/as_of=2024-01-31").select("store_number").where("store_number IS NOT NULL").first()
    if stores is not None:
        read, total = _row_groups(spark, f"{out}/market_shifts/as_of=2024-01-31", "store_number", stores.store_number)
        assert read >= 1 and (total == 1 or read < total), (read, total)
