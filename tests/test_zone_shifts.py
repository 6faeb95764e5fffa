"""Shifts of every zone at once: a zone look-up on the written rows equals the plan of that zone."""

from pyspark.sql import functions as F

from crewline.plans import shifts
from crewline.sources.sinks import materialize
from registry.relational import FIRST, LAST


def test_a_zone_lookup_equals_the_zone_plan(spark, staged):
    supply = staged.supply_daily_position
    rows = shifts.shift_filter(staged.shift_assignments, "BUILDING", FIRST, LAST)
    bridge = shifts.zone_bridge(supply)
    written = materialize(shifts.market_shifts(shifts.zoned_shifts(rows, bridge, salt=4), "zone_description").repartitionByRange("zone_description"))
    zones = [r[0] for r in supply.where("company_name = 'BUILDING'").select("zone_description").distinct().collect() if r[0] is not None]
    assert len(zones) > 1
    for zone in zones:
        got = written.where(F.col("zone_description") == zone).drop("zone_description")
        want = shifts.market_shifts(shifts.shift_filter(staged.shift_assignments, "BUILDING", FIRST, LAST, zone=zone, supply=supply))
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0, zone
    # A shift whose cluster is under two zones is under both.
    per_cluster = bridge.where("company_name = 'BUILDING'").groupBy("store_cluster").count().where("count > 1").count()
    if per_cluster:
        assert written.groupBy("shift_id", "partner_id").agg(F.countDistinct("zone_description").alias("z")).where("z > 1").count() > 0
