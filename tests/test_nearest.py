"""Nearest-k against brute force, on points that are hard for a grid."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from crewline.functions.geo import EARTH_METERS, MILE_METERS
from crewline.operators.nearest import nearest_k

COMPANIES = ["A", "B", "C", "D"]


def miles(a, b):
    lat1, lng1, lat2, lng2 = map(math.radians, (*a, *b))
    h = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin((lng2 - lng1) / 2) ** 2
    return round(2 * EARTH_METERS * math.asin(min(1.0, math.sqrt(h))) / MILE_METERS * 10 + 1e-9) / 10


def fixture(seed):
    rng = random.Random(seed)

    def near(lat, lng, spread):
        return (max(-90.0, min(90.0, lat + rng.uniform(-spread, spread))), (lng + rng.uniform(-spread, spread) + 180) % 360 - 180)

    centres = [(40.7, -74.0), (0.0, 180.0), (89.9, 10.0), (-89.95, -60.0), (-33.9, 151.2), (0.01, 0.01)]
    points = [near(*c, spread) for c in centres for spread in (0.02, 0.5, 4) for _ in range(6)]
    points += [(40.7, -74.0)] * 40 + [(90.0, 0.0), (-90.0, 0.0), (0.0, -180.0), (0.0, 180.0)]
    stores = [("A", *near(*c, spread)) for c in centres for spread in (0.05, 0.4, 2) for _ in range(12)]
    stores += [("A", 40.71, -74.01)] * 30  # one spot with many stores
    stores += [("B", *near(40.7, -74.0, 0.3)) for _ in range(60)]
    stores += [("C", 10.0, 10.0), ("C", 10.0, 10.0), ("C", -60.0, 170.0)]  # fewer than k
    stores = [(c, f"{i:04d}", lat, lng) for i, (c, lat, lng) in enumerate(stores)]
    return points, stores


@pytest.mark.parametrize("k,radius", [(5, 25.0), (2, 300.0)])
def test_same_as_brute_force(spark, k, radius):
    points, stores = fixture(7)
    p = spark.createDataFrame([(i, *xy) for i, xy in enumerate(points)] + [(-1, None, 5.0)], "id int, lat double, lng double")
    s = spark.createDataFrame(stores + [("A", "none", None, 1.0)], "company_name string, store_number string, lat double, lng double")
    rows = nearest_k(p, s, COMPANIES, k, radius).collect()
    got = {(r.id, r.company_name, r["rank"]): (r.store_number, r.distance_miles, r.stores_within_radius, r.total_active_stores) for r in rows}
    want = {}
    for i, xy in enumerate(points):
        for company in COMPANIES:
            ranked = sorted((miles(xy, (lat, lng)), number) for c, number, lat, lng in stores if c == company)
            within = sum(d <= radius for d, _ in ranked)
            for rank, (d, number) in enumerate(ranked[:k], 1):
                want[i, company, rank] = (number, d, within, len(ranked))
    assert len(rows) == len(got)
    assert got == want


def test_no_all_pairs_join_and_no_python(spark):
    points, stores = fixture(1)
    p = spark.createDataFrame([(i, *xy) for i, xy in enumerate(points)], "id int, lat double, lng double")
    s = spark.createDataFrame(stores, "company_name string, store_number string, lat double, lng double")
    plan = nearest_k(p, s, COMPANIES)._jdf.queryExecution().executedPlan().toString()
    for banned in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python"):
        assert banned not in plan


def test_plan_does_not_depend_on_the_data(spark):
    """A crowded block does not change the plan, and no row comes to the driver while it is built."""
    def shape(stores):
        p = spark.createDataFrame([(i, 40 + i / 100, -74.0) for i in range(50)], "id int, lat double, lng double")
        s = spark.createDataFrame(stores, "company_name string, store_number string, lat double, lng double")
        plan = nearest_k(p, s, ["A"])._jdf.queryExecution().sparkPlan().toString()
        return re.findall(r"^[ :+\-]*(?:\*\(\d+\) )?(\w+)", plan, re.M)

    spread = [("A", f"{i}", 40 + i / 10, -74.0) for i in range(80)]
    crowded = spread + [("A", f"c{i}", 40.00001 + i / 1e7, -74.0) for i in range(200)]
    assert shape(spread) == shape(crowded)


def test_city_block_is_counted_as_a_block(spark):
    """Many stores and points in one cell: far fewer pairs meet than there are."""
    rng = random.Random(3)
    stores = [("A", f"{i:05d}", 40 + rng.uniform(0, 0.1), -74 + rng.uniform(0, 0.1)) for i in range(2000)]
    points = [(i, 40 + rng.uniform(0, 0.1), -74 + rng.uniform(0, 0.1)) for i in range(300)]
    p = spark.createDataFrame(points, "id int, lat double, lng double")
    s = spark.createDataFrame(stores, "company_name string, store_number string, lat double, lng double")
    out = nearest_k(p, s, ["A"], k=5, radius=25.0)
    assert out.where(F.col("stores_within_radius") != 2000).count() == 0
    assert out.count() == 1500
