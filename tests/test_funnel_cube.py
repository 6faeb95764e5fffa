"""Funnel KPIs summed from the cube equal the KPIs of the filtered roster, for every choice of the page."""

from itertools import combinations

from pyspark.sql import functions as F

from crewline.plans import funnel
from registry.core import P
from registry.marts import _stored


def test_every_choice_equals_filtering_first(spark, staged):
    roster = funnel.funnel_v2_overrides(_stored(staged), staged.user_certs, staged.bgc_override, P, cleared_tag="tag_2")
    roster = roster.unionByName(roster.limit(2).withColumns({"zone_description": F.lit(None).cast("string"), "city": F.lit(None).cast("string")}))
    roster = spark.createDataFrame(roster.collect(), roster.schema)
    cube = funnel.funnel_cube(roster)
    cube = spark.createDataFrame(cube.collect(), cube.schema)
    zones = [None] + [r[0] for r in roster.select("zone_description").distinct().where("zone_description IS NOT NULL").limit(3).collect()]
    cities = [None] + [r[0] for r in roster.select("city").distinct().where("city IS NOT NULL").limit(3).collect()]
    classes = sorted(r[0] for r in roster.select("priority_cohort_l2").distinct().where("priority_cohort_l2 IS NOT NULL").collect())
    choices = [()] + [c for n in (1, 2) for c in combinations(classes[:4], n)]
    for zone in zones:
        for city in cities:
            for chosen in choices:
                got = funnel.kpis_for(cube, zone, city, chosen).first().asDict()
                rows = roster
                if zone is not None:
                    rows = rows.where(F.col("zone_description") == zone)
                if city is not None:
                    rows = rows.where(F.col("city") == city)
                want = funnel.funnel_kpis(rows, choices={"priority_cohort_l2": list(chosen)}).first().asDict()
                assert got == {k: v or 0 for k, v in want.items()}, (zone, city, chosen)
