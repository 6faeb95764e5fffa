"""Distinct counts from bitmaps equal countDistinct under every filter."""

from pyspark.sql import functions as F

from crewline.operators import bitmaps
from crewline.plans import shifts


def test_every_status_choice_per_zone_and_day(spark, staged):
    rows = shifts.market_shifts(staged.shift_assignments)
    rows = rows.unionByName(rows.limit(3).withColumn("partner_id", F.lit(None).cast("string")))  # nulls are not counted
    numbered = bitmaps.numbers(rows, "partner_id")
    bits = bitmaps.bitmaps(rows, ["zone", "shift_date", "completion_status"], "partner_id", numbered)
    statuses = [r[0] for r in rows.select("completion_status").distinct().collect()]
    table = spark.createDataFrame(list(bitmaps.choices(sorted(statuses))), "filter string, completion_status string")
    got = bitmaps.distinct_count(bits.join(table, "completion_status"), ["filter", "zone"], "n")
    want = rows.join(table, "completion_status").groupBy("filter", "zone").agg(F.countDistinct("partner_id").alias("n"))
    want = want.where("n > 0")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    # Days merge by OR: a range of days needs no pass over the rows.
    week = bits.where(F.col("shift_date") >= F.date_sub(F.lit("2024-01-31").cast("date"), 7))
    once = bitmaps.distinct_count(week).first()["n"] or 0
    plain = rows.where(F.col("shift_date") >= F.date_sub(F.lit("2024-01-31").cast("date"), 7)).select(F.countDistinct("partner_id")).first()[0]
    assert once == plain


def test_no_rows(spark):
    rows = spark.createDataFrame([], "completion_status string, partner_id string, store_number string")
    assert bitmaps.under_filters(rows, "completion_status", ("Completed", "Assigned"), {"n": "partner_id"}).count() == 0
