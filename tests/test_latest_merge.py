"""The latest row per key kept up day by day equals the latest row over all events so far."""

from pyspark.sql import functions as F

from crewline.operators import latest
from registry.core import EVENT_TIE


def test_day_by_day_equals_from_scratch(spark, staged):
    rows = staged.background_checks.select("partner_id", "event_id", "result", "event", "updated_at")
    # Arrival day: most events arrive on their own day, every seventh three days late, every ninth twice.
    arrival = F.date_add(F.to_date("updated_at"), F.when(F.abs(F.hash("event_id")) % 7 == 0, 3).otherwise(0))
    events = rows.withColumn("arrived", arrival)
    events = events.unionByName(events.where(F.abs(F.hash("event_id")) % 9 == 0).withColumn("arrived", F.date_add("arrived", 1)))
    events = events.unionByName(spark.createDataFrame([(None, -1, "clear", "x", None, None)], events.schema))
    days = sorted(r.arrived for r in events.select("arrived").distinct().where("arrived IS NOT NULL").collect())
    assert len(days) > 5
    state = spark.createDataFrame([], rows.schema)
    for day in days[:-1] + [None]:
        today = events.where(F.col("arrived") == day) if day else events.where(F.col("arrived").isNull() | (F.col("arrived") == days[-1]))
        # The state of each day is made again from its rows, as a written table would be.
        merged = latest.merge_latest(state, today.drop("arrived"), ["partner_id"], "updated_at", EVENT_TIE)
        state = spark.createDataFrame(merged.collect(), rows.schema)
        so_far = events.where(F.col("arrived") <= day) if day else events
        scratch = latest.latest_per_key(so_far.drop("arrived"), ["partner_id"], "updated_at", EVENT_TIE)
        assert sorted(map(tuple, state.collect()), key=str) == sorted(map(tuple, scratch.collect()), key=str), day
    assert state.where("partner_id IS NULL").count() == 1


def test_state_is_not_shuffled(spark, staged):
    rows = staged.background_checks.select("partner_id", "event_id", "result", "updated_at")
    state = latest.latest_per_key(rows, ["partner_id"], "updated_at", EVENT_TIE)
    day = rows.limit(5)
    plan = latest.merge_latest(state, day, ["partner_id"], "updated_at", EVENT_TIE)
    text = spark._jvm.PythonSQLUtils.explainString(plan._jdf.queryExecution(), "simple")
    assert "LeftSemi" in text and "LeftAnti" in text
