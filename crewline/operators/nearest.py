"""Exact nearest-k and within-radius counts between two point sets.

Both sets are cut by nested latitude / longitude grids. From the coarsest grid down, pairs of
occupied cells are kept only while they can matter: for the k nearest (a cell no nearer than k
stores for certain is dropped) or for the radius (cells wholly inside are counted as a block, cells
wholly outside are dropped). Single points meet only in what is left after the finest grid, so
neither a dense city nor many points in one cell multiplies into all pairs. The grids, and so the plan, are
the same for all data. Points with equal coordinates are folded before and unfolded at the end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from crewline.functions.geo import EARTH_MILES, distance_miles
from crewline.operators.latest import top_k_per_group
from crewline.sources.sinks import materialize

FINEST = 8192  # cells per degree
# Cell widths: 4 degrees, 1/4, 1/32 (about 2 miles) and 1/512 degree (about 700 feet).
SHIFTS = (15, 11, 8, 4)
# Stores that round to the same 0.1 mile are up to that far apart.
SLACK = 0.101


def _cell(shift: int) -> str:
    """Grid cell of a point as one number; ``part`` (the company) stands above it."""
    return f"shiftleft(part, 44) + shiftleft(shiftright(row, {shift}), 22) + shiftright(col, {shift})"


def _gridded(df: DataFrame, part: Column | None = None) -> DataFrame:
    places = {"row": f"(lat + 90) * {FINEST}", "col": f"(lng + 180) * {FINEST}"}
    df = df.withColumn("part", (F.lit(0) if part is None else part).cast("long"))
    return df.withColumns({name: F.floor(F.expr(text)) for name, text in places.items()})


def _cells(points: DataFrame, name: str, shift: int, up: int | None) -> DataFrame:
    """Occupied cells of one grid: id, id of the cell above, centre as a unit vector, reach, points."""
    above = "0L" if up is None else f"max({_cell(up)})"
    boxes = points.groupBy(F.expr(_cell(shift)).alias(name)).agg(
        F.expr(f"{above} AS {name}_up"), F.expr("max(part) AS part"), F.expr("sum(n) AS n"),
        F.expr("min(lat) AS south"), F.expr("max(lat) AS north"), F.expr("min(lng) AS west"), F.expr("max(lng) AS east"),
    )
    # From the centre any point is reached along a meridian and then along a parallel; a parallel is
    # longest at the latitude nearest to the equator.
    widest = "CASE WHEN south * north > 0 THEN cos(radians(least(abs(south), abs(north)))) ELSE 1 END"
    lat, lng = "radians((south + north) / 2)", "radians((west + east) / 2)"
    return boxes.selectExpr(
        name, f"{name}_up", f"part AS {name}_part", f"n AS {name}_n",
        f"cos({lat}) * cos({lng}) AS {name}_x", f"cos({lat}) * sin({lng}) AS {name}_y", f"sin({lat}) AS {name}_z",
        f"{EARTH_MILES} * radians((north - south) / 2 + {widest} * (east - west) / 2) AS {name}_reach",
    )


def _bounded(pairs: DataFrame, k: int, radius: float) -> DataFrame:
    """Count whole cells inside the radius, drop what is settled, keep the rest open."""
    half_chord = "sqrt(greatest(0D, (1 - q_x * s_x - q_y * s_y - q_z * s_z) / 2))"
    apart, reach = f"{2 * EARTH_MILES} * asin(least({half_chord}, 1D))", "(q_reach + s_reach)"
    may_count = f"for_count AND lo <= {radius + SLACK}"
    may_near = f"for_nearest AND (limit IS NULL OR lo <= limit + {SLACK})"
    inside = f"for_count AND hi < {radius}"
    pairs = pairs.selectExpr("q", "s", "s_part", "s_n", "for_count", "for_nearest", "counted", "limit", f"{apart} AS apart", f"{reach} AS reach")
    pairs = pairs.selectExpr("* EXCEPT (apart, reach)", "apart - reach AS lo", "apart + reach AS hi")
    # What the grid above already rules out does not reach the shuffle.
    pairs = pairs.where(f"({may_count}) OR ({may_near})")
    group = "PARTITION BY q, s_part"
    pairs = pairs.selectExpr(
        "*", f"sum(CASE WHEN for_nearest THEN s_n END) OVER ({group} ORDER BY hi ROWS UNBOUNDED PRECEDING) AS sure"
    ).selectExpr(
        "* EXCEPT (counted, limit)",
        f"min(CASE WHEN for_nearest AND sure >= {k} THEN hi END) OVER ({group}) AS limit",
        f"counted + coalesce(sum(CASE WHEN {inside} THEN s_n END) OVER ({group}), 0) AS counted",
    )
    return pairs.selectExpr(
        "q", "s", "counted", "limit", f"{may_count} AND NOT ({inside}) AS for_count", f"{may_near} AS for_nearest"
    ).where("for_count OR for_nearest")


def nearest_k(points: DataFrame, stores: DataFrame, companies: Sequence[str], k: int = 5, radius: float = 25.0) -> DataFrame:
    """The k nearest stores of every point and company, with the number within the radius.

    ``points`` has ``lat, lng`` and any key columns; ``stores`` has ``company_name, store_number, lat,
    lng``. Distances are rounded to 0.1 mile before they are ranked and before they are compared with
    the radius; equal ones are ranked by store number. Points or stores without coordinates drop out.
    """
    placed = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    names = F.array(*[F.lit(c) for c in companies])
    points = points.where(placed)
    stores = stores.where(placed & F.col("company_name").isin(list(companies)))
    stores = _gridded(stores, F.array_position(names, F.col("company_name")))
    # Both are read at every grid, so they are written once.
    sites = materialize(_gridded(points.select("lat", "lng", F.lit(1).alias("n")).distinct()))
    spots = materialize(stores.groupBy("part", "lat", "lng", "row", "col").agg(F.count("*").alias("n")))

    # The coarsest grid has at most 46 x 91 cells per company, whatever the size of the data.
    asked = F.explode(F.sequence(F.lit(1), F.lit(len(companies)))).alias("part")
    coarse = F.broadcast(_cells(spots, "s", SHIFTS[0], None))
    pairs = _cells(sites, "q", SHIFTS[0], None).select("*", asked).join(coarse, F.col("part") == F.col("s_part"))
    start = ["true AS for_count", "true AS for_nearest", "0L AS counted", "CAST(NULL AS DOUBLE) AS limit"]
    pairs = _bounded(pairs.selectExpr("*", *start), k, radius)
    for up, shift in zip(SHIFTS, SHIFTS[1:]):
        pairs = pairs.withColumnsRenamed({"q": "q_up", "s": "s_up"})
        pairs = pairs.join(_cells(sites, "q", shift, up), "q_up").join(_cells(spots, "s", shift, up), "s_up")
        pairs = _bounded(pairs, k, radius)

    last = _cell(SHIFTS[-1])
    ends = sites.selectExpr(f"{last} AS q", "lat AS q_lat", "lng AS q_lng")
    spot_ends = spots.selectExpr(f"{last} AS s", "part", "n", "lat AS s_lat", "lng AS s_lng")
    miles = distance_miles(F.col("q_lat"), F.col("q_lng"), F.col("s_lat"), F.col("s_lng"))
    met = pairs.join(ends, "q").join(spot_ends, "s").withColumn("distance_miles", miles)
    group = "PARTITION BY part, q_lat, q_lng"
    met = met.selectExpr(
        "part", "q_lat", "q_lng", "s_lat", "s_lng", "distance_miles", "for_nearest",
        f"counted + coalesce(sum(CASE WHEN for_count AND distance_miles <= {radius} THEN n END) OVER ({group}), 0) AS stores_within_radius",
    ).where("for_nearest")
    # Spots with equal rounded distance share a rank, so no tie is lost here.
    met = met.selectExpr("* EXCEPT (for_nearest)", f"rank() OVER ({group} ORDER BY distance_miles) AS spot_rank")
    met = met.where(F.col("spot_rank") <= k).drop("spot_rank")
    # Of stores at one spot only the first k by number can be among the k nearest.
    first_stores = top_k_per_group(stores, ["part", "lat", "lng"], ["store_number"], k).drop("row", "col")
    first_stores = first_stores.withColumnsRenamed({"lat": "s_lat", "lng": "s_lng"})
    ranked = top_k_per_group(
        met.join(first_stores, ["part", "s_lat", "s_lng"]), ["part", "q_lat", "q_lng"], ["distance_miles", "store_number"], k, rank="rank"
    )
    totals = spots.groupBy("part").agg(F.sum("n").alias("total_active_stores"))
    ranked = ranked.join(totals, "part").drop("part", "s_lat", "s_lng")
    return points.join(ranked.withColumnsRenamed({"q_lat": "lat", "q_lng": "lng"}), ["lat", "lng"])
