"""Great-circle distances."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EARTH_METERS = 6371008.8
MILE_METERS = 1609.34
EARTH_MILES = EARTH_METERS / MILE_METERS


def miles_between(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Haversine distance in miles, not rounded."""
    half_lat = F.radians(lat2 - lat1) / 2
    half_lng = F.radians(lng2 - lng1) / 2
    a = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lng), 2)
    return F.lit(2 * EARTH_METERS) * F.asin(F.sqrt(F.least(a, F.lit(1.0)))) / F.lit(MILE_METERS)


def distance_miles(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """The same, to one decimal."""
    return F.round(miles_between(lat1, lng1, lat2, lng2), 1)
