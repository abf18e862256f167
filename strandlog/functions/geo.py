"""Distances and boxes over (lat, lon) structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_008.8
#: Metres in a degree of latitude, rounded down so that the band below never cuts too much.
DEGREE_M = 111_194.0


def distance_m(place: Column, lat: float, lon: float) -> Column:
    """Great-circle distance in metres."""
    a = F.radians(place.lat - lat) / 2
    b = F.radians(place.lon - lon) / 2
    h = F.pow(F.sin(a), 2) + F.cos(F.radians(place.lat)) * F.cos(F.radians(F.lit(lat))) * F.pow(F.sin(b), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def near(place: Column, lat: float, lon: float, metres: float) -> Column:
    """Within a distance; a band of latitudes, which scans understand, goes first."""
    reach = metres / DEGREE_M
    return F.coalesce(place.lat.between(lat - reach, lat + reach) & (distance_m(place, lat, lon) <= metres), F.lit(False))


def within(place: Column, south: float, west: float, north: float, east: float) -> Column:
    return F.coalesce(place.lat.between(south, north) & place.lon.between(west, east), F.lit(False))
