"""Columns on the sphere: distances, boxes, averages, clean-up of coordinates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6376.774
KM_PER_MILE = 1.609
#: Distance where a coordinate is missing.
FAR_KM = 1_000_000.0


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle kilometres by the law of cosines; a cosine above one counts as one."""
    a, b, c, d = (F.radians(x) for x in (lat1, lon1, lat2, lon2))
    cosine = F.sin(a) * F.sin(c) + F.cos(a) * F.cos(c) * F.cos(d - b)
    km = F.lit(EARTH_KM) * F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))
    known = lat1.isNotNull() & lon1.isNotNull() & lat2.isNotNull() & lon2.isNotNull()  # least() passes over nulls
    return F.when(known, km).otherwise(FAR_KM)


def degree_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return F.sqrt((lat1 - lat2) * (lat1 - lat2) + (lon1 - lon2) * (lon1 - lon2))


def km_to_miles(km: Column) -> Column:
    return km / F.lit(KM_PER_MILE)


def miles_to_km(miles: Column) -> Column:
    return miles * F.lit(KM_PER_MILE)


def km_per_degree() -> float:
    return math.pi * 2 * EARTH_KM / 360


def box_area_km2(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    height = F.abs(F.sin(F.radians(lat1)) - F.sin(F.radians(lat2)))
    return F.lit(EARTH_KM * EARTH_KM) * height * F.abs(F.radians(lon1) - F.radians(lon2))


def average_longitude(a: Column, b: Column) -> Column:
    """Middle of two longitudes along the shorter way, in [-180, 180)."""
    plain = (a + b) / 2
    other = F.when(plain >= 0, plain - 180).otherwise(plain + 180)
    return F.when(F.abs(a - b) > 180, other).otherwise(plain)


def wrap_longitude(lon: Column) -> Column:
    """Into [-180, 180)."""
    return F.pmod(lon + 180, F.lit(360.0)) - 180


def clip_latitude(lat: Column) -> Column:
    return F.greatest(F.lit(-90.0), F.least(F.lit(90.0), lat))


def valid_coordinate(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180) & ~F.isnan(lat) & ~F.isnan(lon), F.lit(False))


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    """Inside (south, west, north, east), edges included; missing coordinates are outside.

    A box whose west is east of its east crosses the antimeridian.
    """
    south, west, north, east = box
    across = lon.between(west, east) if west <= east else (lon >= west) | (lon <= east)
    return valid_coordinate(lat, lon) & lat.between(south, north) & across


def boxes_overlap(a: tuple[Column, ...], b: tuple[float, float, float, float], touching: bool = True) -> Column:
    """Whether two boxes (south, west, north, east) share area, or an edge if `touching`."""
    south, west, north, east = b
    if touching:
        return (a[0] <= north) & (a[2] >= south) & (a[1] <= east) & (a[3] >= west)
    return (a[0] < north) & (a[2] > south) & (a[1] < east) & (a[3] > west)


def parse_coordinate(text: Column) -> tuple[Column, Column]:
    """(lat, lon) of `lat,lon`, with or without parentheses; nulls where it isn't one."""
    bare = F.split(F.regexp_replace(text, r"[()\s]", ""), ",")
    lat, lon = (F.get(bare, i).try_cast("double") for i in (0, 1))
    good = F.size(bare) == 2
    return F.when(good, lat), F.when(good, lon)


def show_coordinate(lat: Column, lon: Column) -> Column:
    return F.concat_ws(",", lat.cast("string"), lon.cast("string"))


def in_polygon(lat: Column, lon: Column, ring: list[tuple[float, float]]) -> Column:
    """Ray casting against a closed ring of (lat, lon) points.

    A constant ring becomes one expression of its edges, so the test stays in
    the JVM.  A crossing counts for an edge's lower end and not its upper one,
    so a ray through a corner is counted once.
    """
    crossings = F.lit(0)
    for (y1, x1), (y2, x2) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if y1 == y2:
            continue
        spans = (F.lit(y1) > lat) != (F.lit(y2) > lat)
        at = F.lit(x1) + (lat - y1) * F.lit((x2 - x1) / (y2 - y1))
        crossings = crossings + F.when(spans & (lon < at), 1).otherwise(0)
    return F.coalesce(crossings % 2 == 1, F.lit(False))
