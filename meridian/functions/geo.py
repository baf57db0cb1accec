"""Spherical distance and grid cells on plain longitude/latitude columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean Earth radius in metres (fixed value).
EARTH_M = 6371008.8


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in metres; null if any coordinate is null."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.when(h > 1.0, F.lit(1.0)).otherwise(h)))


def planar_deg(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Planar distance in degrees, for parity with unprojected geometries."""
    return F.hypot(lon2 - lon1, lat2 - lat1)


def degrees_of(metres: float) -> float:
    """Degrees of latitude that a distance spans."""
    return math.degrees(metres / EARTH_M)


def columns_of(size: float) -> tuple[int, float]:
    """How many columns of cells of ``size`` degrees or a little more go round, and their width: all
    are equally wide, so that a disc across 180 degrees meets the columns on the other side."""
    wide = max(1, math.floor(360 / size))
    return wide, 360 / wide


def own_cell(lon: Column, lat: Column, size: float) -> Column:
    """The grid cell of a point as struct<x, y>; longitudes wrap at 180 degrees."""
    wide, across = columns_of(size)
    return F.struct(F.pmod(F.floor((lon + 180) / across), F.lit(wide)).alias("x"), F.floor((lat + 90) / size).alias("y"))


def cells_within(lon: Column, lat: Column, metres: float, size: float) -> Column:
    """All cells that a disc touches, as an array of struct<x, y>: widened by 1 / cos(latitude),
    all around where the disc holds a pole."""
    dlat = degrees_of(metres) * 1.001 + 1e-9
    wide, across = columns_of(size)
    edge = F.abs(lat) + dlat
    # widest longitude difference of a disc: asin(sin r / cos lat)
    ratio = F.least(F.lit(1.0), F.lit(math.sin(math.radians(min(dlat, 90)))) / F.greatest(F.cos(F.radians(lat)), F.lit(1e-12)))
    dlon = F.when(edge >= 90, F.lit(180.0)).otherwise(F.degrees(F.asin(ratio)) + 1e-9)
    x0, x1 = F.floor((lon - dlon + 180) / across), F.floor((lon + dlon + 180) / across)
    xs = F.array_distinct(F.transform(F.sequence(x0, F.least(x1, x0 + wide)), lambda x: F.pmod(x, F.lit(wide))))
    ys = F.sequence(F.floor((F.greatest(lat - dlat, F.lit(-90.0)) + 90) / size), F.floor((F.least(lat + dlat, F.lit(90.0)) + 90) / size))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("x"), y.alias("y")))))
