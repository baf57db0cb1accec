"""Radius and nearest-neighbour joins by grid cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.functions import geo


def radius_join(left: DataFrame, right: DataFrame, metres: float, on: Column | None = None, how: str = "inner", salts: int = 1) -> DataFrame:
    """Pairs within ``metres``, with ``distance_m``: an equi-join on cells, then the exact distance.

    Both sides have ``lon`` and ``lat``; the right side's columns must be named apart but for those
    two, which become ``r_lon`` and ``r_lat``. Null coordinates match nothing. ``how``: inner or left.
    ``salts``: a crowded cell's left rows are dealt to so many tasks, each with the cell's right rows.
    """
    size = max(0.05, geo.degrees_of(metres))
    other = right.withColumnsRenamed({"lon": "r_lon", "lat": "r_lat"})
    other = other.where("r_lon is not null and r_lat is not null").withColumn("_cell", F.explode(geo.cells_within(F.col("r_lon"), F.col("r_lat"), metres, size)))
    mine = left.withColumn("_mine", F.when(F.col("lon").isNotNull() & F.col("lat").isNotNull(), geo.own_cell(F.col("lon"), F.col("lat"), size)))
    match = F.col("_mine") == F.col("_cell")
    if salts > 1:
        other = other.withColumn("_salted", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<long>")))
        mine = mine.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)))
        match = match & (F.col("_salt") == F.col("_salted"))
    distance = geo.haversine_m(F.col("lon"), F.col("lat"), F.col("r_lon"), F.col("r_lat"))
    match = match & (distance <= metres)
    return mine.join(other, match & on if on is not None else match, how).withColumn("distance_m", distance).drop("_mine", "_cell", "_salt", "_salted")


def nearest(left: DataFrame, right: DataFrame, left_id: str, right_id: str, metres: float, on: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(left_id, right_id, distance_m) of the nearest within ``metres``, ties to the smaller id.
    ``keep``: columns of ``left``, whose ids are distinct, to be carried along."""
    pairs = radius_join(left, right, metres, on)
    carried = [F.first(c).alias(c) for c in keep]
    return pairs.groupBy(left_id).agg(F.min(F.struct("distance_m", right_id)).alias("_n"), *carried).select(left_id, f"_n.{right_id}", "_n.distance_m", *keep)


def within(df: DataFrame, lon: float, lat: float, metres: float) -> DataFrame:
    """Rows within a radius of one point: a box that reaches the scan, then the exact distance."""
    d = geo.degrees_of(metres) * 1.001
    near = df.where(F.col("lat").between(lat - d, lat + d))
    return near.withColumn("distance_m", geo.haversine_m(F.lit(lon), F.lit(lat), F.col("lon"), F.col("lat"))).where(F.col("distance_m") <= metres)


def in_envelope(lon: float, lat: float, degrees: float = 1.0) -> Column:
    return F.col("lon").between(lon - degrees, lon + degrees) & F.col("lat").between(lat - degrees, lat + degrees)


def in_polygon(ring: list[tuple[float, float]]) -> Column:
    """Whether (lon, lat) is inside a ring, by ray casting."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if y1 != y2:
            at = F.lit(x1) + (F.col("lat") - y1) * ((x2 - x1) / (y2 - y1))
            crossings = crossings + (((F.lit(y1) > F.col("lat")) != (F.lit(y2) > F.col("lat"))) & (F.col("lon") < at)).cast("int")
    return crossings % 2 == 1
