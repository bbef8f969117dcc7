"""Great-circle distance and cube cells on the sphere.

A point becomes an integer cube of the given edge in earth-centred space. A chord is never longer than its arc, so
two points within ``edge`` of each other are at most one cube apart on every axis: no pole or date-line cases.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from proplake.config import EARTH_RADIUS_M


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column, radius: float = EARTH_RADIUS_M) -> Column:
    half_lat, half_lng = F.radians(lat2 - lat1) / 2, F.radians(lng2 - lng1) / 2
    a = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lng) * F.sin(half_lng)
    return F.asin(F.sqrt(F.when(a > 1.0, 1.0).otherwise(a))) * F.lit(2 * radius)


def cell(lat: Column, lng: Column, edge: float, radius: float = EARTH_RADIUS_M) -> Column:
    """struct<x, y, z> of the cube holding the point."""
    la, lo = F.radians(lat), F.radians(lng)
    axes = {"x": F.cos(la) * F.cos(lo), "y": F.cos(la) * F.sin(lo), "z": F.sin(la)}
    return F.struct(*[F.floor(v * F.lit(radius) / F.lit(edge)).cast("long").alias(n) for n, v in axes.items()])


def neighbour_cells(own: Column, reach: int = 1) -> Column:
    """array<struct> of the cubes at most ``reach`` away on each axis, the own cube included."""
    steps = F.array(*[
        F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(z).alias("z"))
        for x in range(-reach, reach + 1) for y in range(-reach, reach + 1) for z in range(-reach, reach + 1)
    ])
    return F.transform(steps, lambda s: F.struct(
        (own["x"] + s["x"]).alias("x"), (own["y"] + s["y"]).alias("y"), (own["z"] + s["z"]).alias("z")))


def space(lat: Column, lng: Column, radius: float = EARTH_RADIUS_M) -> dict[str, Column]:
    """Earth-centred metres of a point, by axis."""
    la, lo = F.radians(lat), F.radians(lng)
    return {"x": F.cos(la) * F.cos(lo) * F.lit(radius), "y": F.cos(la) * F.sin(lo) * F.lit(radius), "z": F.sin(la) * F.lit(radius)}


def parent_cell(own: Column, factor: int = 2) -> Column:
    """The cube of ``factor`` times the edge that holds a cube; -1 belongs to the cube below 0."""
    return F.struct(*[F.floor(own[n] / F.lit(factor)).cast("long").alias(n) for n in "xyz"])
