"""Nearest-point and within-radius joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proplake.config import EARTH_RADIUS_M, EARTH_RADIUS_MILES
from proplake.functions.geo import cell, haversine, neighbour_cells
from proplake.functions.skew import left_join_spread
from proplake.session import cut_lineage

RINGS_KM = (2.0, 8.0, 32.0, 128.0, 512.0, 2048.0, 8192.0, 32768.0)


def nearest_region(df: DataFrame, centroids: DataFrame, rings_km: tuple[float, ...] = RINGS_KM) -> DataFrame:
    """Add ``region``: name of the nearest centroid (lowest ``ord`` on equal distance), NULL without coordinates.

    Distinct coordinates are resolved once, by rings of growing cubes, for any number of centroids. In each ring only the
    points without a centroid inside the previous radius remain, so the cubes they probe hold few centroids; a hit within
    the ring's edge is provably the nearest. Points still open are written out after each ring, and the loop ends when none
    are left.
    """
    points = df.select("latitude", "longitude").filter("latitude IS NOT NULL AND longitude IS NOT NULL").distinct()
    spots = centroids.select("name", "lat", "lng", "ord")
    open_points, solved = cut_lineage(points), None
    for km in rings_km:
        edge = km * 1000.0
        probe = open_points.withColumn("c", F.explode(neighbour_cells(cell(F.col("latitude"), F.col("longitude"), edge))))
        grid = spots.withColumn("c", cell(F.col("lat"), F.col("lng"), edge))
        hits = probe.join(grid, "c").withColumn(
            "dist", F.round(haversine(F.col("lat"), F.col("lng"), F.col("latitude"), F.col("longitude"), EARTH_RADIUS_MILES), 9)
        ).filter(F.col("dist") <= F.lit(edge * EARTH_RADIUS_MILES / EARTH_RADIUS_M))
        best = cut_lineage(hits.groupBy("latitude", "longitude").agg(F.min_by("name", F.struct("dist", "ord")).alias("region")))
        solved = best if solved is None else solved.unionByName(best)
        open_points = cut_lineage(open_points.join(best, ["latitude", "longitude"], "left_anti"))
        if open_points.isEmpty():
            break
    return left_join_spread(df.drop("region"), solved, ["latitude", "longitude"])


def radius_prune(df: DataFrame, centroids: DataFrame, km: float) -> DataFrame:
    """Rows within ``km`` of any centroid. The centroid side is spread over neighbouring cubes, the rows stay put."""
    edge = km * 1000.0
    grid = centroids.select(F.col("lat").alias("c_lat"), F.col("lng").alias("c_lng"), F.explode(
        neighbour_cells(cell(F.col("lat"), F.col("lng"), edge))).alias("c")).distinct()
    rows = df.withColumn("c", cell(F.col("latitude"), F.col("longitude"), edge))
    near = haversine(F.col("r.latitude"), F.col("r.longitude"), F.col("g.c_lat"), F.col("g.c_lng")) <= edge
    return rows.alias("r").join(grid.alias("g"), (F.col("r.c") == F.col("g.c")) & near, "left_semi").drop("c")


def nearest_station(df: DataFrame, stations: DataFrame, radius_m: float = 1200.0, metres_per_minute: float = 80.0) -> DataFrame:
    """Add nearest station within the radius, walking minutes (at least 1) and its lowest zone.

    Distinct coordinates probe the cube grid once, so many listings at one address cost one lookup.
    """
    points = df.select("latitude", "longitude").filter("latitude IS NOT NULL AND longitude IS NOT NULL").distinct()
    probe = points.withColumn("c", F.explode(neighbour_cells(cell(F.col("latitude"), F.col("longitude"), radius_m))))
    grid = stations.withColumn("c", cell(F.col("lat"), F.col("lng"), radius_m))
    metres = F.round(haversine(F.col("latitude"), F.col("longitude"), F.col("lat"), F.col("lng")), 6)
    best = (
        probe.join(grid, "c").withColumn("metres", metres).filter(F.col("metres") <= radius_m)
        .groupBy("latitude", "longitude")
        .agg(F.min(F.struct("metres", "station", "zone_text")).alias("best"))
    )
    zones = F.array_min(F.regexp_extract_all(F.col("best.zone_text"), F.lit(r"(\d+)"), F.lit(1)))
    found = best.select(
        "latitude", "longitude", F.col("best.station").alias("nearest_station"),
        F.greatest(F.lit(1), F.bround(F.col("best.metres") / metres_per_minute, 0).cast("int")).alias("tube_distance"),
        zones.try_cast("int").alias("tfl_zone"),
    )
    return left_join_spread(df.drop("nearest_station", "tube_distance", "tfl_zone"), found, ["latitude", "longitude"])
