"""Assigning detections to zones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import boxes, polygons


def zone_lists(zones: DataFrame, cameras: DataFrame) -> DataFrame:
    """One row per camera: its enabled zones, in order, in that camera's pixels."""
    sized = zones.where("enabled").join(cameras.select("camera_id", "width", "height"), "camera_id")
    pixels = polygons.scale(
        polygons.parse_strict(F.col("polygon_json"), F.col("zone_id")),
        F.col("width").cast("double"),
        F.col("height").cast("double"),
    )
    entry = F.struct("ord", "zone_id", pixels.alias("polygon"))
    return sized.groupBy("camera_id", "width", "height").agg(F.array_sort(F.collect_list(entry)).alias("zones"))


def assign_zone(df: DataFrame, zones: DataFrame, cameras: DataFrame) -> DataFrame:
    """Add ``zone_id``: the first zone whose polygon holds the box's centre.

    Zones join as one list per camera, so the test runs inside each row and the
    detections are not shuffled while the lists are small enough to broadcast.
    """
    cx, cy = boxes.centroid(boxes.box())
    w = F.greatest(F.col("width"), F.lit(1))
    h = F.greatest(F.col("height"), F.lit(1))
    px, py = cx / w * F.col("width"), cy / h * F.col("height")
    hits = F.filter("zones", lambda z: polygons.contains(z["polygon"], F.col("_px"), F.col("_py")))
    return (
        df.join(zone_lists(zones, cameras), "camera_id", "left")
        .withColumns({"_px": px, "_py": py})
        .select(*df.columns, F.get(hits, F.lit(0))["zone_id"].alias("zone_id"))
    )
