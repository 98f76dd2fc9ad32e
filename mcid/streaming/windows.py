"""Streams that need only watermarks and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.tracklets import tracklet_id


def timed(df: DataFrame, delay: str, ts_ms: str = "ts_ms") -> DataFrame:
    """Add the event time ``ts`` and bound its lateness."""
    return df.withColumn("ts", F.timestamp_millis(ts_ms)).withWatermark("ts", delay)


def deduplicated(df: DataFrame, key: str = "event_id", delay: str = "10 minutes") -> DataFrame:
    """At-least-once delivery made exactly-once: repeats within the delay go."""
    return timed(df, delay).dropDuplicatesWithinWatermark([key])


def tracklets(df: DataFrame, gap_ms: int = 3_000, min_detections: int = 10, delay: str = "10 seconds") -> DataFrame:
    """Closed tracklets from zoned detections, each once its idle time has passed.

    The session's partial sums are merged in each task before the shuffle if
    ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition`` is on.
    """
    at = F.struct("ts_ms", "det_id")
    runs = timed(df, delay).groupBy("camera_id", "local_track_id", F.session_window("ts", f"{gap_ms} milliseconds")).agg(
        F.min("ts_ms").alias("start_ms"),
        F.max("ts_ms").alias("end_ms"),
        F.min(F.struct(at.alias("at"), "zone_id"))["zone_id"].alias("start_zone_id"),
        F.max(F.struct(at.alias("at"), "zone_id"))["zone_id"].alias("end_zone_id"),
        F.count("*").alias("frame_count"),
    )
    return runs.where(F.col("frame_count") >= min_detections).select(
        tracklet_id(F.col("camera_id"), F.col("local_track_id"), F.col("start_ms")).alias("tracklet_id"),
        "camera_id",
        "local_track_id",
        "start_ms",
        "end_ms",
        "start_zone_id",
        "end_zone_id",
        "frame_count",
    )


def zone_counts(df: DataFrame, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Entries, exits and people per zone and tumbling window."""
    return (
        timed(df, delay)
        .groupBy("zone_id", F.window("ts", width))
        .agg(
            F.count(F.when(F.col("event_type") == "enter", 1)).alias("entries"),
            F.count(F.when(F.col("event_type") == "exit", 1)).alias("exits"),
        )
        .select("zone_id", F.unix_millis("window.start").alias("window_ms"), "entries", "exits")
    )


def split_late(df: DataFrame, stale_ms: int = 400) -> tuple[DataFrame, DataFrame]:
    """(fresh, stale) by the age at which a row was received."""
    stale = F.col("received_ms") - F.col("ts_ms") > stale_ms
    return df.where(~stale), df.where(stale)
