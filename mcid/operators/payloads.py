"""Telemetry rows ``{ts, values}`` as JSON text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import zone_key, zone_lower


def payload(ts_ms: Column, **values: Column) -> Column:
    inner = F.struct(*[c.alias(n) for n, c in values.items()])
    return F.to_json(F.struct(ts_ms.alias("ts"), inner.alias("values")))


def new_identities(decisions: DataFrame, site_id: str, show_local_track: bool = False) -> DataFrame:
    """A row for each decision that minted an identity."""
    values = {
        "global_id_active": F.lit(1),
        "global_id": F.col("assigned_global_id"),
        "site_id": F.lit(site_id),
        "camera_id": F.col("camera_id"),
    }
    if show_local_track:
        values["local_track_id"] = F.col("local_track_id")
    minted = decisions.where((F.col("decision_type") == "new") & F.col("assigned_global_id").isNotNull())
    return minted.withColumn("payload", payload(F.col("created_ms"), **values))


def zone_event(ts_ms: Column, zone_id: Column, camera_id: Column, event_type: Column, global_id: Column) -> Column:
    return payload(ts_ms, zone_event=event_type, zone_id=zone_id, camera_id=camera_id, global_id=global_id)


def dwell(ts_ms: Column, global_id: Column, zone_id: Column, camera_id: Column, seconds: Column) -> Column:
    return payload(
        ts_ms, dwell_duration_seconds=seconds, zone_id=zone_id, camera_id=camera_id, global_id=global_id
    )


def zone_summary(ts_ms: Column, df_columns: dict[str, Column]) -> Column:
    names = ("cam_id", "zone_id", "people_count", "entries", "exits", "dwell_avg_seconds", "active_global_ids")
    return payload(ts_ms, **{n: df_columns[n] for n in names})


def system_health(
    ts_ms: Column,
    site_id: Column,
    camera_id: Column,
    fps: Column,
    detector: Column,
    reid: Column,
    crashed: Column,
    healthy: Column,
) -> Column:
    return payload(
        ts_ms,
        site_id=site_id,
        cam_id=camera_id,
        fps=fps,
        detector_backend=detector,
        reid_backend=reid,
        workers_crashed=crashed,
        stream_healthy=healthy,
    )


# fixed values: stat columns and the names of their payload keys; {key} is the zone
# name without blanks and {lower} the lower-case name with underscores
ZONE_KEYS = {
    "current_count": "{key}Count",
    "avg_dwell": "{lower}AvgDwell",
    "longest_dwell": "longestDwell{key}",
    "pending_entries": "pending{key}",
    "total_entered": "count{key}",
    "total_exited": "exit{key}",
    "valid_entries": "validEntries{key}",
}
CAMERA_KEYS = {
    "total_people": "TotalPeople",
    "avg_camera_dwell": "avgCameraDwell",
    "longest_camera_dwell": "longestCameraDwell",
    "unique_people": "uniquePeopleToday",
    "unique_people_hourly": "uniquePeopleHourly",
    "unique_people_daily": "uniquePeopleDaily",
    "total_pending": "totalPendingEntries",
    "avg_dwell_time": "avgDwellTime",
    "longest_dwell_time": "longestDwellTime",
}


def _entries(df: DataFrame, names: dict[str, Column]) -> DataFrame:
    pairs = F.array(*[F.struct(n.alias("key"), F.col(c).cast("string").alias("value")) for c, n in names.items()])
    return df.select("camera_id", F.explode(pairs).alias("e")).select("camera_id", "e.key", "e.value")


def wide(zone_stats: DataFrame, camera_stats: DataFrame, ts_ms: Column) -> DataFrame:
    """One ``{ts, values}`` row per camera with every zone and camera number.

    ``zone_stats``: camera_id, zone_id and the columns of ``ZONE_KEYS``;
    ``camera_stats``: camera_id and the columns of ``CAMERA_KEYS``. The entries of
    a camera are as many as its zones, so the last grouping is small.
    """
    key, lower = zone_key(F.col("zone_id")), zone_lower(F.col("zone_id"))

    def named(pattern: str) -> Column:
        head, tail = re.split(r"\{key\}|\{lower\}", pattern)
        return F.concat(F.lit(head), lower if "{lower}" in pattern else key, F.lit(tail))

    entries = _entries(zone_stats, {c: named(p) for c, p in ZONE_KEYS.items()}).unionByName(
        _entries(camera_stats, {c: F.lit(n) for c, n in CAMERA_KEYS.items()})
    )
    piece = F.concat(F.lit('"'), "key", F.lit('":'), "value")
    body = F.array_join(F.array_sort(F.collect_list(piece)), ",")
    return entries.groupBy("camera_id").agg(
        F.concat(F.lit('{"ts":'), F.max(ts_ms).cast("string"), F.lit(',"values":{'), body, F.lit("}}")).alias("payload")
    )
