"""The read queries behind the service's endpoints. Limits are part of each query
and run as a distributed top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _limit(n: int) -> int:
    if not 1 <= n <= 500:
        raise ValueError("limit must be between 1 and 500")
    return n


def recent_decisions(decisions: DataFrame, decision_type: str | None = None, limit: int = 50) -> DataFrame:
    rows = decisions if decision_type is None else decisions.where(F.col("decision_type") == decision_type)
    return rows.orderBy(F.col("created_ms").desc(), "tracklet_id").limit(_limit(limit))


def ambiguous_queue(decisions: DataFrame, limit: int = 50) -> DataFrame:
    return recent_decisions(decisions, "ambiguous", limit)


def recent_zone_events(events: DataFrame, camera_id: str | None = None, limit: int = 50) -> DataFrame:
    rows = events if camera_id is None else events.where(F.col("camera_id") == camera_id)
    return rows.orderBy(F.col("ts_ms").desc(), "tracklet_id").limit(_limit(limit))


def dwell_recent(sessions: DataFrame, limit: int = 50) -> DataFrame:
    return sessions.orderBy(F.col("entered_ms").desc(), "global_id", "zone_id").limit(_limit(limit))


def identity_lookup(identities: DataFrame, tracklets: DataFrame, global_id: str, limit: int = 200) -> DataFrame:
    """One identity with its latest tracklets; an unknown identity gives no rows."""
    latest = (
        tracklets.where(F.col("global_id") == global_id)
        .orderBy(F.col("start_ms").desc(), "tracklet_id")
        .limit(limit)
    )
    return identities.where(F.col("global_id") == global_id).join(latest, "global_id", "left")


def identity_tracklets(identities: DataFrame, tracklets: DataFrame, limit: int | None = None) -> DataFrame:
    """The same for all identities; a caller's limit trims each one's rows before the shuffle."""
    if limit is None:
        return identities.join(tracklets, "global_id")
    w = Window.partitionBy("global_id").orderBy(F.col("start_ms").desc(), "tracklet_id")
    latest = tracklets.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).drop("_r")
    return identities.join(latest, "global_id")


def active_identities(identities: DataFrame) -> DataFrame:
    return identities.where(F.col("status") == "active").orderBy(F.col("last_seen_ms").desc(), "global_id")


def open_tracklets(tracklets: DataFrame) -> DataFrame:
    return tracklets.where(F.col("end_ms").isNull()).orderBy("camera_id", F.col("start_ms").desc(), "tracklet_id")


def open_dwell(sessions: DataFrame) -> DataFrame:
    return sessions.where(F.col("status") == "open").orderBy("global_id", "zone_id")
