"""People: what is known per identity and camera, and merged identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import session_id
from ..session import cut_lineage, delete_cuts
from .candidates import DAY_SECONDS


def rollup(sightings: DataFrame) -> DataFrame:
    """First and last sighting of each identity, by event time.

    ``sightings``: global_id, camera_id, ts_ms. Two sightings at the same time go
    by camera name.
    """
    at = F.struct("ts_ms", "camera_id")
    return sightings.groupBy("global_id").agg(F.min(at).alias("a"), F.max(at).alias("z"), F.count("*").alias("tracklets")).select(
        "global_id",
        session_id(F.col("a.ts_ms")).alias("session_id"),
        F.col("a.ts_ms").alias("first_seen_ms"),
        F.col("z.ts_ms").alias("last_seen_ms"),
        F.col("a.camera_id").alias("first_camera_id"),
        F.col("z.camera_id").alias("last_camera_id"),
        F.lit("active").alias("status"),
        F.lit("firm").alias("confidence_state"),
        "tracklets",
    )


def camera_last_seen(sightings: DataFrame, now_ms: Column | None = None) -> DataFrame:
    """Latest sighting per camera; with ``now_ms``, only cameras seen in 24 h."""
    out = sightings.groupBy("camera_id").agg(F.max("ts_ms").alias("last_seen_ms"))
    return out if now_ms is None else out.where(now_ms - F.col("last_seen_ms") <= DAY_SECONDS * 1000)


def recent_identities(sightings: DataFrame, now_ms: Column) -> DataFrame:
    """Identities seen in the last 24 h with their latest time and camera."""
    live = sightings.where(now_ms - F.col("ts_ms") <= DAY_SECONDS * 1000)
    return (
        live.groupBy("global_id")
        .agg(F.max(F.struct("ts_ms", "camera_id")).alias("z"))
        .select("global_id", F.col("z.ts_ms").alias("last_seen_ms"), F.col("z.camera_id").alias("last_camera_id"))
    )


def canonical_ids(merges: DataFrame) -> DataFrame:
    """Final identity of every merged one, following chains of merges.

    ``merges``: old_global_id, new_global_id, created_ms; the latest merge of an
    identity counts. Pointers double each round, so a chain of n merges takes
    about log2(n) joins. A chain that runs in a circle stops the job.
    """
    step = (
        merges.where("old_global_id <> new_global_id")
        .groupBy("old_global_id")
        .agg(F.max(F.struct("created_ms", "new_global_id"))["new_global_id"].alias("global_id"))
    )
    links = cut_lineage(step)
    # after r rounds a pointer has passed 2^r merges, and no chain is longer than
    # the number of merges
    for _ in range(links.count().bit_length() + 2):
        up = links.select(F.col("old_global_id").alias("global_id"), F.col("global_id").alias("next"))
        hop = links.join(up, "global_id", "left").select(
            "old_global_id", F.coalesce("next", "global_id").alias("global_id"), F.col("next").isNotNull().alias("moved")
        )
        hop = cut_lineage(hop)
        moved = not hop.where("moved").isEmpty()
        delete_cuts(links)
        links = hop.select("old_global_id", "global_id")
        if not moved:
            return links
    raise ValueError("identity merges form a circle")
