"""Writers: appends, upserts as merged snapshots, deduplicated inserts, manifests
and retention. Each returns the frame to write, so the caller picks the format;
``append`` and ``replace`` write Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from ..functions.times import day_text

DAY_MS = 86_400_000


def append(df: DataFrame, path: str, ts_ms: str = "ts_ms", by: Sequence[str] = ("camera_id",)) -> None:
    """Append a fact, partitioned by day and camera. Rows are spread by those keys
    and a hash, so that a busy camera-day is written by several tasks."""
    day = df.withColumn("dt", day_text(F.col(ts_ms)))
    spread = day.repartition("dt", *by, F.pmod(F.xxhash64(*df.columns), F.lit(8)))
    spread.write.mode("append").partitionBy("dt", *by).parquet(path)


def replace(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def constrain(df: DataFrame, column: str, allowed: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows within an enumerated column's values, the rest)."""
    ok = F.coalesce(F.col(column).isin(*allowed), F.lit(False))
    return df.where(ok), df.where(~ok)


def new_rows(df: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not stored yet, one per key: the smallest, so that a retry writes the same."""
    first = df.groupBy(*keys).agg(F.min(F.struct(*df.columns)).alias("_r")).select("_r.*")
    return first.join(stored.select(*keys), list(keys), "left_anti")


def upsert_latest(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Insert or replace by key: the latest incoming row wins over the stored one. Equal
    versions go by the whole row, so that a retry writes the same."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc(), *[F.col(c).desc() for c in incoming.columns if c != order])
    newest = incoming.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return stored.join(newest.select(*keys), list(keys), "left_anti").unionByName(newest)


def upsert_tracklets(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert or update tracklets. An update keeps the start and the identity,
    replaces the counts, and fills the rest only where it brings a value."""
    fill = ("end_ms", "end_zone_id", "best_crop_uri", "quality_score")
    counts = ("frame_count", "embedding_count")
    o, n = stored.alias("o"), incoming.alias("n")
    existing, fresh = F.col("o.tracklet_id").isNotNull(), F.col("n.tracklet_id").isNotNull()

    def pick(c: str) -> Column:
        old, new = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c == "tracklet_id":
            return F.coalesce(old, new)
        if c in fill:
            return F.coalesce(new, old)
        if c in counts:
            return F.when(fresh, new).otherwise(old)
        return F.when(existing, old).otherwise(new)

    return o.join(n, F.col("o.tracklet_id") == F.col("n.tracklet_id"), "full").select(
        *[pick(c).alias(c) for c in stored.columns]
    )


def upsert_identities(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert identities or extend them: the first sighting stays, the last one
    moves forward, and the last camera is the one of the latest time."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    kept = F.min(F.struct("_new", "first_seen_ms", "first_camera_id", "session_id", "status", "confidence_state")).alias("a")
    last = F.max(F.struct("last_seen_ms", "last_camera_id")).alias("z")
    return both.groupBy("global_id").agg(kept, last).select(
        "global_id",
        "a.session_id",
        "a.first_seen_ms",
        "z.last_seen_ms",
        "a.first_camera_id",
        "z.last_camera_id",
        "a.status",
        "a.confidence_state",
    )


def set_global_id(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Write resolved identities onto the tracklets or vectors they belong to."""
    given = decisions.where("assigned_global_id IS NOT NULL").select("tracklet_id", F.col("assigned_global_id").alias("_gid"))
    old = F.col("global_id") if "global_id" in rows.columns else F.lit(None).cast("string")
    return rows.join(given, "tracklet_id", "left").withColumn("global_id", F.coalesce("_gid", old)).drop("_gid")


def rekey_manifest(decisions: DataFrame, pending: DataFrame, bucket: str, site: str = "default_site") -> DataFrame:
    """Copies from pending to final evidence keys for tracklets that got an identity
    and whose pending object exists. ``pending``: key."""
    named = decisions.where(F.col("decision").isin("new", "match") & F.col("assigned_global_id").isNotNull())
    where = F.lit(site) if "site_id" not in named.columns else F.coalesce("site_id", F.lit(site))
    zone = F.coalesce(F.nullif("end_zone_id", F.lit("")), F.lit("Z_NONE"))
    tid, cam = F.col("tracklet_id"), F.col("camera_id")
    moves = named.select(
        "tracklet_id",
        names.pending_key(where, cam, tid).alias("key"),
        names.evidence_key(where, cam, zone, F.col("ts_ms"), F.col("assigned_global_id"), tid).alias("final_key"),
    )
    found = moves.join(pending.select("key"), "key", "left_semi")
    return found.select(
        "tracklet_id",
        F.col("key").alias("pending_key"),
        "final_key",
        F.concat(F.lit(f"s3://{bucket}/"), "final_key").alias("best_crop_uri"),
    )


def retention(
    identities: DataFrame,
    events: DataFrame,
    vectors: DataFrame,
    objects: DataFrame,
    now_ms: Column,
    identity_seconds: int = 86_400,
    event_days: int = 7,
    vector_seconds: int = 86_400,
    object_days: int = 7,
    dry_run: bool = False,
) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables after one retention pass, one summary row). A dry run only counts."""

    def old(column: str, seconds: int) -> Column:
        return F.col(column) < now_ms - seconds * 1000

    expired = (F.col("status") == "active") & old("last_seen_ms", identity_seconds)
    old_events, old_vectors = old("ts_ms", event_days * 86_400), old("ts_ms", vector_seconds)
    old_objects = old("modified_ms", object_days * 86_400)

    def counted(df: DataFrame, cond: Column) -> Column:
        return df.agg(F.count(F.when(cond, 1))).scalar()

    summary = identities.agg(F.count(F.when(expired, 1)).alias("identities_expired")).select(
        "identities_expired",
        counted(events, old_events).alias("events_deleted"),
        counted(vectors, old_vectors).alias("vectors_deleted"),
        counted(objects, old_objects).alias("objects_deleted"),
        F.lit(dry_run).alias("dry_run"),
    )
    if dry_run:
        return {"identities": identities, "events": events, "vectors": vectors, "objects": objects}, summary
    kept = {
        "identities": identities.withColumn("status", F.when(expired, "expired").otherwise(F.col("status"))),
        "events": events.where(~old_events),
        "vectors": vectors.where(~old_vectors),
        "objects": objects.where(~old_objects),
    }
    return kept, summary


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = row if out is None else out.unionByName(row)
    return out
