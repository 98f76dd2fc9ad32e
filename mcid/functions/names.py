"""Names and paths: cameras, zones, routing keys and evidence objects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .times import day_text


def camera_id(raw: Column) -> Column:
    """``cam3_merged`` becomes ``CAM_03``; anything else is upper-cased."""
    base = F.regexp_replace(F.trim(raw), "_merged$", "")
    digits = F.regexp_extract(base, "^cam([0-9]+)$", 1)
    padded = F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits)
    return F.when(digits != "", F.concat(F.lit("CAM_"), padded)).otherwise(F.upper(base))


def zone_key(name: Column) -> Column:
    return F.replace(name, F.lit(" "), F.lit(""))


def zone_lower(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit(" "), F.lit("_"))


def zone_slug(name: Column, fallback: Column | None = None) -> Column:
    """Lower case, ``&`` as ``and``, every other run of symbols as one dash."""
    empty_to_null = F.nullif(name, F.lit(""))
    chosen = F.coalesce(empty_to_null, fallback if fallback is not None else F.lit("unknown-zone"), F.lit("unknown-zone"))
    text = F.replace(F.lower(F.trim(chosen)), F.lit("&"), F.lit(" and "))
    slug = F.trim(F.regexp_replace(text, "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(slug == "", "unknown-zone").otherwise(slug)


# fixed values: channel names of the telemetry topics
CHANNELS = {"telemetry": "summary", "attributes": "attributes", "events": "event", "status": "status"}


def topic_camera(camera: Column, device: Column | None = None) -> Column:
    raw = F.coalesce(F.nullif(device, F.lit("")), camera) if device is not None else camera
    raw = F.coalesce(F.nullif(raw, F.lit("")), F.lit("unknown"))
    short = F.when(raw.startswith("cam_"), F.concat(F.lit("cam"), F.substring(raw, 5, 1 << 20))).otherwise(raw)
    return F.replace(short, F.lit("_"), F.lit("-"))


def topic_name(base: Column, camera: Column, channel: Column, device: Column | None = None) -> Column:
    """Routing key ``base/camera/suffix``; an unknown channel gives NULL."""
    root = F.trim(base, F.lit("/"))
    suffix = F.create_map(*[F.lit(x) for kv in CHANNELS.items() for x in kv])[channel]
    return F.when(channel == "command", F.concat(root, F.lit("/+/command"))).otherwise(
        F.concat(root, F.lit("/"), topic_camera(camera, device), F.lit("/"), suffix)
    )


def evidence_key(
    site: Column,
    camera: Column,
    zone: Column,
    ts_ms: Column,
    global_id: Column,
    tracklet_id: Column,
    kind: str = "best",
    frame_id: Column | None = None,
) -> Column:
    return F.concat_ws(
        "/", F.lit("evidence"), site, camera, zone, day_text(ts_ms, "yyyy/MM/dd"), global_id, tracklet_id, _leaf(kind, frame_id)
    )


def pending_key(
    site: Column, camera: Column, tracklet_id: Column, kind: str = "best", frame_id: Column | None = None
) -> Column:
    return F.concat_ws("/", F.lit("evidence/pending"), site, camera, tracklet_id, _leaf(kind, frame_id))


def _leaf(kind: str, frame_id: Column | None) -> Column:
    if kind == "best":
        return F.lit("best.jpg")
    if kind == "debug" and frame_id is not None:
        return F.format_string("debug_%06d.jpg", frame_id)
    raise ValueError(f"unknown evidence kind, or no frame: {kind}")


def visualization_key(site: Column, camera: Column, ts_ms: Column, kind: str = "first_3000_frames") -> Column:
    return F.concat_ws("/", F.lit("visualization"), site, camera, day_text(ts_ms, "yyyy/MM/dd"), F.lit(f"{kind}.mp4"))


def report_key(site: Column, ts_ms: Column, kind: str = "benchmark") -> Column:
    stamp = F.floor(ts_ms / 1000).cast("string")
    return F.concat_ws("/", F.lit("reports"), site, day_text(ts_ms, "yyyy/MM/dd"), F.concat(F.lit(f"{kind}_"), stamp, F.lit(".json")))


def person_crop_key(
    prefix: Column, camera: Column, zone: Column, person: Column, ts_ms: Column, fallback: Column | None = None
) -> Column:
    leaf = F.concat(ts_ms.cast("string"), F.lit("_"), person.cast("string"), F.lit(".jpg"))
    return F.concat_ws("/", prefix, camera, zone_slug(zone, fallback), day_text(ts_ms), leaf)


def parse_evidence_uri(uri: Column) -> Column:
    """struct(bucket, key) of an ``s3://bucket/evidence/...`` address, else NULL."""
    bucket = F.regexp_extract(uri, "^s3://([^/]*)/(evidence/.*)$", 1)
    key = F.regexp_extract(uri, "^s3://([^/]*)/(evidence/.*)$", 2)
    return F.when(key != "", F.struct(bucket.alias("bucket"), key.alias("key")))
