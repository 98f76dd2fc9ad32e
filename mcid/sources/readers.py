"""Readers. Each parses text columns or files into typed rows and keeps what it
cannot use apart, with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import names
from ..operators.rows import compute_once

# every field as text first: JSON numbers and quoted numbers are both accepted
_RAW = ", ".join(
    f"{n} string"
    for n in (
        "schema_version", "event_id", "source", "run_id", "camera_id", "frame_id", "timestamp_ms", "received_at_ms",
        "local_track_id", "bbox", "score", "crop_path", "embedding", "frame_uri", "_bad",
    )
)


def _cast(c: str, kind: str) -> Column:
    return F.expr(f"try_cast({c} AS {kind})")


_WHOLE = ("frame_id", "local_track_id", "timestamp_ms", "received_at_ms")


def _whole(c: str) -> Column:
    return F.coalesce(_cast(c, "bigint"), F.expr(f"try_cast(_d.{c} AS bigint)"))


def judge_detections(df: DataFrame, column: str = "value", now_ms: Column | None = None) -> DataFrame:
    """Typed detections from JSON text, with a ``reason`` where a row is unusable.

    Camera, frame and track are required. A missing box counts as a zero box, a
    box with fewer than four numbers is rejected. Missing times become
    ``now_ms``, by default the time of the query.
    """
    now = now_ms if now_ms is not None else F.unix_millis(F.current_timestamp())
    keep = [F.col(c) for c in df.columns]
    j = F.from_json(column, _RAW, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    # numbers once more as doubles: 7.0 is truncated, the text "7.0" is not a number
    d = F.from_json(column, ", ".join(f"{c} double" for c in _WHOLE), {"mode": "PERMISSIVE"})
    raw = compute_once(compute_once(df, "_j", j), "_d", d).select(*keep, "_j.*", "_d")
    blank = F.lit("[0.0,0.0,0.0,0.0]")
    box_text = F.when(F.coalesce("bbox", F.lit("")).isin("", "null", "[]"), blank).otherwise(F.col("bbox"))
    typed = raw.withColumns(
        {
            "_frame": _whole("frame_id"),
            "_track": _whole("local_track_id"),
            "_score": F.when(F.col("score").isNull(), F.lit(0.0)).otherwise(_cast("score", "double")),
            "_ts": F.when(F.col("timestamp_ms").isNull(), now).otherwise(_whole("timestamp_ms")),
            "_received": F.when(F.col("received_at_ms").isNull(), now).otherwise(_whole("received_at_ms")),
            "_box": F.slice(F.from_json(box_text, "array<double>"), 1, 4),
            "_camera": names.camera_id(F.col("camera_id")),
        }
    )
    missing = F.col("camera_id").isNull() | F.col("frame_id").isNull() | F.col("local_track_id").isNull()
    bad_number = F.lit(False)
    for c in ("_frame", "_track", "_score", "_ts", "_received"):
        bad_number = bad_number | F.col(c).isNull()
    short = F.col("_box").isNull() | (F.size("_box") < 4) | F.exists("_box", lambda x: x.isNull())
    reason = (
        F.when(F.col("_bad").isNotNull() | F.col(column).isNull(), "bad_json")
        .when(missing, "missing_field")
        .when(bad_number, "bad_number")
        .when(short, "short_bbox")
    )
    default_id = F.concat_ws("_", F.lit("det"), "_camera", "_frame", "_track")
    return typed.select(
        *keep,
        reason.alias("reason"),
        F.coalesce("schema_version", F.lit("1.0")).alias("schema_version"),
        F.coalesce("event_id", default_id).alias("event_id"),
        F.coalesce("source", F.lit("pphuman")).alias("source"),
        F.coalesce("run_id", F.lit("")).alias("run_id"),
        F.col("_camera").alias("camera_id"),
        F.col("_frame").alias("frame_id"),
        F.col("_ts").alias("timestamp_ms"),
        F.col("_received").alias("received_at_ms"),
        F.col("_track").alias("local_track_id"),
        F.col("_box").alias("bbox"),
        F.col("_score").alias("score"),
        "crop_path",
        F.from_json("embedding", "array<float>").alias("embedding"),
        F.nullif("frame_uri", F.lit("")).alias("frame_uri"),
    )


def parse_detections(df: DataFrame, column: str = "value", now_ms: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(good, rejected) detections; see :func:`judge_detections`."""
    judged = judge_detections(df, column, now_ms)
    return judged.where("reason IS NULL").drop("reason"), judged.where("reason IS NOT NULL").select(*df.columns, "reason")


def parse_mot(df: DataFrame, column: str = "value") -> DataFrame:
    """Boxes from ``frame,id,x1,y1,w,h,score,...`` lines; other lines are skipped."""
    keep = [c for c in df.columns if c != column]
    parts = compute_once(df, "p", F.split(F.trim(column), ",")).where(F.size("p") >= 7)
    cast = parts.select(
        *keep,
        F.expr("try_cast(p[0] AS bigint)").alias("frame_id"),
        F.expr("try_cast(p[1] AS bigint)").alias("local_track_id"),
        *[F.expr(f"try_cast(p[{i}] AS double)").alias(n) for i, n in ((2, "x1"), (3, "y1"), (4, "w"), (5, "h"), (6, "score"))],
    ).na.drop(subset=["frame_id", "local_track_id", "x1", "y1", "w", "h", "score"])
    return cast.select(
        *keep, "frame_id", "local_track_id", "x1", "y1", (F.col("x1") + F.col("w")).alias("x2"), (F.col("y1") + F.col("h")).alias("y2"), "score"
    )


def read_mot(spark: SparkSession, path: str) -> DataFrame:
    return parse_mot(spark.read.text(path))


def explode_tiles(df: DataFrame, column: str = "detections") -> DataFrame:
    """One row per box of a nested list, given as text or as arrays; elements with
    fewer than five numbers are dropped. ``idx`` is the element's position."""
    nested = F.col(column)
    if dict(df.dtypes)[column] == "string":
        nested = F.from_json(column, "array<array<double>>")
    keep = [c for c in df.columns if c != column]
    flat = df.select(*keep, F.posexplode(nested).alias("idx", "d")).where(
        (F.size("d") >= 5) & ~F.exists(F.slice("d", 1, 5), lambda x: x.isNull())
    )
    return flat.select(*keep, "idx", *[F.col("d")[i].alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2", "score"))])


def label_segments(df: DataFrame, column: str = "value") -> DataFrame:
    """(person, segment) rows from label documents in a text column."""
    doc = df.select(F.from_json(column, schemas.LABEL_FILE).alias("d")).select("d.*")
    return _segments(doc)


def read_label_segments(spark: SparkSession, path: str) -> DataFrame:
    return _segments(spark.read.schema(schemas.LABEL_FILE).json(path, multiLine=True))


def _segments(doc: DataFrame) -> DataFrame:
    people = doc.select("dataset_name", "site_id", "fps", F.explode("global_persons").alias("p"))
    return people.select(
        "dataset_name", "site_id", "fps", F.col("p.global_person_id").alias("global_person_id"), F.explode("p.segments").alias("s")
    ).select("dataset_name", "site_id", "fps", "global_person_id", "s.*")


def tracklet_labels(df: DataFrame, column: str = "value") -> DataFrame:
    """(tracklet, identity) rows from flat JSON maps."""
    return df.select(F.explode(F.from_json(column, "map<string,string>")).alias("tracklet_id", "global_id"))


# ---- dimensions -----------------------------------------------------------------
def _valid(df: DataFrame, required: list[str]) -> DataFrame:
    ok = F.lit(True)
    for c in required:
        ok = ok & F.col(c).isNotNull()
    return df.where(ok)


def cameras(df: DataFrame, column: str = "value") -> DataFrame:
    """Cameras from JSON text, defaults filled in, unusable rows left out."""
    raw = df.select(
        F.from_json(column, "camera_id string, name string, rtsp_url_env_key string, width string, height string, fps_target string, is_active string").alias("c")
    ).select("c.*")
    typed = raw.select(
        "camera_id",
        F.coalesce("name", "camera_id").alias("name"),
        "rtsp_url_env_key",
        _cast("width", "int").alias("width"),
        _cast("height", "int").alias("height"),
        F.when(F.col("fps_target").isNull(), 25).otherwise(_cast("fps_target", "int")).alias("fps_target"),
        F.coalesce(_cast("is_active", "boolean"), F.lit(True)).alias("is_active"),
    )
    return _valid(typed, ["camera_id", "rtsp_url_env_key", "width", "height", "fps_target"])


def zones(df: DataFrame, column: str = "value") -> DataFrame:
    raw = df.select(
        F.from_json(
            column,
            "zone_id string, camera_id string, name string, polygon_json string, zone_type string, is_entry_zone boolean, is_exit_zone boolean, enabled boolean",
        ).alias("z")
    ).select("z.*")
    typed = raw.withColumns(
        {
            "name": F.coalesce("name", "zone_id"),
            "zone_type": F.coalesce("zone_type", F.lit("floor")),
            "is_entry_zone": F.coalesce("is_entry_zone", F.lit(False)),
            "is_exit_zone": F.coalesce("is_exit_zone", F.lit(False)),
            "enabled": F.coalesce("enabled", F.lit(True)),
        }
    )
    return _valid(typed, ["zone_id", "camera_id", "polygon_json"])


def camera_links(df: DataFrame, column: str = "value") -> DataFrame:
    raw = df.select(
        F.from_json(
            column,
            "from_camera_id string, to_camera_id string, min_travel_seconds string, max_travel_seconds string, transition_probability string, enabled boolean, notes string",
        ).alias("l")
    ).select("l.*")

    def number(c: str, kind: str) -> Column:
        return F.when(F.col(c).isNull(), F.lit(0).cast(kind)).otherwise(_cast(c, kind)).alias(c)

    typed = raw.select(
        "from_camera_id",
        "to_camera_id",
        number("min_travel_seconds", "int"),
        number("max_travel_seconds", "int"),
        number("transition_probability", "double"),
        F.coalesce("enabled", F.lit(True)).alias("enabled"),
        F.coalesce("notes", F.lit("")).alias("notes"),
    )
    return _valid(typed, ["from_camera_id", "to_camera_id", "min_travel_seconds", "max_travel_seconds", "transition_probability"])


def load_dimensions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cameras, zones and links from ``cameras.json``, ``zones.json`` and
    ``camera_links.json`` (one object per line) in a folder."""
    text = spark.read.text
    return (
        cameras(text(f"{path}/cameras.json")),
        zones(text(f"{path}/zones.json")),
        camera_links(text(f"{path}/camera_links.json")),
    )
