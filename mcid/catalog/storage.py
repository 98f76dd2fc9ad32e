"""Sources, sinks, upserts, manifests and retention."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import Views
from ..fixtures.sql_views import register_view
from ..operators import embedding, identity
from ..session import shared_dir
from ..sources import readers, writers
from . import query
from .scores import decisions

NOW_MS = 1706659200000


def judged(v: Views) -> DataFrame:
    return readers.judge_detections(v.raw_json, now_ms=F.lit(NOW_MS))


@query(
    "src_detections",
    "det",
    f"""
    SELECT det_id, CASE k WHEN 7 THEN 'bad_json' WHEN 17 THEN 'bad_number' WHEN 27 THEN 'short_bbox' WHEN 37 THEN 'missing_field' ELSE 'ok' END AS status,
      CASE WHEN good THEN camera_id END AS camera_id, CASE WHEN good THEN 'det_' || camera_id || '_' || frame_id || '_' || local_track_id END AS event_id,
      CASE WHEN k = 47 THEN {NOW_MS} WHEN good THEN ts_ms ELSE -1 END AS ts_ms,
      CASE WHEN k = 47 THEN 0 WHEN good THEN x1 END AS x1, CASE WHEN k = 47 THEN 0 WHEN good THEN y2 END AS y2, CASE WHEN k = 47 THEN 0 WHEN good THEN score END AS score
    FROM (SELECT *, det_id % 50 AS k, det_id % 50 NOT IN (7, 17, 27, 37) AS good FROM det)""",
)
def src_detections(v: Views) -> DataFrame:
    rows = judged(v)
    ok = F.col("reason").isNull()
    return rows.select(
        "det_id",
        F.coalesce("reason", F.lit("ok")).alias("status"),
        F.when(ok, F.col("camera_id")).alias("camera_id"),
        F.when(ok, F.col("event_id")).alias("event_id"),
        F.when(ok, F.col("timestamp_ms")).otherwise(-1).alias("ts_ms"),
        F.when(ok, F.get("bbox", F.lit(0))).alias("x1"),
        F.when(ok, F.get("bbox", F.lit(3))).alias("y2"),
        F.when(ok, F.col("score")).alias("score"),
    )


@query(
    "src_mot_text",
    "det",
    """
    SELECT det_id, frame_id, local_track_id, x1, y1, x1 + (x2 - x1) AS x2, y1 + (y2 - y1) AS y2, score FROM det WHERE det_id % 40 NOT IN (9, 19)""",
)
def src_mot_text(v: Views) -> DataFrame:
    k = F.col("det_id") % 40
    nums = [F.col("x1"), F.col("y1"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("score")]
    line = F.concat_ws(",", "frame_id", "local_track_id", *nums, F.lit("-1"), F.lit("-1"), F.lit("-1"))
    text = F.when(k == 9, F.concat_ws(",", "frame_id", "local_track_id", "x1")).when(k == 19, F.replace(line, F.lit(","), F.lit(",x"))).otherwise(line)
    return readers.parse_mot(v.detections.select("det_id", text.alias("value")))


@query(
    "src_tile_detections",
    "aux",
    """
    SELECT aux_id, 0 AS idx, x1, y1, x2, y2, score FROM aux UNION ALL SELECT aux_id, 2, x1 + 5, y1 + 5, x2 + 5, y2 + 5, score / 2 FROM aux""",
)
def src_tile_detections(v: Views) -> DataFrame:
    """Nested boxes as text; the middle element of each list is too short."""
    box = F.format_string("[%s,%s,%s,%s,%s]", "x1", "y1", "x2", "y2", "score")
    other = F.format_string(
        "[%s,%s,%s,%s,%s]", *[F.col(c) + 5 for c in ("x1", "y1", "x2", "y2")], F.col("score") / 2
    )
    text = F.format_string("[%s,[1.0,2.0],%s]", box, other)
    return readers.explode_tiles(v.aux.select("aux_id", text.alias("detections")))


@query(
    "src_labels",
    "ev",
    """
    SELECT 'P' || user_id AS global_person_id, camera_id, event_id AS start_frame, event_id + 40 AS end_frame, (event_id % 100)::DOUBLE AS start_time,
           'ok' AS quality_flag FROM ev
    UNION ALL SELECT 'P' || user_id, 'CAM_09', event_id + 50, event_id + 60, 5.5::DOUBLE, 'partial_exit' FROM ev""",
)
def src_labels(v: Views) -> DataFrame:
    """One label document per event, with one person and two segments."""
    doc = F.format_string(
        '{"dataset_name":"d","site_id":"s","fps":10,"global_persons":[{"global_person_id":"P%d","segments":['
        '{"camera_id":"%s","start_frame":%d,"end_frame":%d,"start_time":%d.0,"end_time":50.0,"quality_flag":"ok"},'
        '{"camera_id":"CAM_09","start_frame":%d,"end_frame":%d,"start_time":5.5,"end_time":9.0,"tracklet_id_hint":null,"quality_flag":"partial_exit"}]}]}',
        "user_id", "camera_id", "event_id", F.col("event_id") + 40, F.col("event_id") % 100, F.col("event_id") + 50, F.col("event_id") + 60,
    )
    rows = readers.label_segments(v.events.select(doc.alias("value")))
    return rows.select("global_person_id", "camera_id", "start_frame", "end_frame", "start_time", "quality_flag")


@query(
    "src_tracklet_labels",
    "ev",
    """
    SELECT 'T' || event_id AS tracklet_id, 'G' || user_id AS global_id FROM ev UNION ALL SELECT 'T' || event_id || 'b', 'G' || (user_id + 1) FROM ev""",
)
def src_tracklet_labels(v: Views) -> DataFrame:
    doc = F.format_string('{"T%d":"G%d","T%db":"G%d"}', "event_id", "user_id", "event_id", F.col("user_id") + 1)
    return readers.tracklet_labels(v.events.select(doc.alias("value")))


@query(
    "src_dimensions",
    "ev",
    """
    SELECT 'camera' AS kind, 'C' || event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'C' || event_id ELSE 'Cam ' || event_id END AS name,
           CASE WHEN event_id % 4 = 0 THEN '25' ELSE '15' END AS detail FROM ev WHERE event_id % 5 <> 2
    UNION ALL SELECT 'zone', 'Z' || event_id, 'Z' || event_id, CASE WHEN event_id % 4 = 0 THEN 'floor' ELSE 'vip' END FROM ev WHERE event_id % 6 <> 1
    UNION ALL SELECT 'link', 'C' || event_id || '-D', '', CASE WHEN event_id % 3 = 0 THEN '0' ELSE '30' END FROM ev WHERE event_id % 7 <> 3""",
)
def src_dimensions(v: Views) -> DataFrame:
    e = F.col("event_id")

    def text(*parts) -> DataFrame:
        return v.events.select(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("value"))

    def part(cond, fmt: str):
        return F.when(cond, F.format_string(fmt, *["event_id"] * fmt.count("%d")))

    always = F.lit(True)
    cams = text(
        part(always, '"camera_id":"C%d","rtsp_url_env_key":"K","height":1080'),
        part(e % 3 != 0, '"name":"Cam %d"'),
        part(e % 4 != 0, '"fps_target":15'),
        F.when(e % 5 == 2, F.lit('"width":"wide"')).otherwise(F.lit('"width":1920')),
    )
    zones = text(
        part(always, '"zone_id":"Z%d","camera_id":"C"'), part(e % 4 != 0, '"zone_type":"vip"'), part(e % 6 != 1, '"polygon_json":"[[0,0],[1,0],[1,1]]"')
    )
    links = text(
        part(always, '"from_camera_id":"C%d"'), part(e % 3 != 0, '"min_travel_seconds":30'), part(e % 7 != 3, '"to_camera_id":"D"')
    )
    return (
        readers.cameras(cams)
        .select(F.lit("camera").alias("kind"), F.col("camera_id").alias("id"), "name", F.col("fps_target").cast("string").alias("detail"))
        .unionByName(readers.zones(zones).select(F.lit("zone").alias("kind"), F.col("zone_id").alias("id"), "name", F.col("zone_type").alias("detail")))
        .unionByName(
            readers.camera_links(links).select(
                F.lit("link").alias("kind"), F.concat_ws("-", "from_camera_id", "to_camera_id").alias("id"), F.lit("").alias("name"), F.col("min_travel_seconds").cast("string").alias("detail")
            )
        )
    )


# ---- sinks ------------------------------------------------------------------------
@query(
    "sink_append",
    "zev",
    "SELECT strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d') AS dt, camera_id, tracklet_id, zone_id, event_type FROM zev",
)
def sink_append(v: Views) -> DataFrame:
    """Append zone events and read them back from their partitions."""
    path = f"{shared_dir(v.spark)}/mcid-append-{uuid.uuid4().hex}"
    writers.append(v.zone_events.select("global_id", "tracklet_id", "camera_id", "zone_id", "event_type", "ts_ms"), path)
    back = v.spark.read.schema("global_id string, tracklet_id string, zone_id string, event_type string, ts_ms bigint, dt string, camera_id string").parquet(path)
    return back.select("dt", "camera_id", "tracklet_id", "zone_id", "event_type")


STORED = "event_id % 3 = 0"  # rows of the derived tables that play the stored part


def point_keys(v: Views) -> DataFrame:
    """Point keys arriving twice each."""
    once = v.events.select(F.lit("people").alias("collection"), F.concat(F.lit("P"), "event_id").alias("point_id"), "event_id")
    return once.unionByName(once)


@query("sink_embeddings", "ev", f"SELECT 'people' AS collection, 'P' || event_id AS point_id FROM ev WHERE NOT {STORED}")
def sink_embeddings(v: Views) -> DataFrame:
    fresh = writers.new_rows(point_keys(v), point_keys(v).where(STORED), ["collection", "point_id"])
    return fresh.select("collection", "point_id")


@query("new_points", "ev", f"SELECT 'P' || event_id AS point_id FROM ev WHERE NOT {STORED}")
def new_points(v: Views) -> DataFrame:
    keys = point_keys(v).select("point_id").distinct()
    return keys.exceptAll(keys.where("cast(substring(point_id, 2) as bigint) % 3 = 0"))


@query(
    "upsert_dims",
    "ev",
    """
    SELECT 'C' || user_id AS camera_id, arg_max(value, event_id) AS value, max(event_id) AS version FROM ev GROUP BY 1""",
)
def upsert_dims(v: Views) -> DataFrame:
    rows = v.events.select(F.concat(F.lit("C"), "user_id").alias("camera_id"), "value", F.col("event_id").alias("version"), "event_type")
    # the first hundred versions, reduced to one row per key, are the stored table
    stored = writers.upsert_latest(rows.limit(0), rows.where("version < 100"), ["camera_id"], "version")
    return writers.upsert_latest(stored, rows.where("version >= 100"), ["camera_id"], "version").drop("event_type")


@query(
    "upsert_tracklets",
    "tl",
    f"""
    WITH o AS (SELECT * FROM tl WHERE event_id % 3 <> 1),
    n AS (SELECT tracklet_id, camera_id, start_ms + 1 AS start_ms, CASE WHEN event_id % 4 = 0 THEN start_ms + 9 END AS end_ms, end_zone_id, quality_score, frame_count + 2 AS frame_count FROM tl WHERE event_id % 3 <> 2)
    SELECT coalesce(o.tracklet_id, n.tracklet_id) AS tracklet_id, CASE WHEN o.tracklet_id IS NOT NULL THEN o.start_ms ELSE n.start_ms END AS start_ms,
           coalesce(n.end_ms, o.end_ms, -1) AS end_ms, coalesce(n.end_zone_id, o.end_zone_id) AS end_zone_id,
           coalesce(n.quality_score, o.quality_score) AS quality_score, CASE WHEN n.tracklet_id IS NOT NULL THEN n.frame_count ELSE o.frame_count END AS frame_count
    FROM o FULL JOIN n USING (tracklet_id)""",
)
def upsert_tracklets(v: Views) -> DataFrame:
    t = v.tracklets
    incoming = t.where("event_id % 3 <> 2").withColumns(
        {
            "end_ms": F.when(F.col("event_id") % 4 == 0, F.col("start_ms") + 9),
            "start_ms": F.col("start_ms") + 1,
            "frame_count": F.col("frame_count") + 2,
        }
    )
    out = writers.upsert_tracklets(t.where("event_id % 3 <> 1"), incoming)
    return out.select("tracklet_id", "start_ms", F.coalesce("end_ms", F.lit(-1)).alias("end_ms"), "end_zone_id", "quality_score", "frame_count")


register_view(
    "idsplit",
    """
    SELECT 'G' || user_id AS global_id, ts_ms < 1705276800000 AS old, min(ts_ms) AS first_seen_ms, max(ts_ms) AS last_seen_ms,
           arg_min(camera_id, (ts_ms, camera_id)) AS first_camera_id, arg_max(camera_id, (ts_ms, camera_id)) AS last_camera_id FROM ev GROUP BY 1, 2""",
    ["ev"],
)


@query(
    "upsert_identities",
    "idsplit",
    """
    SELECT global_id, min(first_seen_ms) AS first_seen_ms, max(last_seen_ms) AS last_seen_ms, arg_min(first_camera_id, first_seen_ms) AS first_camera_id,
           arg_max(last_camera_id, (last_seen_ms, last_camera_id)) AS last_camera_id FROM idsplit GROUP BY 1""",
)
def upsert_identities(v: Views) -> DataFrame:
    seen = v.events.select(F.concat(F.lit("G"), "user_id").alias("global_id"), "camera_id", "ts_ms")
    middle = F.lit(1705276800000)
    stored = identity.rollup(seen.where(F.col("ts_ms") < middle)).drop("tracklets")
    incoming = identity.rollup(seen.where(F.col("ts_ms") >= middle)).drop("tracklets")
    out = writers.upsert_identities(stored, incoming)
    return out.select("global_id", "first_seen_ms", "last_seen_ms", "first_camera_id", "last_camera_id")


@query("set_tracklet_gid", "tl dec", "SELECT tl.tracklet_id, assigned_global_id AS global_id FROM tl LEFT JOIN dec USING (tracklet_id)")
def set_tracklet_gid(v: Views) -> DataFrame:
    return writers.set_global_id(v.tracklets.drop("truth_id"), decisions(v)).select("tracklet_id", "global_id")


@query(
    "set_point_gid",
    "tl dec",
    """
    SELECT tracklet_id || ':' || i AS point_id, assigned_global_id AS global_id FROM (SELECT *, unnest(range(embedding_count)) AS i FROM tl) LEFT JOIN dec USING (tracklet_id)""",
)
def set_point_gid(v: Views) -> DataFrame:
    points = v.tracklets.select("tracklet_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("embedding_count") - 1)).alias("i"))
    out = writers.set_global_id(points, decisions(v))
    return out.select(F.concat_ws(":", "tracklet_id", "i").alias("point_id"), "global_id")


@query(
    "rekey_manifest",
    "dec tl",
    """
    SELECT tracklet_id, 'evidence/pending/site_1/' || d.camera_id || '/' || tracklet_id || '/best.jpg' AS pending_key,
      's3://crops/evidence/site_1/' || d.camera_id || '/' || coalesce(end_zone_id, 'Z_NONE') || '/' || strftime(make_timestamp(d.ts_ms * 1000), '%Y/%m/%d')
        || '/' || assigned_global_id || '/' || tracklet_id || '/best.jpg' AS best_crop_uri
    FROM dec d JOIN tl USING (tracklet_id) WHERE decision IN ('new', 'match') AND assigned_global_id IS NOT NULL AND best_crop_uri IS NOT NULL""",
)
def rekey_manifest(v: Views) -> DataFrame:
    zones = v.tracklets.select("tracklet_id", "end_zone_id")
    listing = v.tracklets.where("best_crop_uri IS NOT NULL").select(F.substring("best_crop_uri", 12, 1 << 20).alias("key"))
    out = writers.rekey_manifest(decisions(v).join(zones, "tracklet_id"), listing, "crops", "site_1")
    return out.select("tracklet_id", "pending_key", "best_crop_uri")


@query(
    "retention",
    "ident det tl",
    f"""
    SELECT (SELECT count(*) FROM ident WHERE last_seen_ms < {NOW_MS} - 86400000) AS identities_expired, (SELECT count(*) FROM det WHERE ts_ms < {NOW_MS} - 604800000) AS events_deleted,
           (SELECT count(*) FROM tl WHERE start_ms < {NOW_MS} - 86400000) AS vectors_deleted, (SELECT count(*) FROM tl WHERE start_ms < {NOW_MS} - 604800000) AS objects_deleted,
           (SELECT count(*) FROM det WHERE ts_ms >= {NOW_MS} - 604800000) AS events_left""",
)
def retention(v: Views) -> DataFrame:
    from .identity import sightings

    kept, summary = writers.retention(
        identity.rollup(sightings(v)),
        v.detections,
        v.tracklets.select(F.col("start_ms").alias("ts_ms")),
        v.tracklets.select(F.col("start_ms").alias("modified_ms")),
        F.lit(NOW_MS),
    )
    left = kept["events"].agg(F.count("*")).scalar()
    return summary.drop("dry_run").withColumn("events_left", left)


@query(
    "table_counts",
    "ev det zev",
    """
    SELECT 'events' AS table_name, count(*) AS rows FROM ev UNION ALL SELECT 'detections', count(*) FROM det UNION ALL SELECT 'zone_events', count(*) FROM zev""",
)
def table_counts(v: Views) -> DataFrame:
    return writers.table_counts({"events": v.events, "detections": v.detections, "zone_events": v.zone_events})


# ---- vectors made by user code -------------------------------------------------------
@query(
    "embed_crops",
    "det",
    """
    SELECT det_id, round([3/13, 1/3, 2/7, 1/9][det_id % 4 + 1], 5) AS e1, round([12/13, 2/3, 6/7, 8/9][det_id % 4 + 1], 5) AS e3 FROM det""",
)
def embed_crops(v: Views) -> DataFrame:
    """A stand-in model: one of four directions, as long as the box is far right."""

    def model(rows):
        ways = np.array([[3, 4, 12], [1, 2, 2], [2, 3, 6], [1, 4, 8]], dtype=float)
        return ways[rows["det_id"].to_numpy() % 4] * (rows["x1"].to_numpy() + 1.0)[:, None]

    out = embedding.embed_crops(v.detections.select("det_id", "x1"), model, 3)
    rounded = [F.round(F.col("embedding")[i].cast("double"), 5).alias(f"e{i + 1}") for i in (0, 2)]
    return out.select("det_id", *rounded)


from .detections import MEAN_SQL, _mean_columns  # noqa: E402


@query("mean_vector", "points", MEAN_SQL)
def mean_vector(v: Views) -> DataFrame:
    """The aggregate called from SQL."""
    embedding.register_mean_vector(v.spark)
    v.points.createOrReplaceTempView("mcid_points")
    out = v.spark.sql("SELECT truth_id, camera_id, mean_vector(vector) AS m FROM mcid_points GROUP BY truth_id, camera_id")
    return _mean_columns(out, "m")
