"""Detections to tracklets: zones, unions, suppression, tracking, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import Views
from ..fixtures.sql_views import register_view
from ..operators import detections, tracklets, zoning
from . import query
from .boxes import CONTAINS, CROPS, crop_scores

register_view(
    "zpoly",
    """
    SELECT zone_id, camera_id, ord, list_transform(polygon_json::JSON::DOUBLE[][], lambda p:
             [round_even(p[1] * width, 0), round_even(p[2] * height, 0)]) AS p, width, height
    FROM zones JOIN cameras USING (camera_id) WHERE enabled""",
    ["zones", "cameras"],
)
register_view(
    "zoned",
    f"""
    SELECT det.*, zone_id FROM det LEFT JOIN (
      SELECT det_id, arg_min(zone_id, ord) AS zone_id FROM (
        SELECT det_id, zone_id, ord, p, (x1 + x2) / 2 / width * width AS px, (y1 + y2) / 2 / height * height AS py
        FROM det JOIN zpoly USING (camera_id)) WHERE {CONTAINS} GROUP BY 1) USING (det_id)""",
    ["det", "zpoly"],
)


def zoned(v: Views) -> DataFrame:
    return zoning.assign_zone(v.detections, v.zones, v.cameras)


@query("join_zone", "zoned", "SELECT det_id, zone_id FROM zoned")
def join_zone(v: Views) -> DataFrame:
    return zoned(v).select("det_id", "zone_id")


# ---- detector union -----------------------------------------------------------
def frames(v: Views) -> DataFrame:
    return v.detections.select("camera_id", "frame_no", (F.col("frame_no") * 200).alias("ts_ms")).distinct()


def aux_events(v: Views) -> DataFrame:
    """Times of auxiliary events; every seventh has lost its clock."""
    return v.aux.select(
        "camera_id",
        F.expr("ts_ms div 200").alias("frame_no"),
        F.when(F.col("ts_ms") % 7 != 3, F.col("ts_ms")).alias("ts_ms"),
    ).distinct()


register_view(
    "nearest",
    """
    SELECT f.camera_id, f.frame_no, t.event_ms, CASE WHEN t.event_ms IS NULL THEN u.event_frame END AS event_frame
    FROM (SELECT DISTINCT camera_id, frame_no, frame_no * 200 AS ts_ms FROM det) f
    LEFT JOIN (SELECT camera_id, (ts_ms // 200) AS frame_no, max(ts_ms) AS event_ms FROM aux
               WHERE ts_ms % 7 <> 3 AND ts_ms % 200 <= 50 GROUP BY 1, 2) t USING (camera_id, frame_no)
    LEFT JOIN (SELECT camera_id, frame_no + d AS frame_no, max(frame_no) AS event_frame
               FROM (SELECT DISTINCT camera_id, ts_ms // 200 AS frame_no FROM aux WHERE ts_ms % 7 = 3), (VALUES (-1), (0), (1)) x(d)
               GROUP BY 1, 2) u USING (camera_id, frame_no)""",
    ["det", "aux"],
)
register_view(
    "unioned",
    """
    SELECT camera_id, frame_no, det_id AS box_id, x1, y1, x2, y2, score, 'pphuman' AS source FROM det
    UNION ALL
    SELECT a.camera_id, n.frame_no, a.aux_id, a.x1, a.y1, a.x2, a.y2, a.score, 'sahi'
    FROM aux a JOIN nearest n ON a.camera_id = n.camera_id AND a.ts_ms = n.event_ms WHERE a.score >= 0.4""",
    ["det", "aux", "nearest"],
)


@query(
    "merge_nearest",
    "nearest",
    "SELECT camera_id, frame_no, coalesce(event_ms, -1) AS event_ms, coalesce(event_frame, -1) AS event_frame FROM nearest",
)
def merge_nearest(v: Views) -> DataFrame:
    near = detections.nearest_event(frames(v), aux_events(v))
    return near.select(
        "camera_id",
        "frame_no",
        F.coalesce("event_ms", F.lit(-1)).alias("event_ms"),
        F.coalesce("event_frame", F.lit(-1)).alias("event_frame"),
    )


def unioned(v: Views) -> DataFrame:
    near = detections.nearest_event(frames(v), aux_events(v))
    return detections.union_boxes(
        v.detections.withColumnRenamed("det_id", "box_id"), v.aux.withColumnRenamed("aux_id", "box_id"), near
    )


@query("union_detections", "unioned", "SELECT camera_id, frame_no, box_id, x1, y1, x2, y2, score, source FROM unioned")
def union_detections(v: Views) -> DataFrame:
    return unioned(v).select("camera_id", "frame_no", "box_id", "x1", "y1", "x2", "y2", "score", "source")


IOU = """greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))
   / nullif((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1)
     - greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)), 0)"""

NMS_SQL = f"""
    WITH RECURSIVE box AS (
      SELECT *, row_number() OVER (PARTITION BY camera_id, frame_no ORDER BY score DESC, source <> 'pphuman', box_id, x1, y1, x2, y2) AS k FROM unioned),
    pair AS (SELECT a.camera_id, a.frame_no, a.k AS ka, b.k AS kb, a.source <> b.source AS crossing
             FROM box a JOIN box b ON a.camera_id = b.camera_id AND a.frame_no = b.frame_no AND a.k < b.k
             WHERE {IOU} > 0.5),
    beaten AS (SELECT camera_id, frame_no, kb, list(ka) AS winners FROM pair GROUP BY 1, 2, 3),
    walk AS (
      SELECT camera_id, frame_no, k, [k] AS kept FROM box WHERE k = 1
      UNION ALL
      SELECT w.camera_id, w.frame_no, n.k,
             CASE WHEN list_has_any(coalesce(t.winners, []), w.kept) THEN w.kept ELSE list_append(w.kept, n.k) END
      FROM walk w JOIN box n ON n.camera_id = w.camera_id AND n.frame_no = w.frame_no AND n.k = w.k + 1
      LEFT JOIN beaten t ON t.camera_id = n.camera_id AND t.frame_no = n.frame_no AND t.kb = n.k),
    final AS (SELECT camera_id, frame_no, unnest(arg_max(kept, k)) AS k FROM walk GROUP BY 1, 2),
    mixed_up AS (SELECT camera_id, frame_no, ka AS k FROM pair WHERE crossing UNION SELECT camera_id, frame_no, kb FROM pair WHERE crossing)
    SELECT box_id, camera_id, frame_no, score, CASE WHEN m.k IS NULL THEN source ELSE 'merged' END AS source
    FROM final JOIN box USING (camera_id, frame_no, k) LEFT JOIN mixed_up m USING (camera_id, frame_no, k)"""


@query("nms", "unioned", NMS_SQL)
def nms(v: Views) -> DataFrame:
    kept = detections.suppress(unioned(v), ["camera_id", "frame_no"])
    return kept.select("box_id", "camera_id", "frame_no", "score", "source")


TILE_NMS_SQL = f"""
    WITH RECURSIVE box AS (
      SELECT *, row_number() OVER (PARTITION BY camera_id, f ORDER BY score DESC, aux_id) AS k FROM (SELECT *, ts_ms // 200 AS f FROM aux)),
    beaten AS (SELECT a.camera_id, a.f, b.k AS kb, list(a.k) AS winners
             FROM box a JOIN box b ON a.camera_id = b.camera_id AND a.f = b.f AND a.k < b.k
             WHERE {IOU} >= 0.5 GROUP BY 1, 2, 3),
    walk AS (
      SELECT camera_id, f, k, [k] AS kept FROM box WHERE k = 1
      UNION ALL
      SELECT w.camera_id, w.f, n.k,
             CASE WHEN list_has_any(coalesce(t.winners, []), w.kept) THEN w.kept ELSE list_append(w.kept, n.k) END
      FROM walk w JOIN box n ON n.camera_id = w.camera_id AND n.f = w.f AND n.k = w.k + 1
      LEFT JOIN beaten t ON t.camera_id = n.camera_id AND t.f = n.f AND t.kb = n.k),
    final AS (SELECT camera_id, f, unnest(arg_max(kept, k)) AS k FROM walk GROUP BY 1, 2)
    SELECT aux_id, score FROM final JOIN box USING (camera_id, f, k)"""


@query("nms_tiles", "aux", TILE_NMS_SQL)
def nms_tiles(v: Views) -> DataFrame:
    """The tile variant: overlap of exactly the threshold suppresses too."""
    boxes_ = v.aux.withColumnRenamed("aux_id", "box_id").withColumn("f", F.expr("ts_ms div 200"))
    kept = detections.suppress(
        boxes_.select("camera_id", "f", "box_id", "x1", "y1", "x2", "y2", "score"), ["camera_id", "f"], 0.5, True, None
    )
    return kept.select(F.col("box_id").alias("aux_id"), "score")


ALONE = f"""
    SELECT a.* FROM aux a WHERE aux_id NOT IN (
      SELECT a.aux_id FROM (SELECT *, ts_ms // 1000 AS k FROM aux) a
      JOIN (SELECT *, unnest([ts_ms // 1000, ts_ms // 1000 + 1]) AS k FROM det) b ON a.camera_id = b.camera_id AND a.k = b.k
      WHERE b.ts_ms BETWEEN a.ts_ms - 1000 AND a.ts_ms AND {IOU} > 0.3)"""


@query("dedup_overlap", "det aux", f"SELECT aux_id FROM ({ALONE})")
def dedup_overlap(v: Views) -> DataFrame:
    return detections.drop_overlapping(v.aux, v.detections).select("aux_id")


AUX_TRACKLETS = f"""
    SELECT camera_id, ts_ms // 200 AS local_track_id, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms,
           count(*) - 1 AS embedding_count, count(*) AS sightings, arg_min(x1, aux_id) AS x1, TRUE AS provisional
    FROM ({ALONE}) GROUP BY 1, 2"""


def aux_table(v: Views) -> DataFrame:
    out = tracklets.auxiliary(v.aux, v.detections)
    return out.withColumn("x1", F.col("bbox")[0]).select(
        "camera_id", "local_track_id", "start_ms", "end_ms", "embedding_count", "sightings", "x1", "provisional"
    )


@query("aux_tracklets", "det aux", AUX_TRACKLETS)
def aux_tracklets(v: Views) -> DataFrame:
    return aux_table(v)


@query("provisional_gate", "det aux", f"SELECT * FROM ({AUX_TRACKLETS}) WHERE sightings >= 2")
def provisional_gate(v: Views) -> DataFrame:
    return tracklets.provisional_gate(aux_table(v))


@query(
    "frame_detections",
    "det ticks",
    """
    SELECT t.event_id, t.camera_id, t.frame_no, coalesce(d.det_id, -1) AS det_id, d.x1
    FROM (SELECT event_id, camera_id, ts_ms // 200 + event_id % 3 * 7 AS frame_no FROM ticks) t
    LEFT JOIN det d ON d.camera_id = t.camera_id AND d.frame_no = t.frame_no""",
)
def frame_detections(v: Views) -> DataFrame:
    asked = v.ticks.select(
        "event_id", "camera_id", (F.expr("ts_ms div 200") + F.col("event_id") % 3 * 7).alias("frame_no")
    )
    out = detections.frame_detections(asked, v.detections.select("camera_id", "frame_no", "det_id", "x1"))
    return out.select("event_id", "camera_id", "frame_no", F.coalesce("det_id", F.lit(-1)).alias("det_id"), "x1")


@query(
    "skip_frames",
    "ticks",
    """
    SELECT event_id, camera_id FROM (
      SELECT *, row_number() OVER (PARTITION BY camera_id ORDER BY ts_ms, event_id) AS n FROM ticks) WHERE n % 3 = 0""",
)
def skip_frames(v: Views) -> DataFrame:
    ticks = v.ticks.withColumnRenamed("event_id", "frame_key")
    return detections.skip_frames(ticks, 2).select(F.col("frame_key").alias("event_id"), "camera_id")


THIN_SQL = """
    WITH RECURSIVE t AS (
      SELECT *, sum(opens) OVER (PARTITION BY camera_id ORDER BY ts_ms) AS run FROM (
        SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER (PARTITION BY camera_id ORDER BY ts_ms) < 500 THEN 0 ELSE 1 END AS opens
        FROM (SELECT DISTINCT camera_id, ts_ms FROM det))),
    nxt AS (SELECT camera_id, run, ts_ms, min(ts_ms) OVER (PARTITION BY camera_id, run ORDER BY ts_ms
              RANGE BETWEEN 500 FOLLOWING AND UNBOUNDED FOLLOWING) AS due FROM t),
    walk AS (SELECT camera_id, run, min(ts_ms) AS ts_ms FROM t GROUP BY 1, 2
             UNION ALL
             SELECT w.camera_id, w.run, n.due FROM walk w JOIN nxt n USING (camera_id, run, ts_ms) WHERE n.due IS NOT NULL)
    SELECT camera_id, ts_ms FROM walk"""


@query("thin_rate", "det", THIN_SQL)
def thin_rate(v: Views) -> DataFrame:
    return detections.thin_rate(v.detections, 2.0)


# one row per run of frames that may share a track; a step takes its next frame
TRACK_SQL = """
    WITH RECURSIVE numbered AS (SELECT *, row_number() OVER (PARTITION BY camera_id ORDER BY frame_no, det_id) AS det_no FROM det),
    frame AS (
      SELECT camera_id, frame_no, list({'det': det_id, 'no': det_no, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2} ORDER BY det_id) AS boxes
      FROM numbered GROUP BY 1, 2),
    opened AS (SELECT *, CASE WHEN frame_no - lag(frame_no) OVER (PARTITION BY camera_id ORDER BY frame_no) < 32 THEN 0 ELSE 1 END AS opens FROM frame),
    run AS (SELECT *, sum(opens) OVER (PARTITION BY camera_id ORDER BY frame_no) AS run FROM opened),
    step AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY camera_id, run ORDER BY frame_no) AS n FROM run),
    walk AS (
      SELECT DISTINCT camera_id, run, 0::BIGINT AS n, 0::BIGINT AS frame_no, []::STRUCT(track BIGINT, seen BIGINT, age BIGINT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE)[] AS live,
             []::STRUCT(det BIGINT, track BIGINT, age BIGINT)[] AS done FROM step
      UNION ALL
      SELECT camera_id, run, n, frame_no,
        list_concat(
          list_filter(list_transform(held, lambda t, k: CASE WHEN list_position(claim, k) IS NULL THEN t ELSE
            {'track': t.track, 'seen': frame_no, 'age': t.age + 1, 'x1': boxes[list_position(claim, k)].x1, 'y1': boxes[list_position(claim, k)].y1,
             'x2': boxes[list_position(claim, k)].x2, 'y2': boxes[list_position(claim, k)].y2} END), lambda t: frame_no - t.seen <= 30),
          list_transform(list_filter(boxes, lambda b, i: claim[i] = 0), lambda b: {'track': b.no, 'seen': frame_no, 'age': 1, 'x1': b.x1, 'y1': b.y1, 'x2': b.x2, 'y2': b.y2})),
        list_filter(list_transform(boxes, lambda b, i: CASE WHEN claim[i] = 0 THEN {'det': b.det, 'track': b.no, 'age': 1}
          WHEN list_position(claim, claim[i]) = i THEN {'det': b.det, 'track': held[claim[i]].track, 'age': held[claim[i]].age + 1} END), lambda d: d IS NOT NULL)
      FROM (SELECT *, list_transform(ious, lambda o: CASE WHEN list_max(o) > 0.2 THEN list_position(o, list_max(o)) ELSE 0 END) AS claim
        FROM (SELECT *, list_transform(boxes, lambda b: list_transform(held, lambda t:
            greatest(0, least(b.x2, t.x2) - greatest(b.x1, t.x1)) * greatest(0, least(b.y2, t.y2) - greatest(b.y1, t.y1))
            / greatest(greatest(b.x2 - b.x1, 0) * greatest(b.y2 - b.y1, 0) + greatest(t.x2 - t.x1, 0) * greatest(t.y2 - t.y1, 0)
              - greatest(0, least(b.x2, t.x2) - greatest(b.x1, t.x1)) * greatest(0, least(b.y2, t.y2) - greatest(b.y1, t.y1)), 1e-6))) AS ious
          FROM (SELECT s.camera_id, s.run, s.n, s.frame_no, s.boxes, list_filter(w.live, lambda t: s.frame_no - t.seen <= 31) AS held
            FROM walk w JOIN step s ON s.camera_id = w.camera_id AND s.run = w.run AND s.n = w.n + 1))))
    SELECT camera_id, frame_no, d.det AS det_id, d.track AS track_id, d.age AS age, d.age >= 3 AS confirmed
    FROM (SELECT camera_id, frame_no, unnest(done) AS d FROM walk)"""


@query("iou_track", "det", TRACK_SQL)
def iou_track(v: Views) -> DataFrame:
    return detections.track_boxes(v.detections)


# ---- tracklets --------------------------------------------------------------------
SESSIONS = """
    (SELECT *, sum(opens) OVER (PARTITION BY camera_id, local_track_id ORDER BY ts_ms, det_id) AS run FROM (
      SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER (PARTITION BY camera_id, local_track_id ORDER BY ts_ms, det_id) < 3000
                THEN 0 ELSE 1 END AS opens FROM %s))"""

TRACKLET_SQL = f"""
    SELECT substr(sha256(camera_id || '|' || local_track_id || '|' || start_ms), 1, 16) AS tracklet_id, * FROM (
      SELECT camera_id, local_track_id, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms,
             arg_min_null(zone_id, (ts_ms, det_id)) AS start_zone_id, arg_max_null(zone_id, (ts_ms, det_id)) AS end_zone_id,
             count(*) AS frame_count,
             array_to_string(list(concat_ws(' ', x1::BIGINT, y1::BIGINT, x2::BIGINT, y2::BIGINT) ORDER BY ts_ms, det_id)[1:15], ',') AS boxes
      FROM {SESSIONS % 'zoned'} GROUP BY camera_id, local_track_id, run HAVING count(*) >= 10)"""


@query("tracklet_build", "zoned", TRACKLET_SQL)
def tracklet_build(v: Views) -> DataFrame:
    built = tracklets.build(zoned(v), gap_ms=3000, min_detections=10)
    sides = F.transform("frame_bboxes", lambda b: F.array_join(F.transform(b, lambda x: x.cast("bigint").cast("string")), " "))
    return built.select(
        "tracklet_id", "camera_id", "local_track_id", "start_ms", "end_ms", "start_zone_id", "end_zone_id",
        "frame_count", F.array_join(sides, ",").alias("boxes"),
    )


@query(
    "best_crop",
    "det cameras",
    f"""
    SELECT camera_id, local_track_id, min(ts_ms) AS start_ms, arg_max('crop_' || det_id, (quality, -ts_ms, -det_id)) FILTER (quality > 0) AS best_crop_uri,
           round(max(quality) FILTER (quality > 0), 9) AS quality_score
    FROM {SESSIONS % CROPS} GROUP BY camera_id, local_track_id, run HAVING count(*) >= 10 OR count(*) FILTER (quality > 0) >= 5""",
)
def best_crop(v: Views) -> DataFrame:
    crops = crop_scores(v).withColumns(
        {"crop_uri": F.concat(F.lit("crop_"), "det_id"), "zone_id": F.lit(None).cast("string")}
    )
    built = tracklets.build(crops, gap_ms=3000, min_detections=10, max_crops=0)
    return built.select(
        "camera_id", "local_track_id", "start_ms", "best_crop_uri", F.round("quality_score", 9).alias("quality_score")
    )


@query(
    "stable_tracks",
    "det",
    """
    SELECT det_id, age_frames FROM (
      SELECT det_id, row_number() OVER (PARTITION BY camera_id, local_track_id ORDER BY ts_ms, det_id) AS age_frames FROM det)
    WHERE age_frames >= 15""",
)
def stable_tracks(v: Views) -> DataFrame:
    return tracklets.stable_tracks(v.detections).select("det_id", "age_frames")


MEAN_SQL = """
    WITH pos AS (
      SELECT truth_id, camera_id, i, avg(vector[i]) AS x FROM (SELECT truth_id, camera_id, vector, unnest(range(1, 65)) AS i FROM points) GROUP BY 1, 2, 3),
    mean AS (SELECT truth_id, camera_id, list(x ORDER BY i) AS m FROM pos GROUP BY 1, 2)
    SELECT truth_id, camera_id, unnest(range(1, 65))::INTEGER AS position, round(unnest(m) / n, 6) AS value
    FROM (SELECT *, sqrt(list_dot_product(m, m)) AS n FROM mean)"""


def _mean_columns(df: DataFrame, column: str) -> DataFrame:
    found = df.select("truth_id", "camera_id", F.posexplode(column).alias("p", "x"))
    return found.select("truth_id", "camera_id", (F.col("p") + 1).alias("position"), F.round("x", 6).alias("value"))


@query("mean_embedding", "points", MEAN_SQL)
def mean_embedding(v: Views) -> DataFrame:
    return _mean_columns(tracklets.mean_vectors(v.points, ["truth_id", "camera_id"], "vector"), "vector")
