"""Factors, decisions, names and times, one scalar rule per query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import Views
from ..fixtures.sql_views import register_view
from ..functions import names, scoring, times
from ..operators import sqlfunctions
from . import query

# The whole scoring chain as one SQL view, used by every check below.
register_view(
    "scored",
    """
    SELECT *,
      CASE WHEN top1_score IS NULL THEN 0::DOUBLE WHEN top2_score IS NULL THEN 1::DOUBLE ELSE top1_score - top2_score END AS margin,
      least(1, greatest(0, 0.55::DOUBLE * reid + 0.2::DOUBLE * t + 0.15::DOUBLE * cam + 0.05::DOUBLE * q + 0.05::DOUBLE * z)) AS final
    FROM (SELECT h.*, l.enabled AS link, coalesce(top1_score, 0) AS reid,
            exp(-(dt * dt) / 7200) AS t,
            CASE WHEN l.enabled IS NULL THEN 0.5::DOUBLE WHEN l.enabled THEN 1::DOUBLE ELSE 0::DOUBLE END AS cam,
            CASE WHEN quality_score IS NULL THEN 0.5::DOUBLE ELSE least(1, greatest(0, quality_score)) END AS q,
            CASE WHEN prev_zone_id = new_zone_id THEN 1::DOUBLE ELSE 0.5::DOUBLE END AS z
          FROM (SELECT *, CASE WHEN top1_score IS NULL THEN 0 ELSE time_diff_seconds END AS dt FROM hits) h
          LEFT JOIN links l ON l.from_camera_id = h.top1_camera_id AND l.to_camera_id = h.camera_id)""",
    ["hits", "links"],
)
register_view(
    "dec",
    """
    SELECT *, CASE WHEN decision IN ('match', 'new') THEN 'firm' WHEN decision = 'ambiguous' THEN 'ambiguous' ELSE 'held' END AS confidence_state,
      CASE WHEN decision = 'match' THEN top1_global_id
           WHEN decision = 'new' THEN 'GID-' || upper(substr(sha256(tracklet_id), 1, 8)) || '-' || split_part(camera_id, '_', 2) END AS assigned_global_id
    FROM (SELECT *, CASE WHEN top1_score IS NULL THEN 'new' WHEN link = FALSE THEN 'new'
        WHEN top1_score >= 0.95 AND margin > 0.05 THEN 'match' WHEN final >= 0.82 AND margin > 0.05 THEN 'match'
        WHEN final >= 0.72 AND margin > 0.05 THEN 'candidate' WHEN final >= 0.72 THEN 'ambiguous' ELSE 'new' END AS decision
      FROM scored)""",
    ["scored"],
)


def scored(v: Views) -> DataFrame:
    """Hits with link state and every factor of the score."""
    links = v.links.select(
        F.col("from_camera_id").alias("top1_camera_id"),
        F.col("to_camera_id").alias("camera_id"),
        F.col("enabled").alias("link"),
    )
    joined = v.decision_inputs.join(links, ["top1_camera_id", "camera_id"], "left")
    none = F.col("top1_score").isNull()
    parts = scoring.breakdown(
        F.coalesce("top1_score", F.lit(0.0)),
        F.when(none, 0.0).otherwise(F.col("time_diff_seconds")),
        F.col("link"),
        F.col("quality_score"),
        F.col("prev_zone_id"),
        F.col("new_zone_id"),
    )
    # withColumns reads every expression from the input row, so the tracklet's own
    # quality can give way to the factor of the same name
    return joined.withColumns(parts)


def decisions(v: Views) -> DataFrame:
    """Audit rows: factors, decision, state, assigned identity and reason."""
    d = scored(v).withColumn(
        "decision",
        scoring.decide(F.col("top1_score"), F.col("top2_score"), F.col("link"), F.col("final_score")),
    )
    gid = F.when(F.col("decision") == "match", F.col("top1_global_id")).when(
        F.col("decision") == "new", scoring.mint_global_id(F.col("tracklet_id"), F.col("camera_id"))
    )
    return d.withColumns(
        {"confidence_state": scoring.confidence_state(F.col("decision")), "assigned_global_id": gid}
    )


def _factor(name: str, column: str, sql_column: str):
    @query(name, "scored", f"SELECT event_id, round({sql_column}, 9) AS {name} FROM scored")
    def run(v: Views, column=column, name=name) -> DataFrame:
        return scored(v).select("event_id", F.round(column, 9).alias(name))


_factor("temporal_score", "temporal_score", "t")
_factor("topology_score", "camera_topology_score", "cam")
_factor("quality_default", "quality_score", "q")
_factor("zone_score", "zone_score", "z")
_factor("final_score", "final_score", "final")


@query("top2_margin", "scored", "SELECT event_id, round(margin, 9) AS margin FROM scored")
def top2_margin(v: Views) -> DataFrame:
    m = scoring.margin(F.col("top1_score"), F.col("top2_score"))
    return v.decision_inputs.select("event_id", F.round(m, 9).alias("margin"))


@query("decide", "dec", "SELECT event_id, decision FROM dec")
def decide(v: Views) -> DataFrame:
    return decisions(v).select("event_id", "decision")


@query(
    "decide_held",
    "scored",
    """
    SELECT event_id, CASE WHEN top1_score IS NULL OR link = FALSE THEN 'new'
        WHEN final >= 0.82 AND margin > 0.04 THEN 'match' WHEN final >= 0.72 AND margin > 0.04 THEN 'candidate'
        WHEN final >= 0.72 THEN 'held' ELSE 'new' END AS decision FROM scored""",
)
def decide_held(v: Views) -> DataFrame:
    """The same policy with the override off and ambiguity held."""
    policy = scoring.Policy(margin=0.04, override=None, new_id_when_ambiguous=False)
    d = scoring.decide(F.col("top1_score"), F.col("top2_score"), F.col("link"), F.col("final_score"), policy)
    return scored(v).select("event_id", d.alias("decision"))


@query("confidence_state", "dec", "SELECT event_id, confidence_state FROM dec")
def confidence_state(v: Views) -> DataFrame:
    return decisions(v).select("event_id", "confidence_state")


@query("global_id_mint", "ev", """
    SELECT event_id, 'GID-' || upper(substr(sha256('T' || event_id), 1, 8)) || '-' || split_part(camera_id, '_', 2) AS global_id FROM ev""")
def global_id_mint(v: Views) -> DataFrame:
    gid = scoring.mint_global_id(F.concat(F.lit("T"), "event_id"), F.col("camera_id"))
    return v.events.select("event_id", gid.alias("global_id"))


STAGE_SQL = """
    SELECT event_id, CASE WHEN coalesce(n, 0) = 0 THEN 'stage3_24h_fallback' ELSE 'stage2_3_combined' END AS stage,
           CASE WHEN coalesce(n, 0) = 0 THEN 0.92::DOUBLE ELSE 0.82::DOUBLE END AS threshold
    FROM ev LEFT JOIN (SELECT from_camera_id, count(*) AS n FROM links WHERE enabled GROUP BY 1) ON camera_id = from_camera_id"""


@query("stage_label", "ev links", STAGE_SQL)
def stage_label(v: Views) -> DataFrame:
    linked = v.links.where("enabled").groupBy(F.col("from_camera_id").alias("camera_id")).agg(F.count("*").alias("n"))
    stage = scoring.stage_label(F.coalesce("n", F.lit(0)), F.lit(1))
    return (
        v.events.join(linked, "camera_id", "left")
        .select("event_id", stage.alias("stage"))
        .withColumn("threshold", scoring.stage_threshold(F.col("stage")))
    )


@query(
    "reason_text",
    "dec",
    """
    SELECT event_id, printf('stage=%s decision=%s reid=%.3f topo=%.2f temporal=%.3f quality=%.3f zone=%.3f final=%.3f',
        'stage2_3_combined', decision, reid + 1e-9, cam, t + 1e-9, q + 1e-9, z, final + 1e-9) AS reason FROM dec""",
)
def reason_text(v: Views) -> DataFrame:
    # a billionth keeps exact decimal halves on one side in both printers
    d = decisions(v)
    up = {c: F.col(c) + 1e-9 for c in ("reid_similarity", "temporal_score", "quality_score", "final_score")}
    parts = {**up, "camera_topology_score": F.col("camera_topology_score"), "zone_score": F.col("zone_score")}
    return d.select("event_id", scoring.reason_text(F.lit("stage2_3_combined"), F.col("decision"), parts).alias("reason"))


# ---- times --------------------------------------------------------------------
@query("age_seconds", "ev", "SELECT event_id, greatest(0, (1704500000 - ts_ms // 1000)::DOUBLE) AS age FROM ev")
def age_seconds(v: Views) -> DataFrame:
    age = times.age_seconds(F.expr("ts_ms div 1000"), F.lit(1704500000))
    return v.events.select("event_id", age.alias("age"))


@query("within_window", "ev", "SELECT event_id FROM ev WHERE 1704500000000 - ts_ms <= 86400000")
def within_window(v: Views) -> DataFrame:
    return v.events.where(times.within_window(F.expr("ts_ms / 1000.0D"), F.lit(1704500000.0), 86_400)).select("event_id")


@query("session_id", "ev", "SELECT event_id, 'S-' || strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d') AS session_id FROM ev")
def session_id(v: Views) -> DataFrame:
    return v.events.select("event_id", times.session_id(F.col("ts_ms")).alias("session_id"))


@query(
    "to_unix_ms",
    "ev",
    "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN ts_ms ELSE (ts_ms // 1000) * 1000 END AS ms FROM ev",
)
def to_unix_ms(v: Views) -> DataFrame:
    raw = F.when(F.col("event_id") % 2 == 0, F.col("ts_ms").cast("double")).otherwise(F.expr("cast(ts_ms div 1000 as double)"))
    return v.events.select("event_id", times.to_unix_ms(raw).alias("ms"))


# ---- names ----------------------------------------------------------------------
RAW_NAME = "CASE WHEN event_id % 3 = 0 THEN 'cam' || (event_id % 140) || '_merged' WHEN event_id % 3 = 1 THEN ' cam_' || event_id % 9 ELSE 'cam' || event_id % 7 END"


@query(
    "norm_camera_id",
    "ev",
    f"""
    SELECT event_id, CASE WHEN event_id % 3 = 1 THEN upper(trim(raw))
        ELSE 'CAM_' || CASE WHEN length(d) < 2 THEN '0' || d ELSE d END END AS camera
    FROM (SELECT event_id, {RAW_NAME} AS raw, regexp_replace({RAW_NAME}, '[^0-9]', '', 'g') AS d FROM ev)""",
)
def norm_camera_id(v: Views) -> DataFrame:
    return v.events.select("event_id", names.camera_id(F.expr(RAW_NAME)).alias("camera"))


ZONE_TEXT = "concat('  Toys & Games ', event_type, ' Zone #', event_id % 12, ' ')"


@query("zone_key", "ev", f"SELECT event_id, replace({ZONE_TEXT}, ' ', '') AS key FROM ev")
def zone_key(v: Views) -> DataFrame:
    return v.events.select("event_id", names.zone_key(F.expr(ZONE_TEXT)).alias("key"))


@query("zone_lower", "ev", f"SELECT event_id, replace(lower({ZONE_TEXT}), ' ', '_') AS key FROM ev")
def zone_lower(v: Views) -> DataFrame:
    return v.events.select("event_id", names.zone_lower(F.expr(ZONE_TEXT)).alias("key"))


@query(
    "zone_slug",
    "ev",
    "SELECT event_id, 'toys-and-games-' || event_type || '-zone-' || (event_id % 12) AS slug FROM ev",
)
def zone_slug(v: Views) -> DataFrame:
    return v.events.select("event_id", names.zone_slug(F.expr(ZONE_TEXT)).alias("slug"))


@query(
    "topic_name",
    "ev",
    """
    SELECT event_id, CASE event_id % 5 WHEN 4 THEN 'site/people/+/command' ELSE 'site/people/cam' || (event_id % 9) || '/'
        || list_extract(['summary', 'attributes', 'event', 'status'], (event_id % 5 + 1)::INT) END AS topic FROM ev""",
)
def topic_name(v: Views) -> DataFrame:
    channel = F.element_at(
        F.array(*[F.lit(c) for c in ("telemetry", "attributes", "events", "status", "command")]),
        (F.col("event_id") % 5 + 1).cast("int"),
    )
    topic = names.topic_name(
        F.lit("/site/people/"), F.col("camera_id"), channel, F.concat(F.lit("cam_"), F.col("event_id") % 9)
    )
    return v.events.select("event_id", topic.alias("topic"))


@query(
    "evidence_paths",
    "tl",
    """
    SELECT tracklet_id, 'evidence/site_1/' || camera_id || '/' || start_zone_id || '/' || d || '/' || truth_id || '/' || tracklet_id || '/best.jpg' AS best,
      'evidence/site_1/' || camera_id || '/' || start_zone_id || '/' || d || '/' || truth_id || '/' || tracklet_id || '/debug_' || lpad(frame_count::VARCHAR, 6, '0') || '.jpg' AS debug,
      'evidence/pending/site_1/' || camera_id || '/' || tracklet_id || '/best.jpg' AS pending,
      'visualization/site_1/' || camera_id || '/' || d || '/first_3000_frames.mp4' AS visual,
      'reports/site_1/' || d || '/benchmark_' || (start_ms // 1000) || '.json' AS report,
      'people/' || camera_id || '/' || lower(start_zone_id) || '/' || replace(d, '/', '-') || '/' || start_ms || '_' || local_track_id || '.jpg' AS person
    FROM (SELECT *, strftime(make_timestamp(start_ms * 1000), '%Y/%m/%d') AS d FROM tl)""",
)
def evidence_paths(v: Views) -> DataFrame:
    site, cam, ts = F.lit("site_1"), F.col("camera_id"), F.col("start_ms")
    zone, gid, tid = F.col("start_zone_id"), F.col("truth_id"), F.col("tracklet_id")
    return v.tracklets.select(
        "tracklet_id",
        names.evidence_key(site, cam, zone, ts, gid, tid).alias("best"),
        names.evidence_key(site, cam, zone, ts, gid, tid, "debug", F.col("frame_count")).alias("debug"),
        names.pending_key(site, cam, tid).alias("pending"),
        names.visualization_key(site, cam, ts).alias("visual"),
        names.report_key(site, ts).alias("report"),
        names.person_crop_key(F.lit("people"), cam, zone, F.col("local_track_id"), ts).alias("person"),
    )


@query(
    "parse_evidence_uri",
    "tl",
    """
    SELECT tracklet_id, CASE WHEN ok THEN 'crops' END AS bucket, CASE WHEN ok THEN substr(best_crop_uri, 12) END AS key
    FROM (SELECT *, best_crop_uri IS NOT NULL AND event_id % 4 <> 1 AS ok FROM tl)""",
)
def parse_evidence_uri(v: Views) -> DataFrame:
    uri = F.when(F.col("event_id") % 4 == 1, F.replace("best_crop_uri", F.lit("evidence/"), F.lit("other/"))).otherwise(F.col("best_crop_uri"))
    parsed = v.tracklets.select("tracklet_id", names.parse_evidence_uri(uri).alias("p"))
    return parsed.select("tracklet_id", "p.bucket", "p.key")


# ---- filters over dimensions ----------------------------------------------------
@query(
    "active_cameras",
    "cameras ev",
    """
    SELECT camera_id, count(*) AS events FROM ev JOIN cameras USING (camera_id) WHERE is_active GROUP BY 1""",
)
def active_cameras(v: Views) -> DataFrame:
    active = v.cameras.where("is_active").select("camera_id")
    return v.events.join(active, "camera_id", "left_semi").groupBy("camera_id").agg(F.count("*").alias("events"))


@query(
    "enabled_zones",
    "zones det",
    """
    SELECT zone_id, n AS detections FROM zones JOIN (SELECT camera_id, count(*) AS n FROM det GROUP BY 1) USING (camera_id) WHERE enabled""",
)
def enabled_zones(v: Views) -> DataFrame:
    per_camera = v.detections.groupBy("camera_id").agg(F.count("*").alias("detections"))
    return v.zones.where("enabled").join(per_camera, "camera_id").select("zone_id", "detections")


@query(
    "sql_functions",
    "dec det aux",
    """
    SELECT det_id, dec.event_id, decision, round(final, 9) AS final_score, round(i / u, 9) AS iou, round(cosine, 9) AS cosine, inside, 'zone-a' AS slug FROM dec
    JOIN (SELECT *, (x2 - x1) * (y2 - y1) + (ax2 - ax1) * (ay2 - ay1) - i AS u FROM (
          SELECT d.det_id, d.event_id, d.x1, d.y1, d.x2, d.y2, a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2,
             greatest(0, least(d.x2, a.x2) - greatest(d.x1, a.x1)) * greatest(0, least(d.y2, a.y2) - greatest(d.y1, a.y1)) AS i,
             CASE WHEN d.x1 = 0 AND d.y1 = 0 THEN 0 ELSE list_cosine_similarity([d.x1, d.y1]::DOUBLE[], [d.x2, d.y2]::DOUBLE[]) END AS cosine,
             d.x1 >= 200 AND d.x1 < 800 AND d.y1 >= 200 AND d.y1 < 600 AS inside
          FROM det d JOIN aux a ON d.det_id = a.aux_id)) USING (event_id)""",
)
def sql_functions(v: Views) -> DataFrame:
    """The scalar rules called by name from Spark SQL."""
    sqlfunctions.register(v.spark)
    scored(v).createOrReplaceTempView("mcid_scored")
    v.detections.createOrReplaceTempView("mcid_det")
    v.aux.createOrReplaceTempView("mcid_aux")
    return v.spark.sql(
        """
        SELECT d.det_id, s.event_id,
               decide(top1_score, top2_score, link, final_score(reid_similarity, temporal_score, camera_topology_score, quality_score, zone_score)) AS decision,
               round(final_score(reid_similarity, temporal_score, camera_topology_score, quality_score, zone_score), 9) AS final_score,
               round(bbox_iou(d.x1, d.y1, d.x2, d.y2, a.x1, a.y1, a.x2, a.y2), 9) AS iou,
               round(cosine(array(d.x1, d.y1), array(d.x2, d.y2)), 9) AS cosine,
               point_in_polygon(array(array(200D, 200D), array(800D, 200D), array(800D, 600D), array(200D, 600D)), d.x1, d.y1) AS inside,
               zone_slug('Zone A') AS slug
        FROM mcid_scored s JOIN mcid_det d ON s.event_id = d.event_id
        JOIN mcid_aux a ON a.aux_id = d.det_id"""
    )
