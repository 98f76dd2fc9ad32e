"""Topology, candidate search, binding and identity resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import Views
from ..fixtures.sql_views import register_view
from ..operators import candidates, identity, sequences
from ..plans import read_api
from ..plans.resolve import resolve
from . import query
from .scores import decisions

NOW_MS = 1706659200000  # 2024-01-31 00:00 UTC, after the last event

register_view(
    "win",
    """
    SELECT camera_id, camera_id AS cand_camera_id, 86400 AS back_max, 0 AS back_min FROM cameras
    UNION ALL SELECT to_camera_id, from_camera_id, max_travel_seconds, min_travel_seconds FROM links WHERE enabled""",
    ["cameras", "links"],
)
register_view(
    "cand",
    """
    SELECT * FROM (
      SELECT q.tracklet_id, q.camera_id, q.ts, p.tracklet_id AS cand_tracklet_id, p.camera_id AS cand_camera_id, p.ts AS cand_ts,
             round(list_dot_product(q.vector, p.vector), 6) AS cosine
      FROM points q JOIN win w ON q.camera_id = w.camera_id JOIN points p ON p.camera_id = w.cand_camera_id
      WHERE p.ts BETWEEN q.ts - w.back_max AND q.ts - w.back_min
        AND (p.ts < q.ts OR (p.ts = q.ts AND p.tracklet_id < q.tracklet_id))) WHERE cosine >= 0.6""",
    ["points", "win"],
)
register_view(
    "bests",
    """
    SELECT * FROM (SELECT *, rank() OVER (PARTITION BY tracklet_id, cand_camera_id ORDER BY cosine DESC) AS r FROM cand) WHERE r = 1""",
    ["cand"],
)


def hits(v: Views, top_k: int | None = None, ties: bool = False) -> DataFrame:
    """All hits, or enough of them for the ``top_k`` best of each tracklet on each camera."""
    found = candidates.search(
        v.points.select("tracklet_id", "camera_id", "ts", "vector"),
        None,
        candidates.search_windows(v.cameras, v.links),
        0.5999995,
        top_k=top_k,
        ties=ties,
    )
    return found.withColumn("cosine", F.round("cosine", 6)).where("cosine >= 0.6")


HIT = ["tracklet_id", "camera_id", "ts", "cand_tracklet_id", "cand_camera_id", "cand_ts", "cosine"]


@query("join_candidates", "cand", "SELECT * FROM cand")
def join_candidates(v: Views) -> DataFrame:
    return hits(v)


@query(
    "search_broad",
    "points",
    """
    SELECT tracklet_id, cand_tracklet_id, cosine, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY tracklet_id ORDER BY cosine DESC, cand_tracklet_id) AS rank FROM (
        SELECT q.tracklet_id, p.tracklet_id AS cand_tracklet_id, round(list_dot_product(q.vector, p.vector), 6) AS cosine
        FROM points q JOIN points p ON p.ts BETWEEN q.ts - 600 AND q.ts
         AND (p.ts < q.ts OR (p.ts = q.ts AND p.tracklet_id < q.tracklet_id)) AND p.quality_score >= 0.5)) WHERE rank <= 10""",
)
def search_broad(v: Views) -> DataFrame:
    found = candidates.search_broad(
        v.points.select("tracklet_id", "camera_id", "ts", "vector"), v.points, v.cameras, 600, block_seconds=1800
    )
    return found.select("tracklet_id", "cand_tracklet_id", F.round("cosine", 6).alias("cosine"), F.col("rank").cast("bigint").alias("rank"))


@query(
    "topk_per_camera",
    "cand",
    """
    SELECT tracklet_id, cand_tracklet_id, cand_camera_id, cosine FROM (
      SELECT *, row_number() OVER (PARTITION BY tracklet_id ORDER BY cosine DESC, cand_tracklet_id) AS r FROM (
        SELECT *, row_number() OVER (PARTITION BY tracklet_id, cand_camera_id ORDER BY cosine DESC, cand_tracklet_id) AS k FROM cand)
      WHERE k <= 3) WHERE r <= 3""",
)
def topk_per_camera(v: Views) -> DataFrame:
    return candidates.rank_hits(hits(v, 3), 3, per_camera=True).select(
        "tracklet_id", "cand_tracklet_id", "cand_camera_id", "cosine"
    )


@query("best_per_camera", "bests", f"SELECT {', '.join(HIT)} FROM bests")
def best_per_camera(v: Views) -> DataFrame:
    return candidates.best_per_camera(hits(v, 1, ties=True)).select(*HIT)


@query(
    "top1_top2",
    "bests",
    """
    SELECT tracklet_id, max(CASE WHEN r = 1 THEN cand_tracklet_id END) AS top1, max(CASE WHEN r = 1 THEN cosine END) AS cosine1,
           max(CASE WHEN r = 2 THEN cand_tracklet_id END) AS top2, max(CASE WHEN r = 2 THEN cosine END) AS cosine2
    FROM (SELECT * EXCLUDE (r), row_number() OVER (PARTITION BY tracklet_id ORDER BY cosine DESC, cand_tracklet_id) AS r FROM bests)
    WHERE r <= 2 GROUP BY 1""",
)
def top1_top2(v: Views) -> DataFrame:
    # of equal bests of a camera, the first two are enough
    tops = candidates.top1_top2(candidates.best_per_camera(hits(v, 2)))
    return tops.select(
        "tracklet_id",
        F.col("top1_cand_tracklet_id").alias("top1"),
        F.col("top1_cosine").alias("cosine1"),
        F.col("top2_cand_tracklet_id").alias("top2"),
        F.col("top2_cosine").alias("cosine2"),
    )


# ---- topology -------------------------------------------------------------------
@query(
    "join_link",
    "hits links",
    """
    SELECT event_id, CASE WHEN enabled IS NULL THEN 'unknown' WHEN enabled THEN 'enabled' ELSE 'disabled' END AS link
    FROM hits LEFT JOIN links ON from_camera_id = top1_camera_id AND to_camera_id = camera_id""",
)
def join_link(v: Views) -> DataFrame:
    joined = candidates.link_state(v.decision_inputs, v.links, "top1_camera_id", "camera_id")
    text = F.when(F.col("link").isNull(), "unknown").when(F.col("link"), "enabled").otherwise("disabled")
    return joined.select("event_id", text.alias("link"))


@query(
    "join_travel_check",
    "hits links",
    """
    SELECT event_id, coalesce(time_diff_seconds BETWEEN min_travel_seconds AND max_travel_seconds, FALSE) AS in_window
    FROM hits LEFT JOIN links ON enabled AND from_camera_id = top1_camera_id AND to_camera_id = camera_id""",
)
def join_travel_check(v: Views) -> DataFrame:
    out = candidates.travel_check(v.decision_inputs, v.links, "top1_camera_id", "camera_id", "time_diff_seconds")
    return out.select("event_id", "in_window")


@query(
    "linked_cameras",
    "ev links",
    "SELECT event_id, to_camera_id AS linked FROM ev JOIN links ON from_camera_id = camera_id WHERE enabled",
)
def linked_cameras(v: Views) -> DataFrame:
    return v.events.join(candidates.linked_cameras(v.links), "camera_id").select(
        "event_id", F.col("cand_camera_id").alias("linked")
    )


@query(
    "candidate_cameras",
    "ev cameras links",
    f"""
    WITH seen AS (SELECT camera_id FROM ev GROUP BY 1 HAVING {NOW_MS} - max(ts_ms) <= 86400000),
    known AS (SELECT from_camera_id AS camera_id FROM links UNION SELECT to_camera_id FROM links)
    SELECT camera_id, camera_id AS cand_camera_id FROM cameras WHERE camera_id IN (SELECT from_camera_id FROM links WHERE enabled)
    UNION SELECT from_camera_id, to_camera_id FROM links WHERE enabled
    UNION SELECT c.camera_id, s.camera_id FROM cameras c, seen s WHERE s.camera_id IN (SELECT camera_id FROM known) OR s.camera_id = c.camera_id""",
)
def candidate_cameras(v: Views) -> DataFrame:
    seen = identity.camera_last_seen(v.events).select("camera_id", (F.col("last_seen_ms") / 1000).alias("last_seen"))
    return candidates.candidate_cameras(v.cameras, v.links, seen, F.lit(NOW_MS / 1000))


# ---- identities -------------------------------------------------------------------
def sightings(v: Views) -> DataFrame:
    return decisions(v).where("assigned_global_id IS NOT NULL").select(
        F.col("assigned_global_id").alias("global_id"), "camera_id", "local_track_id", "ts_ms", "tracklet_id"
    )


register_view(
    "sight",
    "SELECT assigned_global_id AS global_id, camera_id, local_track_id, ts_ms, tracklet_id FROM dec WHERE assigned_global_id IS NOT NULL",
    ["dec"],
)
register_view(
    "ident",
    """
    SELECT global_id, 'S-' || strftime(make_timestamp(min(ts_ms) * 1000), '%Y-%m-%d') AS session_id, min(ts_ms) AS first_seen_ms,
           max(ts_ms) AS last_seen_ms, arg_min(camera_id, (ts_ms, camera_id)) AS first_camera_id,
           arg_max(camera_id, (ts_ms, camera_id)) AS last_camera_id, 'active' AS status, 'firm' AS confidence_state, count(*) AS tracklets
    FROM sight GROUP BY 1""",
    ["sight"],
)


@query("identity_rollup", "ident", "SELECT * FROM ident")
def identity_rollup(v: Views) -> DataFrame:
    return identity.rollup(sightings(v))


@query("camera_last_seen", "sight", "SELECT camera_id, max(ts_ms) AS last_seen_ms FROM sight GROUP BY 1")
def camera_last_seen(v: Views) -> DataFrame:
    return identity.camera_last_seen(sightings(v), F.lit(NOW_MS))


@query(
    "recent_identity",
    "sight",
    f"""
    SELECT global_id, max(ts_ms) AS last_seen_ms, arg_max(camera_id, (ts_ms, camera_id)) AS last_camera_id
    FROM sight WHERE {NOW_MS} - ts_ms <= 86400000 GROUP BY 1""",
)
def recent_identity(v: Views) -> DataFrame:
    return identity.recent_identities(sightings(v), F.lit(NOW_MS))


@query(
    "bind_identity",
    "det sight",
    """
    WITH own AS (SELECT d.det_id, d.camera_id, d.ts_ms, CASE WHEN d.ts_ms - s.ts_ms <= 600000 THEN s.global_id END AS gid
                 FROM det d ASOF LEFT JOIN sight s ON d.camera_id = s.camera_id AND d.local_track_id = s.local_track_id AND d.ts_ms >= s.ts_ms)
    SELECT o.det_id, coalesce(o.gid, CASE WHEN o.ts_ms - s.ts_ms <= 600000 THEN s.global_id END) AS global_id
    FROM own o ASOF LEFT JOIN (SELECT camera_id, ts_ms, max(global_id) AS global_id FROM sight GROUP BY 1, 2) s
      ON o.camera_id = s.camera_id AND o.ts_ms >= s.ts_ms""",
)
def bind_identity(v: Views) -> DataFrame:
    bound = candidates.bind_identity(v.detections.select("det_id", "camera_id", "local_track_id", "ts_ms"), sightings(v))
    return bound.select("det_id", "global_id")


@query(
    "decision_lag",
    "sight",
    """
    SELECT tracklet_id, global_id, camera_id, lag(camera_id) OVER w AS prev_camera_id, coalesce(ts_ms - lag(ts_ms) OVER w, -1) AS since_ms
    FROM sight WINDOW w AS (PARTITION BY global_id ORDER BY ts_ms, tracklet_id)""",
)
def decision_lag(v: Views) -> DataFrame:
    return previous_sighting(sightings(v)).select(
        "tracklet_id", "global_id", "camera_id", "prev_camera_id",
        F.coalesce(F.col("ts_ms") - F.col("prev_ms"), F.lit(-1)).alias("since_ms"),
    )


def previous_sighting(df: DataFrame) -> DataFrame:
    return sequences.neighbour(
        df, ["global_id"], ["ts_ms", "tracklet_id"], {"prev_camera_id": "camera_id", "prev_ms": "ts_ms"}, F.floor(F.col("ts_ms") / 86_400_000)
    )


MERGES = """
    SELECT 'G' || user_id || '-' || (n + 1) AS old_global_id, 'G' || user_id || '-' || n AS new_global_id, ts_ms AS created_ms
    FROM (SELECT user_id, ts_ms, row_number() OVER (PARTITION BY user_id ORDER BY ts_ms, event_id) AS n FROM ev)"""


@query(
    "canonical_ids",
    "ev",
    f"SELECT old_global_id, regexp_replace(old_global_id, '-.*', '') || '-1' AS global_id FROM ({MERGES})",
)
def canonical_ids(v: Views) -> DataFrame:
    numbered = sequences.row_numbers(
        v.events.select("user_id", "event_id", "ts_ms"), ["user_id"], ["ts_ms", "event_id"], F.floor(F.col("ts_ms") / 86_400_000), "n"
    )
    merges = numbered.select(
        F.concat(F.lit("G"), "user_id", F.lit("-"), F.col("n") + 1).alias("old_global_id"),
        F.concat(F.lit("G"), "user_id", F.lit("-"), "n").alias("new_global_id"),
        F.col("ts_ms").alias("created_ms"),
    )
    return identity.canonical_ids(merges)


#: Verdicts of all tracklets, if those with ``flag`` in the table %s carry an identity.
VERDICTS = """
    (SELECT *, CASE WHEN top1 IS NULL OR top1.link = FALSE THEN 'new' WHEN (top1.cos >= 0.95 OR final >= auto) AND m > 0.05 THEN 'match'
            WHEN final >= 0.72 AND m > 0.05 THEN 'candidate' WHEN final >= 0.72 THEN 'ambiguous' ELSE 'new' END AS decision
     FROM (SELECT *, CASE WHEN stage LIKE 'stage3%%' THEN 0.92 ELSE 0.82 END AS auto, CASE WHEN top2 IS NULL THEN 1 ELSE top1.cos - top2.cos END AS m,
             least(1, greatest(0, coalesce(top1.cos, 0) * 0.55::DOUBLE + temporal * 0.2::DOUBLE + topo * 0.15::DOUBLE + q * 0.05::DOUBLE + 0.5 * 0.05::DOUBLE)) AS final
       FROM (SELECT *, CASE WHEN top1.link IS NULL THEN 0.5 WHEN top1.link THEN 1 ELSE 0 END::DOUBLE AS topo,
               CASE WHEN top1 IS NULL THEN 1 ELSE exp(-((ts - top1.ts) * (ts - top1.ts))::DOUBLE / 7200) END AS temporal
         FROM trk LEFT JOIN (SELECT k, min(hit) AS top1 FROM pair JOIN (SELECT k AS pk FROM %s WHERE flag) ON pk = hit.k GROUP BY k) USING (k)
         LEFT JOIN (
           SELECT k, min(hit) AS top2 FROM pair JOIN (SELECT k AS pk FROM %s WHERE flag) ON pk = hit.k
           JOIN (SELECT k, min(hit) AS best FROM pair JOIN (SELECT k AS pk FROM %s WHERE flag) ON pk = hit.k GROUP BY k) USING (k)
           WHERE hit.k <> best.k AND (hit.cam <> best.cam OR hit.neg = best.neg) GROUP BY k) USING (k))))"""

#: Three digits of a number of six, halves up.
HALF_UP = "round(round(%s, 6)::VARCHAR::DECIMAL(38, 20), 3)::DOUBLE"

RESOLVE_SQL = f"""
    WITH RECURSIVE num AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY ts, tracklet_id) AS k FROM points),
    pair AS MATERIALIZED (
      SELECT k, {{'neg': -round(c, 6), 'id': pid, 'cam': pcam, 'ts': pts, 'cos': c, 'k': pk, 'link': enabled}} AS hit FROM (
        SELECT q.k, p.k AS pk, p.tracklet_id AS pid, p.camera_id AS pcam, p.ts AS pts, q.camera_id, list_dot_product(q.vector, p.vector) AS c
        FROM num q JOIN win w ON q.camera_id = w.camera_id JOIN num p ON p.camera_id = w.cand_camera_id
        WHERE p.ts BETWEEN q.ts - w.back_max AND q.ts - w.back_min AND p.k < q.k)
      LEFT JOIN links ON from_camera_id = pcam AND to_camera_id = camera_id),
    trk AS (
      SELECT k, tracklet_id, camera_id, ts, zone_id, CASE WHEN quality_score IS NULL THEN 0.5 ELSE least(1, greatest(0, quality_score)) END AS q,
             CASE WHEN coalesce(n, 0) = 0 THEN 'stage3_24h_fallback' ELSE 'stage2_3_combined' END AS stage
      FROM num LEFT JOIN (SELECT from_camera_id AS camera_id, count(*) AS n FROM links WHERE enabled GROUP BY 1) USING (camera_id)),
    walk AS (
      SELECT 0 AS round, k, TRUE AS flag FROM num
      UNION ALL
      SELECT round + 1, k, fresh FROM (
        SELECT round, k, fresh, bool_or(fresh <> flag) OVER () AS moved
        FROM walk JOIN (SELECT k, decision IN ('match', 'new') AS fresh FROM {VERDICTS % (("walk",) * 3)}) USING (k)) WHERE moved),
    settled AS (SELECT k, flag FROM walk WHERE round = (SELECT max(round) FROM walk)),
    done AS MATERIALIZED (SELECT * FROM {VERDICTS % (("settled",) * 3)}),
    chain AS (
      SELECT k, k AS origin FROM done WHERE decision IN ('match', 'new')
      UNION ALL
      SELECT chain.k, done.top1.k FROM chain JOIN done ON done.k = origin WHERE decision = 'match'),
    named AS (
      SELECT chain.k, 'GID-' || upper(substr(sha256(tracklet_id), 1, 8)) || '-' || string_split(camera_id, '_')[-1] AS gid
      FROM chain JOIN done ON done.k = origin WHERE decision = 'new')
    SELECT tracklet_id, camera_id AS source_camera_id, decision AS decision_type, own.gid AS assigned_global_id, top1.cam AS candidate_camera_id,
           a.gid AS top1_global_id, top1.cam AS top1_camera_id, round(top1.cos, 6) AS top1_score,
           b.gid AS top2_global_id, top2.cam AS top2_camera_id, round(top2.cos, 6) AS top2_score,
           round(coalesce(top1.cos, 0), 6) AS reid_similarity, topo AS camera_topology_score, round(temporal, 6) AS temporal_score, q AS quality_score,
           0.5::DOUBLE AS zone_score, round(final, 6) AS final_score,
           CASE WHEN decision IN ('match', 'new') THEN 'firm' WHEN decision = 'ambiguous' THEN 'ambiguous' ELSE 'held' END AS confidence_state,
           stage, printf('stage=%s decision=%s reid=%.3f topo=%.2f temporal=%.3f quality=%.3f zone=%.3f final=%.3f', stage, decision,
             {HALF_UP % "coalesce(top1.cos, 0)"}, topo, {HALF_UP % "temporal"}, {HALF_UP % "q"}, 0.5, {HALF_UP % "final"}) AS reason, ts AS created_at, zone_id
    FROM done LEFT JOIN named own USING (k) LEFT JOIN named a ON a.k = top1.k LEFT JOIN named b ON b.k = top2.k"""


@query("resolve_identities", "points win", RESOLVE_SQL)
def resolve_identities(v: Views) -> DataFrame:
    out = resolve(v.points.drop("event_id", "truth_id"), v.cameras, v.links)
    return out.withColumns({c: F.round(c, 6) for c in ("top1_score", "top2_score", "reid_similarity", "temporal_score", "final_score")})


# ---- read queries ---------------------------------------------------------------------
DECISION = "tracklet_id, camera_id AS source_camera_id, decision AS decision_type, assigned_global_id, top1_global_id, top1_score, ts_ms AS created_ms"


def decision_rows(v: Views) -> DataFrame:
    return decisions(v).withColumnsRenamed(
        {"camera_id": "source_camera_id", "decision": "decision_type", "ts_ms": "created_ms"}
    )


AUDIT = ["tracklet_id", "source_camera_id", "decision_type", "assigned_global_id", "top1_global_id", "top1_score", "created_ms"]


@query("recent_decisions", "dec", f"SELECT {DECISION} FROM dec WHERE decision = 'match' ORDER BY ts_ms DESC, tracklet_id LIMIT 50")
def recent_decisions(v: Views) -> DataFrame:
    return read_api.recent_decisions(decision_rows(v), "match").select(*AUDIT)


@query("ambiguous_queue", "dec", f"SELECT {DECISION} FROM dec WHERE decision = 'ambiguous' ORDER BY ts_ms DESC, tracklet_id LIMIT 50")
def ambiguous_queue(v: Views) -> DataFrame:
    return read_api.ambiguous_queue(decision_rows(v)).select(*AUDIT)


@query(
    "identity_lookup",
    "ident tl",
    """
    SELECT i.global_id, i.last_seen_ms, t.tracklet_id, t.start_ms FROM ident i JOIN (
      SELECT truth_id AS global_id, tracklet_id, start_ms FROM tl) t USING (global_id) WHERE i.global_id = 'G7' ORDER BY start_ms DESC, tracklet_id LIMIT 200""",
)
def identity_lookup(v: Views) -> DataFrame:
    found = read_api.identity_lookup(identity.rollup(sightings(v)), named_tracklets(v), "G7")
    return found.select("global_id", "last_seen_ms", "tracklet_id", "start_ms")


def named_tracklets(v: Views) -> DataFrame:
    return v.tracklets.withColumnRenamed("truth_id", "global_id")


@query(
    "identity_tracklets",
    "ident tl",
    """
    SELECT i.global_id, i.first_camera_id, t.tracklet_id, t.start_ms
    FROM ident i JOIN (SELECT truth_id AS global_id, tracklet_id, start_ms FROM tl) t USING (global_id)""",
)
def identity_tracklets(v: Views) -> DataFrame:
    return read_api.identity_tracklets(identity.rollup(sightings(v)), named_tracklets(v)).select(
        "global_id", "first_camera_id", "tracklet_id", "start_ms"
    )


@query(
    "active_identities",
    "ident",
    f"SELECT global_id, last_seen_ms FROM ident WHERE {NOW_MS} - last_seen_ms <= 86400000",
)
def active_identities(v: Views) -> DataFrame:
    live = identity.rollup(sightings(v)).withColumn(
        "status", F.when(NOW_MS - F.col("last_seen_ms") <= 86_400_000, "active").otherwise("expired")
    )
    return read_api.active_identities(live).select("global_id", "last_seen_ms")


@query("open_tracklets", "tl", "SELECT tracklet_id, camera_id, start_ms FROM tl WHERE end_ms IS NULL")
def open_tracklets(v: Views) -> DataFrame:
    return read_api.open_tracklets(v.tracklets).select("tracklet_id", "camera_id", "start_ms")


@query(
    "new_identity_payload",
    "dec",
    """
    SELECT tracklet_id, '{"ts":' || ts_ms || ',"values":{"global_id_active":1,"global_id":"' || assigned_global_id
        || '","site_id":"site_1","camera_id":"' || camera_id || '"}}' AS payload FROM dec WHERE decision = 'new'""",
)
def new_identity_payload(v: Views) -> DataFrame:
    from ..operators import payloads

    return payloads.new_identities(decision_rows(v).withColumnRenamed("source_camera_id", "camera_id"), "site_1").select(
        "tracklet_id", "payload"
    )
