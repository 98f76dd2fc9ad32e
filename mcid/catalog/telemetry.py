"""Frame rates, latencies, camera state, counters and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import Views
from ..operators import telemetry
from . import query
from .scores import decisions
from .storage import judged


@query(
    "fps_report",
    "det",
    """
    WITH c AS (SELECT camera_id, (n - 1) / ((hi - lo)::DOUBLE / 1000) AS fps FROM (
      SELECT camera_id, count(*) AS n, min(ts_ms) AS lo, max(ts_ms) AS hi FROM det GROUP BY 1))
    SELECT camera_id, round(fps, 9) AS fps FROM c UNION ALL SELECT 'total', round(sum(fps), 9) FROM c""",
)
def fps_report(v: Views) -> DataFrame:
    return telemetry.fps_report(v.detections).select("camera_id", F.round("fps", 9).alias("fps"))


@query(
    "rolling_fps",
    "det",
    """
    SELECT det_id, round(CASE WHEN n > 1 AND ts_ms > lo THEN (n - 1) * 1000 / (ts_ms - lo)::DOUBLE ELSE 0 END, 6) AS fps FROM (
      SELECT det_id, ts_ms, count(*) OVER w AS n, min(ts_ms) OVER w AS lo FROM det
      WINDOW w AS (PARTITION BY camera_id ORDER BY ts_ms RANGE BETWEEN 5000 PRECEDING AND CURRENT ROW))""",
)
def rolling_fps(v: Views) -> DataFrame:
    ticks = v.detections.select("camera_id", "ts_ms", "det_id")
    return telemetry.rolling_fps(ticks).select("det_id", F.round("fps", 6).alias("fps"))


@query(
    "ewma_latency",
    "ticks",
    """
    SELECT camera_id, chunk, round(list_reduce(list_prepend(0::DOUBLE, xs[1:n]), lambda e, x: 0.7::DOUBLE * e + 0.3::DOUBLE * x), 6) AS ewma
    FROM (SELECT camera_id, chunk, (sum(count(*)) OVER (PARTITION BY camera_id ORDER BY chunk))::BIGINT AS n
          FROM (SELECT camera_id, ts_ms // 3600000 AS chunk FROM ticks) GROUP BY 1, 2)
    JOIN (SELECT camera_id, list(latency_ms ORDER BY ts_ms, event_id) AS xs FROM ticks GROUP BY 1) USING (camera_id)""",
)
def ewma_latency(v: Views) -> DataFrame:
    out = telemetry.ewma(v.ticks, "latency_ms", ["ts_ms", "event_id"])
    return out.withColumn("ewma", F.round("ewma", 6))


@query(
    "camera_status",
    "ticks",
    """
    WITH t AS (SELECT event_id, camera_id, ts_ms // 60 AS ts_ms, ok FROM ticks),
    r AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY camera_id ORDER BY ts_ms, event_id) AS run FROM t)
    SELECT event_id, CASE WHEN ok THEN 'online' WHEN age < 10000 THEN 'online' WHEN age < 60000 THEN 'degraded' ELSE 'offline' END AS status
    FROM (SELECT *, ts_ms - min(CASE WHEN NOT ok THEN ts_ms END) OVER (PARTITION BY camera_id, run) AS age FROM r)""",
)
def camera_status(v: Views) -> DataFrame:
    faster = v.ticks.withColumn("ts_ms", F.expr("ts_ms div 60"))
    names = F.array(F.lit("offline"), F.lit("degraded"), F.lit("online"))
    return telemetry.camera_status(faster).select("event_id", F.get(names, F.col("status")).alias("status"))


def _index(p: float) -> str:
    return f"s[least(n - 1, floor(n * {p}::DOUBLE)::BIGINT) + 1]"


@query(
    "latency_percentiles",
    "ticks",
    f"""
    SELECT camera_id, {_index(0.5)} AS p50, {_index(0.95)} AS p95, {_index(0.99)} AS p99
    FROM (SELECT camera_id, list(latency_ms ORDER BY latency_ms) AS s, count(*) AS n FROM ticks GROUP BY 1)""",
)
def latency_percentiles(v: Views) -> DataFrame:
    return telemetry.latency_percentiles(v.ticks, ["camera_id"], "latency_ms")


@query(
    "registry_percentiles",
    "ticks",
    f"""
    SELECT camera_id, s[greatest(0, n // 2 - 1) + 1] AS p50, {_index(0.95)} AS p95, {_index(0.99)} AS p99, n AS samples
    FROM (SELECT camera_id, list(latency_ms ORDER BY latency_ms) AS s, count(*) AS n FROM (
        SELECT *, row_number() OVER (PARTITION BY camera_id ORDER BY ts_ms DESC, event_id DESC) AS k FROM ticks) WHERE k <= 256 GROUP BY 1)""",
)
def registry_percentiles(v: Views) -> DataFrame:
    return telemetry.recent_percentiles(v.ticks, ["camera_id"], ["ts_ms", "event_id"], "latency_ms")


@query(
    "counters",
    "dec det",
    """
    SELECT 'identity_decisions' AS counter, decision AS label, count(*) AS value FROM dec GROUP BY 2
    UNION ALL SELECT 'detections', CASE det_id % 50 WHEN 7 THEN 'bad_json' WHEN 17 THEN 'bad_number' WHEN 27 THEN 'short_bbox' WHEN 37 THEN 'missing_field' ELSE 'parsed' END, count(*)
    FROM det GROUP BY 2""",
)
def counters(v: Views) -> DataFrame:
    by_type = telemetry.counters(decisions(v), "identity_decisions", F.col("decision"))
    return by_type.unionByName(
        telemetry.counters(judged(v), "detections", F.coalesce("reason", F.lit("parsed")))
    )


@query(
    "sample_every_n",
    "tl",
    """
    SELECT tracklet_id, 'labeler/site_1/' || camera_id || '/' || strftime(make_timestamp(start_ms * 1000), '%Y/%m/%d') || '/' || tracklet_id || '.jpg' AS staged_key
    FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY start_ms, tracklet_id) AS n FROM (
            SELECT *, sum(CASE WHEN best_crop_uri IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY start_ms, tracklet_id) AS run FROM tl)
          WHERE best_crop_uri IS NOT NULL)
    WHERE n % 5 = 0""",
)
def sample_every_n(v: Views) -> DataFrame:
    return telemetry.sample_every_n(v.tracklets, 5).select("tracklet_id", "staged_key")
