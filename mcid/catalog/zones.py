"""Zone entries, stays, zone statistics and their payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import Views
from ..fixtures.sql_views import register_view
from ..operators import dwell, payloads, sequences
from ..plans import read_api
from ..session import cut_lineage
from . import query
from .detections import zoned
from .identity import NOW_MS

CLOCK = 1706659170000  # half a minute before NOW_MS, close to the last events

register_view(
    "moves",
    """
    SELECT global_id, camera_id, zone_id, event_type, ts_ms, det_id FROM (
      SELECT global_id, ts_ms, det_id, unnest([
          {'event_type': 'exit', 'zone_id': pz, 'camera_id': pc}, {'event_type': 'enter', 'zone_id': zone_id, 'camera_id': camera_id}], recursive := true)
      FROM (SELECT 'G' || local_track_id AS global_id, ts_ms, det_id, zone_id, camera_id, lag(zone_id) OVER w AS pz, lag(camera_id) OVER w AS pc
            FROM zoned WINDOW w AS (PARTITION BY local_track_id ORDER BY ts_ms, det_id)) t WHERE pz IS DISTINCT FROM zone_id)
    WHERE zone_id IS NOT NULL""",
    ["zoned"],
)


def stays_sql(source: str, row_id: str) -> str:
    return f"""
    SELECT global_id, zone_id, camera_id, ts_ms AS entered_ms, exited_ms,
           CASE WHEN exited_ms IS NOT NULL THEN greatest(0, (exited_ms - ts_ms) // 1000) END AS duration_seconds,
           CASE WHEN exited_ms IS NULL THEN 'open' ELSE 'closed' END AS status
    FROM (SELECT *, lead(ts_ms) OVER (PARTITION BY global_id, zone_id ORDER BY ts_ms, {row_id}) AS exited_ms FROM (
            SELECT *, lag(event_type) OVER (PARTITION BY global_id, zone_id ORDER BY ts_ms, {row_id}) AS before FROM {source})
          WHERE event_type <> coalesce(before, 'exit'))
    WHERE event_type = 'enter'"""


register_view("stays", stays_sql("zev", "event_id"), ["zev"])
register_view("move_stays", stays_sql("moves", "det_id"), ["moves"])
register_view(
    "judged",
    f"""
    SELECT *, d >= 120 AS valid, status = 'open' AND d < 120 AS pending FROM (
      SELECT *, (coalesce(exited_ms, {CLOCK}) - entered_ms)::DOUBLE / 1000 AS d FROM stays)""",
    ["stays"],
)


def moves(v: Views) -> DataFrame:
    seen = zoned(v).select(
        F.concat(F.lit("G"), "local_track_id").alias("global_id"), "camera_id", "zone_id", "ts_ms", "det_id"
    )
    return dwell.transitions(seen)


def stays(v: Views) -> DataFrame:
    return dwell.sessions(v.zone_events)


def judged(v: Views) -> DataFrame:
    return dwell.with_validity(stays(v), F.lit(CLOCK))


def flat(df: DataFrame) -> DataFrame:
    """Missing numbers as -1, so that both engines give the same column types."""
    return df.na.fill(-1, ["exited_ms", "duration_seconds"])


FLAT = "coalesce(exited_ms, -1) AS exited_ms, coalesce(duration_seconds, -1) AS duration_seconds"


@query("zone_transitions", "moves", "SELECT * FROM moves")
def zone_transitions(v: Views) -> DataFrame:
    return moves(v)


@query("dwell_sessions", "stays", f"SELECT * REPLACE ({FLAT}) FROM stays")
def dwell_sessions(v: Views) -> DataFrame:
    return flat(stays(v))


@query(
    "dwell_force_close",
    "stays",
    f"""
    SELECT global_id, zone_id, camera_id, entered_ms, CASE WHEN stale THEN {NOW_MS} ELSE coalesce(exited_ms, -1) END AS exited_ms,
           CASE WHEN stale THEN ({NOW_MS} - entered_ms) // 1000 ELSE coalesce(duration_seconds, -1) END AS duration_seconds,
           CASE WHEN stale THEN 'closed' ELSE status END AS status
    FROM (SELECT *, status = 'open' AND {NOW_MS} - entered_ms > 86400000 AS stale FROM stays)""",
)
def dwell_force_close(v: Views) -> DataFrame:
    return flat(dwell.force_close(stays(v), F.lit(NOW_MS)))


@query(
    "zone_summary",
    "moves move_stays",
    """
    SELECT camera_id, zone_id, entries, exits, coalesce(people_count, 0) AS people_count,
           round(coalesce(mean, 0), 6) AS dwell_avg_seconds, coalesce(people, 0) AS active_global_ids
    FROM (SELECT camera_id, zone_id, count(*) FILTER (event_type = 'enter') AS entries, count(*) FILTER (event_type = 'exit') AS exits FROM moves GROUP BY 1, 2)
    LEFT JOIN (SELECT camera_id, zone_id, count(*) FILTER (status = 'open') AS people_count, avg(duration_seconds) AS mean,
                      count(DISTINCT global_id) AS people FROM move_stays GROUP BY 1, 2) USING (camera_id, zone_id)""",
)
def zone_summary(v: Views) -> DataFrame:
    # entries and exits are few next to detections and are used twice: keep them
    events = cut_lineage(moves(v))
    out = dwell.zone_summary(events, dwell.sessions(events, "det_id"))
    return out.withColumn("dwell_avg_seconds", F.round("dwell_avg_seconds", 6))


@query("valid_entries", "judged", "SELECT global_id, zone_id, entered_ms, round(d, 3) AS dwell_seconds, valid, pending FROM judged WHERE valid OR pending")
def valid_entries(v: Views) -> DataFrame:
    return judged(v).where("valid OR pending").select(
        "global_id", "zone_id", "entered_ms", F.round("dwell_seconds", 3).alias("dwell_seconds"), "valid", "pending"
    )


GAUGES = """
    count(*) FILTER (status = 'open') AS current_count, round(coalesce(avg(d) FILTER (valid), 0), 2) AS avg_dwell,
    round(coalesce(max(d) FILTER (valid), 0), 2) AS longest_dwell, count(*) FILTER (pending) AS pending_entries,
    count(*) AS total_entered, count(*) FILTER (status = 'closed') AS total_exited, count(*) FILTER (valid) AS valid_entries"""


@query("zone_gauges", "judged", f"SELECT zone_id, {GAUGES}, sum(count(*) FILTER (status = 'open')) OVER ()::BIGINT AS total_people FROM judged GROUP BY 1")
def zone_gauges(v: Views) -> DataFrame:
    gauges = dwell.zone_gauges(judged(v))
    total = judged(v).agg(F.count(F.when(F.col("status") == "open", 1))).scalar()
    return gauges.withColumn("total_people", total)


def _windowed(width: int) -> str:
    return f"""
    SELECT coalesce(a.zone_id, b.zone_id) AS zone_id, coalesce(a.w, b.w) AS window_ms, coalesce(entries, 0) AS entries,
           coalesce(valid_entries, 0) AS valid_entries, coalesce(exits, 0) AS exits, round(coalesce(mean, 0), 2) AS avg_dwell,
           coalesce(longest, 0)::DOUBLE AS longest_dwell
    FROM (SELECT zone_id, entered_ms // {width} * {width} AS w, count(*) AS entries, count(*) FILTER (valid) AS valid_entries FROM judged GROUP BY 1, 2) a
    FULL JOIN (SELECT zone_id, exited_ms // {width} * {width} AS w, count(*) AS exits, avg(duration_seconds) AS mean, max(duration_seconds) AS longest
               FROM judged WHERE exited_ms IS NOT NULL GROUP BY 1, 2) b ON a.zone_id = b.zone_id AND a.w = b.w"""


@query("zone_windowed", "judged", f"SELECT 'hour' AS span, * FROM ({_windowed(3600000)}) UNION ALL SELECT 'day', * FROM ({_windowed(86400000)})")
def zone_windowed(v: Views) -> DataFrame:
    rows = judged(v)
    hour = dwell.zone_windowed(rows, dwell.HOUR_MS).withColumn("span", F.lit("hour"))
    return hour.unionByName(dwell.zone_windowed(rows, dwell.DAY_MS).withColumn("span", F.lit("day")))


def _rank(metric: str, name: str) -> str:
    return f"coalesce(arg_min(zone_id, ({metric} * -1, zone_id)), 'N/A') AS {name}"


_SPANS = {"": "TRUE", "_hourly": f"%s >= {CLOCK} - 3600000", "_daily": f"%s >= {CLOCK} - 86400000"}
RANK_SQL = (
    "SELECT "
    + ", ".join(
        [_rank("cur", "busiest_zone")]
        + [_rank(f"visits{t}", f"most_visited_zone{t}") for t in _SPANS]
        + [_rank(f"stay{t}", f"longest_visited_zone{t}") for t in _SPANS]
    )
    + " FROM (SELECT zone_id, count(*) FILTER (status = 'open') AS cur, "
    + ", ".join(
        f"count(*) FILTER ({c % 'entered_ms' if '%' in c else c}) AS visits{t}, "
        f"round(coalesce(avg(duration_seconds) FILTER (exited_ms IS NOT NULL AND {c % 'exited_ms' if '%' in c else c}), 0), 6) AS stay{t}"
        for t, c in _SPANS.items()
    )
    + " FROM judged GROUP BY 1)"
)


@query("zone_ranks", "judged", RANK_SQL)
def zone_ranks(v: Views) -> DataFrame:
    return dwell.zone_ranks(judged(v), F.lit(CLOCK))


CAMERA_SQL = f"""
    SELECT camera_id, round(coalesce(avg(duration_seconds), 0), 2) AS avg_camera_dwell, coalesce(max(duration_seconds), 0)::DOUBLE AS longest_camera_dwell,
           count(DISTINCT global_id) AS unique_people, count(DISTINCT global_id) FILTER (entered_ms >= {CLOCK} - 3600000) AS unique_people_hourly,
           count(DISTINCT global_id) FILTER (entered_ms >= {CLOCK} - 86400000) AS unique_people_daily, count(*) FILTER (pending) AS total_pending,
           round(coalesce(avg(d) FILTER (valid), 0), 2) AS avg_dwell_time, round(coalesce(max(d) FILTER (valid), 0), 2) AS longest_dwell_time
    FROM judged GROUP BY 1"""


@query("camera_dwell", "judged", CAMERA_SQL)
def camera_dwell(v: Views) -> DataFrame:
    return dwell.camera_dwell(judged(v), F.lit(CLOCK))


def _payload_sql() -> str:
    entries = []
    for column, pattern in payloads.ZONE_KEYS.items():
        name = pattern.replace("{key}", "' || replace(zone_id, ' ', '') || '").replace("{lower}", "' || replace(lower(zone_id), ' ', '_') || '")
        entries.append(f"SELECT camera_id, '{name}' AS key, {column}::VARCHAR AS value FROM z")
    for column, name in payloads.CAMERA_KEYS.items():
        entries.append(f"SELECT camera_id, '{name}', {column}::VARCHAR FROM c")
    return f"""
    WITH z AS (SELECT camera_id, zone_id, {GAUGES} FROM judged GROUP BY 1, 2),
    c AS (SELECT * FROM ({CAMERA_SQL}) JOIN (SELECT camera_id, count(*) FILTER (status = 'open') AS total_people FROM judged GROUP BY 1) USING (camera_id)),
    e AS ({' UNION ALL '.join(entries)})
    SELECT camera_id, '{{"ts":{CLOCK},"values":{{' || string_agg('"' || key || '":' || value, ',' ORDER BY '"' || key || '":' || value) || '}}}}' AS payload
    FROM e GROUP BY 1"""


@query("payload_wide", "judged", _payload_sql())
def payload_wide(v: Views) -> DataFrame:
    rows = judged(v)
    people = rows.groupBy("camera_id").agg(F.count(F.when(F.col("status") == "open", 1)).alias("total_people"))
    cameras = dwell.camera_dwell(rows, F.lit(CLOCK)).join(people, "camera_id")
    return payloads.wide(dwell.zone_gauges(rows, ("camera_id", "zone_id")), cameras, F.lit(CLOCK))


@query(
    "sink_payload",
    "stays",
    """
    SELECT global_id, zone_id, entered_ms, '{"ts":' || exited_ms || ',"values":{"dwell_duration_seconds":' || duration_seconds || ',"zone_id":"'
        || zone_id || '","camera_id":"' || camera_id || '","global_id":"' || global_id || '"}}' AS payload
    FROM stays WHERE status = 'closed'""",
)
def sink_payload(v: Views) -> DataFrame:
    closed = stays(v).where(F.col("status") == "closed")
    text = payloads.dwell(*(F.col(c) for c in ("exited_ms", "global_id", "zone_id", "camera_id", "duration_seconds")))
    return closed.select("global_id", "zone_id", "entered_ms", text.alias("payload"))


@query(
    "delta_counters",
    "zev",
    """
    SELECT zone_id, hour_ms, week, delta FROM (
      SELECT *, total - coalesce(lag(total) OVER (PARTITION BY zone_id, week ORDER BY hour_ms), 0) AS delta FROM (
        SELECT zone_id, hour_ms, hour_ms // 604800000 AS week, sum(n) OVER (PARTITION BY zone_id ORDER BY hour_ms)::BIGINT AS total FROM (
          SELECT zone_id, ts_ms // 3600000 * 3600000 AS hour_ms, count(*) FILTER (event_type = 'enter') AS n FROM zev GROUP BY 1, 2)))
    WHERE delta <> 0""",
)
def delta_counters(v: Views) -> DataFrame:
    """Hourly published totals of entries; baselines are forgotten every week."""
    hourly = v.zone_events.groupBy("zone_id", F.expr("ts_ms div 3600000 * 3600000").alias("hour_ms")).agg(
        F.count(F.when(F.col("event_type") == "enter", 1)).alias("n")
    )
    totals = sequences.running_total(
        hourly, ["zone_id"], ["hour_ms"], F.col("n"), F.floor(F.col("hour_ms") / dwell.DAY_MS), "total"
    ).withColumn("week", F.expr("hour_ms div 604800000"))
    return dwell.delta_counters(totals, ["zone_id"], "hour_ms", "total", "week").select("zone_id", "hour_ms", "week", "delta")


@query("recent_zone_events", "zev", "SELECT tracklet_id, zone_id, event_type, ts_ms FROM zev WHERE camera_id = 'CAM_02' ORDER BY ts_ms DESC, tracklet_id LIMIT 50")
def recent_zone_events(v: Views) -> DataFrame:
    return read_api.recent_zone_events(v.zone_events, "CAM_02").select("tracklet_id", "zone_id", "event_type", "ts_ms")


@query("dwell_recent", "stays", "SELECT global_id, zone_id, entered_ms, status FROM stays ORDER BY entered_ms DESC, global_id, zone_id LIMIT 50")
def dwell_recent(v: Views) -> DataFrame:
    return read_api.dwell_recent(stays(v)).select("global_id", "zone_id", "entered_ms", "status")


@query("open_dwell", "stays", "SELECT global_id, zone_id, entered_ms FROM stays WHERE status = 'open'")
def open_dwell(v: Views) -> DataFrame:
    return read_api.open_dwell(stays(v)).select("global_id", "zone_id", "entered_ms")
