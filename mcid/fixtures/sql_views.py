"""The derived views as SQL common table expressions (DuckDB dialect)."""

from __future__ import annotations

from . import dimensions


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, float):
        return f"{value}::DOUBLE"
    if isinstance(value, int):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def _values(rows: list[tuple], columns: str) -> str:
    body = ", ".join("(" + ", ".join(_literal(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS v({columns})"


_TEXT = {
    "cameras": _values(
        dimensions.CAMERAS,
        "camera_id, name, rtsp_url_env_key, width, height, fps_target, is_active",
    ),
    "links": _values(
        dimensions.LINKS,
        "from_camera_id, to_camera_id, min_travel_seconds, max_travel_seconds, transition_probability, enabled",
    ),
    "zones": _values(
        dimensions.ZONES,
        "zone_id, camera_id, name, polygon_json, zone_type, is_entry_zone, is_exit_zone, enabled, ord",
    ),
    "ev": """
        SELECT event_id, user_id, event_type, value, props, epoch_us(ts) // 1000 AS ts_ms,
               'CAM_0' || (1 + (user_id + hour(ts)) % 5)::VARCHAR AS camera_id
        FROM events""",
    "det": """
        SELECT event_id, event_id * 32 + i AS det_id, camera_id, user_id AS local_track_id,
               i AS frame_id, (ts_ms + i * 200) // 200 AS frame_no, ts_ms + i * 200 AS ts_ms,
               ((event_id * 37 + i * 5) % 1700)::DOUBLE AS x1,
               ((event_id * 53) % 800)::DOUBLE AS y1,
               ((event_id * 37 + i * 5) % 1700 + 40 + event_id % 80)::DOUBLE AS x2,
               ((event_id * 53) % 800 + 60 + event_id % 200)::DOUBLE AS y2,
               (40 + event_id % 60)::DOUBLE / 100 AS score, event_type, value
        FROM (SELECT *, unnest(range(5 + event_id % 20)) AS i FROM ev)""",
    "aux": """
        SELECT det_id AS aux_id, camera_id, frame_id, frame_no * 200 + event_id % 90 AS ts_ms,
               x1 + event_id % 120 AS x1, y1, x2 + event_id % 120 AS x2, y2,
               (30 + (event_id * 7 + frame_id) % 70)::DOUBLE / 100 AS score
        FROM det""",
    "tl": """
        SELECT event_id, 'T' || event_id AS tracklet_id, camera_id, user_id AS local_track_id,
               ts_ms AS start_ms,
               CASE WHEN event_id % 23 <> 0 THEN ts_ms + (4 + event_id % 20) * 200 END AS end_ms,
               'Z' || (1 + event_id % 6) AS start_zone_id,
               CASE WHEN event_id % 7 <> 0 THEN 'Z' || (1 + (event_id * 5) % 6) END AS end_zone_id,
               CASE WHEN event_id % 9 <> 0 THEN 's3://crops/evidence/pending/site_1/' || camera_id
                    || '/T' || event_id || '/best.jpg' END AS best_crop_uri,
               CASE WHEN event_id % 17 <> 0 THEN (event_id % 101)::DOUBLE / 100 END AS quality_score,
               5 + event_id % 20 AS frame_count, 1 + event_id % 4 AS embedding_count,
               'G' || user_id AS truth_id
        FROM ev""",
    "vecs": "SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings",
    "mixed": """
        SELECT ev.*, list_transform(list_zip(a.e, b.e, c.e),
                 lambda t: t[1] + t[2] * 0.15::DOUBLE + t[3] * (0.1::DOUBLE * (event_id % 7))) AS m
        FROM ev CROSS JOIN (SELECT count(*) AS n FROM embeddings) k
        JOIN vecs a ON a.vec_id = user_id % k.n
        JOIN vecs b ON b.vec_id = (7 * (user_id % k.n) + 3) % k.n
        JOIN vecs c ON c.vec_id = (11 * event_id + 5) % k.n""",
    "points": """
        SELECT 'T' || event_id AS tracklet_id, event_id, camera_id,
               1704067200 + (ts_ms - (SELECT min(ts_ms) FROM ev)) // 300000 AS ts,
               list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS vector,
               CASE WHEN event_id % 17 <> 0 THEN (event_id % 101)::DOUBLE / 100 END AS quality_score,
               'Z' || (1 + event_id % 6) AS zone_id, 'G' || user_id AS truth_id
        FROM mixed""",
    "zev": """
        SELECT event_id, 'G' || user_id AS global_id, 'T' || event_id AS tracklet_id,
               'CAM_0' || (1 + z % 5) AS camera_id, 'Zone ' || z AS zone_id, event_type, ts_ms
        FROM (SELECT event_id, user_id, ts_ms, 1 + (user_id + day(make_timestamp(ts_ms * 1000))) % 6 AS z,
                     CASE WHEN event_type IN ('view', 'click') THEN 'enter'
                          WHEN event_type IN ('purchase', 'signup') THEN 'exit' END AS event_type
              FROM ev) WHERE event_type IS NOT NULL""",
    "hits": """
        SELECT event_id, 'T' || event_id AS tracklet_id, camera_id, user_id AS local_track_id, ts_ms,
               'G' || user_id AS truth_id,
               CASE WHEN h1 THEN 'G' || (user_id + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END) END AS top1_global_id,
               CASE WHEN h1 THEN 'CAM_0' || (1 + (event_id * 3) % 5) END AS top1_camera_id,
               CASE WHEN h1 THEN (6000 + (event_id * 7919) % 4001)::DOUBLE / 10000 END AS top1_score,
               CASE WHEN h2 THEN 'G' || (user_id + 2) END AS top2_global_id,
               CASE WHEN h2 THEN 'CAM_0' || (1 + (event_id * 3 + 1) % 5) END AS top2_camera_id,
               CASE WHEN h2 THEN (6000 + (event_id * 7919) % 4001 - (event_id * 104729) % 2000)::DOUBLE / 10000 END AS top2_score,
               ((event_id * 31) % 240)::DOUBLE AS time_diff_seconds,
               CASE WHEN event_id % 17 <> 0 THEN (event_id % 131)::DOUBLE / 100 END AS quality_score,
               CASE WHEN event_id % 5 <> 0 THEN 'Z' || (event_id % 3) END AS prev_zone_id,
               CASE WHEN event_id % 7 <> 0 THEN 'Z' || (event_id % 4) END AS new_zone_id
        FROM (SELECT *, event_id % 13 <> 0 AS h1, event_id % 13 <> 0 AND event_id % 11 <> 0 AS h2 FROM ev)""",
    "ticks": """
        SELECT event_id, camera_id, ts_ms, value AS latency_ms, event_type <> 'error' AS ok FROM ev""",
}

_NEEDS = {
    "det": ["ev"],
    "aux": ["det"],
    "tl": ["ev"],
    "mixed": ["ev", "vecs"],
    "points": ["mixed"],
    "zev": ["ev"],
    "hits": ["ev"],
    "ticks": ["ev"],
}


def register_view(name: str, text: str, needs: list[str]) -> None:
    """Add a shared expression built on the base views."""
    _TEXT[name] = text
    _NEEDS[name] = needs


def with_views(names: str, query: str) -> str:
    """Prefix ``query`` with the named views and everything they stand on. A
    query that opens with its own WITH list is merged into the same list."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for dep in _NEEDS.get(name, []):
            visit(dep)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        visit(name)
    head = ",\n".join(f"{n} AS ({_TEXT[n]})" for n in ordered)
    body = query.strip()
    if body.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head},\n{body[15:]}"
    if body.startswith("WITH "):
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"
