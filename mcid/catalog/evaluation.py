"""Accuracy reports against labels, gates and calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import Views
from ..fixtures.sql_views import register_view
from ..functions import scoring
from ..operators import candidates, evaluation
from . import query
from .identity import hits, sightings
from .scores import decisions, scored


def labels(v: Views) -> DataFrame:
    """Truth for all tracklets but every eleventh."""
    return v.tracklets.select(
        "tracklet_id", F.when(F.col("event_id") % 11 != 4, F.col("truth_id")).alias("truth_id")
    ).where("truth_id IS NOT NULL")


register_view("truth", "SELECT tracklet_id, truth_id FROM tl WHERE event_id % 11 <> 4", ["tl"])


def judged(v: Views) -> DataFrame:
    return evaluation.join_truth(decisions(v).drop("truth_id"), labels(v))


@query(
    "join_truth",
    "dec truth",
    "SELECT d.tracklet_id, decision, assigned_global_id, t.truth_id FROM dec d LEFT JOIN truth t USING (tracklet_id)",
)
def join_truth(v: Views) -> DataFrame:
    return judged(v).select("tracklet_id", "decision", "assigned_global_id", "truth_id")


@query(
    "eval_counts",
    "dec truth",
    """
    WITH j AS (SELECT d.* EXCLUDE (truth_id), t.truth_id FROM dec d LEFT JOIN truth t USING (tracklet_id)),
    f AS (SELECT assigned_global_id AS gid, min((ts_ms, event_id)) AS first FROM j WHERE assigned_global_id IS NOT NULL GROUP BY 1),
    c AS (SELECT count(*) AS total, count(*) FILTER (decision = 'match' AND assigned_global_id = truth_id) AS matches,
                 count(*) FILTER (decision = 'match' AND assigned_global_id <> truth_id) AS false_merges,
                 count(*) FILTER (decision = 'new' AND first < (ts_ms, event_id)) AS fragmentations,
                 count(*) FILTER (decision = 'ambiguous') AS ambiguous FROM j LEFT JOIN f ON gid = truth_id)
    SELECT total, matches, false_merges, fragmentations, ambiguous, round(matches / total, 9) AS accuracy, round(false_merges / total, 9) AS merge_rate FROM c""",
)
def eval_counts(v: Views) -> DataFrame:
    out = evaluation.eval_counts(judged(v), ["ts_ms", "event_id"])
    return out.select(
        "total", "matches", "false_merges", "fragmentations", "ambiguous",
        F.round("cross_camera_match_accuracy", 9).alias("accuracy"), F.round("false_merge_rate", 9).alias("merge_rate"),
    )


def segments(v: Views) -> DataFrame:
    e = F.col("event_id")
    flags = F.array(*[F.lit(x) for x in ("ok", "occluded_part", "occluded_in_middle", "partial_exit", "re_entry_uncertain")])
    return v.events.select(
        F.concat(F.lit("P"), "user_id").alias("person_id"),
        e.alias("segment_id"),
        "camera_id",
        (F.col("ts_ms") - 30000).alias("seg_from_ms"),
        (F.col("ts_ms") + (e % 40) * 1000).alias("seg_to_ms"),
        F.get(flags, e % 5).alias("quality_flag"),
    )


register_view(
    "seg",
    """
    SELECT 'P' || user_id AS person_id, event_id AS segment_id, camera_id, ts_ms - 30000 AS seg_from_ms, ts_ms + event_id % 40 * 1000 AS seg_to_ms,
           ['ok', 'occluded_part', 'occluded_in_middle', 'partial_exit', 're_entry_uncertain'][event_id % 5 + 1] AS quality_flag FROM ev""",
    ["ev"],
)
register_view(
    "segpair",
    """
    SELECT person_id, segment_id, quality_flag, d.tracklet_id, assigned_global_id AS global_id
    FROM seg s JOIN dec d ON s.camera_id = d.camera_id AND d.ts_ms <= seg_to_ms AND d.ts_ms + 2000 >= seg_from_ms""",
    ["seg", "dec"],
)


def segment_pairs(v: Views) -> DataFrame:
    spans = decisions(v).select(
        "tracklet_id", "camera_id", F.col("ts_ms").alias("from_ms"), (F.col("ts_ms") + 2000).alias("to_ms"),
        F.col("assigned_global_id").alias("global_id"),
    )
    return evaluation.join_segments(spans, segments(v))


@query("join_segments", "segpair", "SELECT * FROM segpair")
def join_segments(v: Views) -> DataFrame:
    return segment_pairs(v).select("person_id", "segment_id", "quality_flag", "tracklet_id", "global_id")


@query(
    "label_metrics",
    "segpair",
    """
    WITH e AS (SELECT DISTINCT person_id, segment_id, quality_flag, global_id FROM segpair WHERE global_id IS NOT NULL),
    u AS (SELECT DISTINCT person_id, global_id FROM e WHERE quality_flag <> 'occluded_in_middle'),
    shared AS (SELECT global_id FROM u GROUP BY 1 HAVING count(*) > 1),
    x AS (SELECT person_id, count(*) AS segments FROM seg GROUP BY 1 HAVING count(DISTINCT camera_id) > 1),
    cov AS (SELECT person_id, count(DISTINCT global_id) AS ids, count(DISTINCT segment_id) AS hit FROM e GROUP BY 1),
    fair AS (SELECT * FROM seg WHERE quality_flag NOT IN ('occluded_in_middle', 'partial_exit'))
    SELECT round((SELECT count(DISTINCT person_id) FROM u WHERE global_id IN (FROM shared)) / (SELECT count(DISTINCT person_id) FROM seg), 9) AS false_merge_rate,
      round((SELECT count(*) FILTER (ids = 1 AND hit = segments) / count(*) FROM x LEFT JOIN cov USING (person_id)), 9) AS cross_camera_match_accuracy,
      round((SELECT count(*) FROM (SELECT segment_id FROM e WHERE segment_id IN (SELECT segment_id FROM fair) GROUP BY 1 HAVING count(DISTINCT global_id) > 1))
        / (SELECT count(*) FROM fair), 9) AS id_fragmentation_rate,
      round((SELECT avg(CASE WHEN decision = 'ambiguous' THEN 1 ELSE 0 END) FROM dec), 9) AS ambiguous_decision_rate""",
)
def label_metrics(v: Views) -> DataFrame:
    out = evaluation.label_metrics(segment_pairs(v), segments(v), decisions(v))
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query(
    "topk_accuracy",
    "cand tl",
    """
    SELECT count(*) AS tracklets, round(avg(coalesce(one, 0)), 9) AS top_1_accuracy, round(avg(coalesce(many, 0)), 9) AS top_5_accuracy FROM tl LEFT JOIN (
      SELECT r.tracklet_id, max(CASE WHEN a.truth_id = b.truth_id AND rank <= 1 THEN 1 ELSE 0 END) AS one, max(CASE WHEN a.truth_id = b.truth_id THEN 1 ELSE 0 END) AS many
      FROM (SELECT *, row_number() OVER (PARTITION BY tracklet_id ORDER BY cosine DESC, cand_tracklet_id) AS rank FROM cand) r
      JOIN tl a ON a.tracklet_id = r.tracklet_id JOIN tl b ON b.tracklet_id = r.cand_tracklet_id WHERE rank <= 5 GROUP BY 1) USING (tracklet_id)""",
)
def topk_accuracy(v: Views) -> DataFrame:
    truth = v.tracklets.select("tracklet_id", "truth_id")
    ranked = candidates.rank_hits(hits(v, 5), 5).join(truth, "tracklet_id").join(
        truth.select(F.col("tracklet_id").alias("cand_tracklet_id"), F.col("truth_id").alias("cand_truth_id")), "cand_tracklet_id"
    )
    out = evaluation.topk_accuracy(truth, ranked)
    return out.select("tracklets", *[F.round(c, 9).alias(c) for c in ("top_1_accuracy", "top_5_accuracy")])


# ---- detections --------------------------------------------------------------------
def true_boxes(v: Views) -> DataFrame:
    return v.detections.withColumnRenamed("det_id", "true_id")


def predicted_boxes(v: Views) -> DataFrame:
    return v.aux.withColumnRenamed("aux_id", "pred_id").withColumn("frame_no", F.expr("ts_ms div 200"))


register_view(
    "boxpair",
    """
    WITH RECURSIVE pr AS (
      SELECT *, row_number() OVER (PARTITION BY camera_id, frame_no ORDER BY iou DESC, true_id, pred_id) AS k FROM (
        SELECT *, round(i / ((tx2 - tx1) * (ty2 - ty1) + (px2 - px1) * (py2 - py1) - i), 9) AS iou FROM (
          SELECT t.camera_id, t.frame_no, t.det_id AS true_id, p.aux_id AS pred_id, t.x1 AS tx1, t.x2 AS tx2, t.y1 AS ty1, t.y2 AS ty2,
                 p.x1 AS px1, p.x2 AS px2, p.y1 AS py1, p.y2 AS py2,
                 greatest(0, least(t.x2, p.x2) - greatest(t.x1, p.x1)) * greatest(0, least(t.y2, p.y2) - greatest(t.y1, p.y1)) AS i
          FROM det t JOIN aux p ON t.camera_id = p.camera_id AND t.frame_no = p.ts_ms // 200)) WHERE iou >= 0.5),
    taken AS (
      SELECT camera_id, frame_no, k, [true_id] AS ts, [pred_id] AS ps, [k] AS ks FROM pr WHERE k = 1
      UNION ALL
      SELECT t.camera_id, t.frame_no, n.k, list_concat(t.ts, CASE WHEN hit THEN [] ELSE [n.true_id] END),
             list_concat(t.ps, CASE WHEN hit THEN [] ELSE [n.pred_id] END), list_concat(t.ks, CASE WHEN hit THEN [] ELSE [n.k] END)
      FROM (SELECT *, k + 1 AS next FROM taken) t JOIN pr n ON n.camera_id = t.camera_id AND n.frame_no = t.frame_no AND n.k = t.next,
           LATERAL (SELECT list_contains(t.ts, n.true_id) OR list_contains(t.ps, n.pred_id) AS hit) h)
    SELECT true_id, pred_id, iou FROM pr JOIN (SELECT camera_id, frame_no, unnest(arg_max(ks, k)) AS k FROM taken GROUP BY 1, 2) USING (camera_id, frame_no, k)""",
    ["det", "aux"],
)


@query("join_boxes", "boxpair", "SELECT * FROM boxpair")
def join_boxes(v: Views) -> DataFrame:
    return evaluation.join_boxes(true_boxes(v), predicted_boxes(v)).select("true_id", "pred_id", "iou")


@query(
    "detection_metrics",
    "boxpair",
    """
    SELECT camera_id, coalesce(tp, 0) AS tp, coalesce(preds, 0) - coalesce(tp, 0) AS fp, coalesce(truths - tp, 0) AS fn, round(tp / truths, 9) AS recall, round(coalesce(tp, 0) / preds, 9) AS precision,
           round(small_tp / small, 9) AS small_recall, round((coalesce(preds, 0) - tp) / hours, 6) AS fp_per_hour
    FROM (SELECT camera_id, count(*) AS truths, count(pred_id) AS tp, count(*) FILTER (y2 - y1 < 80) AS small, count(pred_id) FILTER (y2 - y1 < 80) AS small_tp,
                 (max(ts_ms) - min(ts_ms))::DOUBLE / 3600000 AS hours FROM det LEFT JOIN boxpair ON true_id = det_id GROUP BY 1)
    FULL JOIN (SELECT camera_id, count(*) AS preds FROM aux GROUP BY 1) USING (camera_id)""",
)
def detection_metrics(v: Views) -> DataFrame:
    out = evaluation.detection_metrics(true_boxes(v), predicted_boxes(v))
    rounded = {c: F.round(c, 9) for c in ("recall", "precision", "small_recall")}
    return out.withColumns({**rounded, "fp_per_hour": F.round("fp_per_hour", 6)})


@query(
    "tracking_metrics",
    "det",
    """
    WITH f AS (SELECT local_track_id AS truth_id, local_track_id // 2 * 100 + frame_id // 8 AS track_id, ts_ms, det_id FROM det),
    p AS (SELECT truth_id, count(*) AS frames, count(*) FILTER (before <> track_id) AS switches, count(DISTINCT track_id) AS tracks
          FROM (SELECT *, lag(track_id) OVER (PARTITION BY truth_id ORDER BY ts_ms, det_id) AS before FROM f) GROUP BY 1)
    SELECT round(sum(switches) / sum(tracks), 9) AS switches_per_track, round(avg(tracks), 9) AS tracks_per_person,
           round(1 - sum(switches) / sum(frames), 9) AS id_stability,
           round((SELECT avg(m / s) FROM (SELECT max(n) AS m, sum(n) AS s FROM (SELECT track_id, truth_id, count(*) AS n FROM f GROUP BY 1, 2) GROUP BY track_id)), 9) AS track_purity
    FROM p""",
)
def tracking_metrics(v: Views) -> DataFrame:
    frames = v.detections.select(
        F.col("local_track_id").alias("truth_id"),
        F.expr("local_track_id div 2 * 100 + frame_id div 8").alias("track_id"),
        "ts_ms",
        "det_id",
    )
    out = evaluation.tracking_metrics(frames)
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


# ---- decisions ------------------------------------------------------------------------
@query(
    "compare_shadow",
    "dec",
    """
    WITH s AS (SELECT tracklet_id, top1_global_id, CASE WHEN top1_score IS NULL OR link = FALSE THEN 'new' WHEN final >= 0.85 AND margin > 0.05 THEN 'match'
          WHEN final >= 0.72 AND margin > 0.05 THEN 'candidate' WHEN final >= 0.72 THEN 'ambiguous' ELSE 'new' END AS b FROM dec),
    j AS (SELECT l.decision AS a, l.assigned_global_id AS ga, s.b, CASE WHEN s.b = 'match' THEN s.top1_global_id END AS gb
          FROM (SELECT * FROM dec WHERE decision <> 'candidate') l FULL JOIN (SELECT * FROM s WHERE b <> 'ambiguous') s USING (tracklet_id))
    SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS "both", count(*) FILTER (a = b) AS same_decision,
           count(*) FILTER (a IS NOT NULL AND b IS NOT NULL AND ga IS NOT DISTINCT FROM gb) AS same_identity,
           count(*) FILTER (b IS NULL) AS live_only, count(*) FILTER (a IS NULL) AS shadow_only FROM j""",
)
def compare_shadow(v: Views) -> DataFrame:
    policy = scoring.Policy(auto_match=0.85, override=None)
    d = scoring.decide(F.col("top1_score"), F.col("top2_score"), F.col("link"), F.col("final_score"), policy)
    shadow = scored(v).withColumn("decision", d).withColumn(
        "assigned_global_id", F.when(F.col("decision") == "match", F.col("top1_global_id"))
    )
    return evaluation.compare_shadow(
        decisions(v).where("decision <> 'candidate'"), shadow.where("decision <> 'ambiguous'")
    )


REPORTS = """
    SELECT ts_ms // 86400000 AS report_id, CASE WHEN ts_ms // 86400000 % 2 = 0 THEN 'production_benchmark' ELSE 'smoke' END AS mode,
      count(*) FILTER (decision = 'match' AND assigned_global_id <> truth_id) / count(*) * 2 AS fm,
      count(*) FILTER (decision = 'match') / count(*) + CASE WHEN ts_ms // 86400000 % 3 = 0 THEN 0.8::DOUBLE ELSE 0 END + 1e-9::DOUBLE AS ma, max(time_diff_seconds) AS lat
    FROM dec GROUP BY 1, 2"""


@query(
    "gate_check",
    "dec",
    f"""
    WITH r AS ({REPORTS}),
    fps AS (SELECT ts_ms // 86400000 AS report_id, camera_id, count(*)::DOUBLE / 12 AS fps FROM dec GROUP BY 1, 2),
    m AS (
      SELECT report_id, CASE WHEN fm > 0.05 THEN printf('false_merge_rate=%.4f > threshold=%.4f', fm, 0.05::DOUBLE) END AS message FROM r
      UNION ALL SELECT report_id, CASE WHEN ma < 0.85 THEN printf('cross_camera_match_accuracy=%.4f < threshold=%.4f', ma, 0.85::DOUBLE) END FROM r
      UNION ALL SELECT report_id, CASE WHEN lat > 200 THEN printf('qdrant_query_latency_p99_ms=%.0f > threshold=%.0f', lat, 200::DOUBLE) END FROM r
      UNION ALL SELECT report_id, CASE WHEN fps < 5 THEN printf('fps[%s]=%.2f < threshold=%.2f', camera_id, fps, 5::DOUBLE) END FROM fps
      UNION ALL SELECT report_id, CASE WHEN mode = 'production_benchmark' THEN 'missing required metrics: id_fragmentation_rate' END FROM r)
    SELECT r.report_id, count(message) = 0 AS passed, coalesce(string_agg(message, '; ' ORDER BY message), '') AS failures
    FROM r LEFT JOIN m USING (report_id) GROUP BY 1""",
)
def gate_check(v: Views) -> DataFrame:
    d = decisions(v).withColumn("report_id", F.expr("ts_ms div 86400000"))
    match = F.col("decision") == "match"
    daily = d.groupBy("report_id").agg(
        (F.count(F.when(match & (F.col("assigned_global_id") != F.col("truth_id")), 1)) / F.count("*") * 2).alias("false_merge_rate"),
        (F.count(F.when(match, 1)) / F.count("*") + F.when(F.col("report_id") % 3 == 0, 0.8).otherwise(0.0) + 1e-9).alias("cross_camera_match_accuracy"),
        F.max("time_diff_seconds").alias("qdrant_query_latency_p99_ms"),
    )
    # every rate is also held by the nested block with a value that must be ignored
    melted = daily.unpivot(["report_id"], ["false_merge_rate", "cross_camera_match_accuracy", "qdrant_query_latency_p99_ms"], "metric", "value")
    flat = melted.select("report_id", "metric", F.lit("").alias("key"), F.lit(0).alias("nested"), "value")
    hidden = melted.select("report_id", "metric", F.lit("").alias("key"), F.lit(1).alias("nested"), F.lit(0.5).alias("value"))
    fps = d.groupBy("report_id", F.col("camera_id").alias("key")).agg((F.count("*") / F.lit(12.0)).alias("value")).select(
        "report_id", F.lit("per_camera_analytics_fps").alias("metric"), "key", F.lit(0).alias("nested"), "value"
    )
    reports = daily.select("report_id", F.when(F.col("report_id") % 2 == 0, "production_benchmark").otherwise("smoke").alias("mode"))
    return evaluation.gate_check(flat.unionByName(hidden).unionByName(fps), reports)


@query(
    "calibrate_links",
    "sight links",
    """
    SELECT c.from_camera_id, c.to_camera_id, trips, p05, p95, NOT coalesce(enabled AND min_travel_seconds <= p05 AND max_travel_seconds >= p95, FALSE) AS review
    FROM (SELECT f AS from_camera_id, camera_id AS to_camera_id, count(*) AS trips, round(quantile_cont(s, 0.05), 6) AS p05, round(quantile_cont(s, 0.95), 6) AS p95
          FROM (SELECT camera_id, lag(camera_id) OVER w AS f, (ts_ms - lag(ts_ms) OVER w)::DOUBLE / 1000 AS s FROM sight
                WINDOW w AS (PARTITION BY global_id ORDER BY ts_ms, tracklet_id)) WHERE f <> camera_id GROUP BY 1, 2) c
    LEFT JOIN links l ON l.from_camera_id = c.from_camera_id AND l.to_camera_id = c.to_camera_id""",
)
def calibrate_links(v: Views) -> DataFrame:
    out = evaluation.calibrate_links(sightings(v), v.links)
    return out.withColumns({c: F.round(c, 6) for c in ("p05", "p95")})


@query(
    "score_histogram",
    "scored",
    """
    WITH b AS (SELECT least(floor(final * 20)::BIGINT + 1, 20) AS bin, count(*) FILTER (top1_global_id = truth_id) AS r,
                      count(*) FILTER (top1_global_id <> truth_id) AS w FROM scored WHERE top1_global_id IS NOT NULL GROUP BY 1)
    SELECT bin, r AS "right", w AS wrong, round(sum(r) OVER (ORDER BY bin DESC) / sum(r) OVER (), 9) AS tpr, round(sum(w) OVER (ORDER BY bin DESC) / sum(w) OVER (), 9) AS fpr FROM b""",
)
def score_histogram(v: Views) -> DataFrame:
    rows = scored(v).where("top1_global_id IS NOT NULL").withColumn("is_match", F.col("top1_global_id") == F.col("truth_id"))
    out = evaluation.score_histogram(rows)
    return out.withColumns({c: F.round(c, 9) for c in ("tpr", "fpr")})


@query(
    "ambiguous_review",
    "dec",
    """
    SELECT strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d') AS day, count(*) AS decisions, round(avg(CASE WHEN decision = 'ambiguous' THEN 1 ELSE 0 END), 9) AS rate,
           avg(CASE WHEN decision = 'ambiguous' THEN 1 ELSE 0 END) > 0.1 AS review FROM dec GROUP BY 1""",
)
def ambiguous_review(v: Views) -> DataFrame:
    return evaluation.ambiguous_review(decisions(v)).withColumn("rate", F.round("rate", 9))
