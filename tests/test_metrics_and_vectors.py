"""Matching and metrics on cases that the derived tables do not hold; bad vectors; loose numbers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mcid.operators import candidates, evaluation, telemetry, tracklets
from mcid.sources import readers, writers

TRUE = "camera_id string, frame_no bigint, true_id bigint, ts_ms bigint, x1 double, y1 double, x2 double, y2 double"
PRED = "camera_id string, frame_no bigint, pred_id bigint, x1 double, y1 double, x2 double, y2 double"


def test_pairs_are_one_to_one_and_greedy(spark):
    # 1 is the best of both predictions; the second prediction still finds 2
    true = spark.createDataFrame([("C", 1, 1, 0, 0.0, 0.0, 10.0, 10.0), ("C", 1, 2, 0, 2.0, 0.0, 12.0, 10.0)], TRUE)
    pred = spark.createDataFrame([("C", 1, 8, 0.0, 0.0, 10.0, 10.0), ("C", 1, 9, 0.5, 0.0, 10.5, 10.0)], PRED)
    got = evaluation.join_boxes(true, pred).collect()
    assert sorted((r.true_id, r.pred_id) for r in got) == [(1, 8), (2, 9)]


def test_cameras_of_one_side_stay(spark):
    true = spark.createDataFrame([("A", 1, 1, 0, 0.0, 0.0, 10.0, 10.0), ("A", 2, 2, 3_600_000, 0.0, 0.0, 10.0, 10.0)], TRUE)
    pred = spark.createDataFrame([("B", 1, 8, 0.0, 0.0, 10.0, 10.0)], PRED)
    got = {r.camera_id: (r.tp, r.fp, r.fn, r.recall, r.precision) for r in evaluation.detection_metrics(true, pred).collect()}
    assert got == {"A": (0, 0, 2, 0.0, None), "B": (0, 1, 0, None, 0.0)}


def test_tracklets_without_hits_count_as_wrong(spark):
    labelled = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "tracklet_id string")
    ranked = spark.createDataFrame([("a", 1, "p", "p"), ("b", 1, "p", "q"), ("b", 2, "p", "p")], "tracklet_id string, rank int, truth_id string, cand_truth_id string")
    got = evaluation.topk_accuracy(labelled, ranked).first()
    assert (got.tracklets, got.top_1_accuracy, got.top_5_accuracy) == (4, 0.25, 0.5)


def test_total_rate(spark):
    ticks = spark.createDataFrame([(c, i * step) for c, step in (("A", 100), ("B", 200)) for i in range(11)], "camera_id string, ts_ms bigint")
    assert {r.camera_id: r.fps for r in telemetry.fps_report(ticks).collect()} == {"A": 10.0, "B": 5.0, "total": 15.0}


def test_sampling_has_no_limit_of_its_own(spark):
    rows = [(f"t{i:05d}", "C", i * 10, f"u{i}") for i in range(1200)]
    df = spark.createDataFrame(rows, "tracklet_id string, camera_id string, start_ms bigint, best_crop_uri string")
    assert telemetry.sample_every_n(df, 2).count() == 600
    assert telemetry.sample_every_n(df, 2, limit=7).count() == 7


def test_bad_vectors_meet_nobody(spark):
    unit = [1.0] + [0.0] * 7
    rows = [("a", "C", 100, unit), ("b", "C", 200, unit), ("short", "C", 150, [1.0, 0.0, 0.0, 0.0]), ("none", "C", 160, None), ("gap", "C", 170, [None] + unit[1:]), ("zero", "C", 180, [])]
    df = spark.createDataFrame(rows, "tracklet_id string, camera_id string, ts bigint, vector array<double>")
    links = spark.createDataFrame([], "from_camera_id string, to_camera_id string, min_travel_seconds double, max_travel_seconds double, enabled boolean")
    windows = candidates.search_windows(df.select("camera_id").distinct(), links)
    got = [(r.tracklet_id, r.cand_tracklet_id) for r in candidates.search(df, df, windows, 0.5).collect()]
    assert got == [("b", "a")]


@pytest.mark.parametrize(
    "frame, ts, want",
    [("7", "5", (7, 5)), ("7.0", "1718000000000.5", (7, 1718000000000)), ('"7"', "5", (7, 5)), ('"7.0"', "5", "bad_number"), ("1e3", "5", (1000, 5))],
)
def test_numbers_in_json(spark, frame, ts, want):
    text = f'{{"camera_id":"CAM_1","frame_id":{frame},"local_track_id":3,"timestamp_ms":{ts},"bbox":[1,2,3,4]}}'
    r = readers.judge_detections(spark.createDataFrame([(text,)], "value string"), now_ms=F.lit(9).cast("bigint")).first()
    assert r.reason == want if isinstance(want, str) else (r.reason, r.frame_id, r.timestamp_ms) == (None, *want)


def test_equal_versions_are_settled_by_the_row(spark):
    stored = spark.createDataFrame([("k", 1, "old")], "id string, version int, v string")
    incoming = spark.createDataFrame([("k", 2, x) for x in "cab"], "id string, version int, v string")
    for part in (1, 3):
        got = writers.upsert_latest(stored, incoming.repartition(part), ["id"], "version").collect()
        assert [(r.version, r.v) for r in got] == [(2, "c")]
        fresh = writers.new_rows(incoming.repartition(part), stored.where("false"), ["id"]).collect()
        assert [r.v for r in fresh] == ["a"]


def test_mean_of_one_key_with_most_vectors(spark, monkeypatch):
    """Sums meet across tasks and flushes; a key is never one group of vectors, and no row is made per position."""
    rnd = np.random.default_rng(4)
    rows = [("hot" if k % 3 else None, k % 2, rnd.normal(size=3840 if k % 5 else 100).tolist()) for k in range(600)]
    rows += [("gap", 0, [1.0, None, 2.0]), ("gap", 0, None), ("gap", 0, []), ("zero", 1, [0.0, 0.0]), ("one", 1, [3.0, 4.0])]
    df = spark.createDataFrame(rows, "name string, side long, v array<double>").repartition(7)
    monkeypatch.setattr(tracklets, "HELD", 5000)
    out = tracklets.mean_vectors(df, ["name", "side"], "v")
    plan = out._jdf.queryExecution().toString()
    assert "Generate" not in plan and "collect_list" not in plan
    got = {(r.name, r.side): np.array(r.v) for r in out.collect()}
    want = {}
    for name, side, v in rows:
        if v and None not in v:
            total, count = want.setdefault((name, side), (np.zeros(4000), np.zeros(4000)))
            total[: len(v)] += np.array(v) / (np.linalg.norm(v) or 1)
            count[: len(v)] += 1
    assert got.keys() == want.keys() == {("hot", 0), ("hot", 1), (None, 0), (None, 1), ("zero", 1), ("one", 1)}
    for key, (total, count) in want.items():
        mean = (total / np.maximum(count, 1))[: int((count > 0).sum())]
        assert np.allclose(got[key], mean / (np.linalg.norm(mean) or 1), atol=1e-12)
