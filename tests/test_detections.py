"""Union, suppression and tracking against plain loops on small frames."""

import random

import pytest
from pyspark.sql import functions as F

from mcid.operators import detections, tracklets

COLS = "camera_id string, frame_no bigint, box_id bigint, x1 double, y1 double, x2 double, y2 double, score double, source string"


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inter = max(0.0, w) * max(0.0, h)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return inter / union if union > 0 else 0.0


def greedy(rows, above=0.5):
    """Kept box ids with their tag."""
    order = sorted(rows, key=lambda r: (-r[7], r[2], r[8]))
    kept = []
    for r in order:
        if not any(iou(k[3:7], r[3:7]) > above for k in kept):
            kept.append(r)
    return {
        (k[2], "merged" if any(o[8] != k[8] and iou(o[3:7], k[3:7]) > above for o in rows) else k[8]) for k in kept
    }


def random_frame(n, seed):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        x, y = rnd.randrange(0, 400), rnd.randrange(0, 400)
        out.append(("C", 1, i, float(x), float(y), float(x + rnd.randrange(40, 160)), float(y + rnd.randrange(40, 160)), rnd.randrange(0, 50) / 50, rnd.choice(["pphuman", "sahi"])))
    return out


@pytest.mark.parametrize("limit", [512, 0])
def test_suppress(spark, limit):
    """Both paths, the short array and the pairwise rounds, agree with the loop."""
    rows = random_frame(120, 3)
    rows += [(*r[:2], r[2] + 1000, *r[3:]) for r in rows[:30]]  # copies
    got = detections.suppress(spark.createDataFrame(rows, COLS), ["camera_id", "frame_no"], array_limit=limit)
    assert {(r.box_id, r.source) for r in got.collect()} == greedy(rows)


def union(spark, primary, aux, t_primary, t_aux):
    frames = spark.createDataFrame([("C", 1, t_primary)], "camera_id string, frame_no bigint, ts_ms bigint")
    events = spark.createDataFrame([("C", 1, t_aux)], "camera_id string, frame_no bigint, ts_ms bigint")
    near = detections.nearest_event(frames, events)
    cols = "camera_id string, frame_no bigint, box_id bigint, x1 double, y1 double, x2 double, y2 double, score double"
    p = spark.createDataFrame([("C", 1, i, *map(float, b)) for i, b in enumerate(primary)], cols)
    a = spark.createDataFrame([("C", t_aux, i, *map(float, b)) for i, b in enumerate(aux)], cols.replace("frame_no", "ts_ms"))
    boxes = detections.union_boxes(p, a, near)
    return sorted((r.source, r.score) for r in detections.suppress(boxes, ["camera_id", "frame_no"]).collect())


def test_union_goldens(spark):
    person = (10, 10, 100, 100, 0.95)
    assert union(spark, [person], [(15, 15, 95, 95, 0.7)], 1000, 1000) == [("merged", 0.95)]
    assert union(spark, [person], [(300, 300, 400, 400, 0.7)], 1000, 1010) == [("pphuman", 0.95), ("sahi", 0.7)]
    assert union(spark, [person], [(300, 300, 400, 400, 0.7)], 5000, 1000) == [("pphuman", 0.95)]
    assert union(spark, [person], [(300, 300, 400, 400, 0.2)], 1000, 1000) == [("pphuman", 0.95)]


def naive_tracks(rows, above=0.2, forget=30):
    """The tracker as a plain loop over all frames, empty ones included."""
    live, out, n = {}, [], 0
    by_frame = {}
    for r in rows:
        by_frame.setdefault(r[1], []).append(r)
    for f in range(min(by_frame), max(by_frame) + 1):
        dets = []
        for r in sorted(by_frame.get(f, []), key=lambda r: r[2]):
            n += 1
            dets.append((r[2], n, r[3:7]))
        active = set(live)
        chosen = []
        for _, no, b in dets:
            best, tid = 0.0, None
            for t, s in live.items():
                o = iou(s[0], b)
                if o > best:
                    best, tid = o, t
            chosen.append(tid if best > above else no)
        used = set()
        for (det, _, b), tid in zip(dets, chosen):
            if tid in active and tid in used:
                continue
            age = live[tid][2] + 1 if tid in live else 1
            live[tid] = (b, f, age)
            used.add(tid)
            out.append((det, tid, age, age >= 3))
        for t in list(live):
            if t not in used and f - live[t][1] > forget:
                del live[t]
    return out


def walk(seed, people=6, frames=160):
    rnd = random.Random(seed)
    rows, det = [], 0
    for p in range(people):
        x, y, f = rnd.randrange(0, 500), rnd.randrange(0, 300), rnd.randrange(0, 40)
        while f < frames:
            rows.append(("C", f, det, float(x), float(y), float(x + 60), float(y + 120), f * 200))
            det += 1
            f += rnd.choice([1, 1, 1, 2, 5, 31, 32, 33, 40])
            x, y = x + rnd.randrange(-15, 16), y + rnd.randrange(-15, 16)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_track_boxes(spark, seed):
    rows = walk(seed)
    df = spark.createDataFrame(rows, "camera_id string, frame_no bigint, det_id bigint, x1 double, y1 double, x2 double, y2 double, ts_ms bigint")
    got = sorted((r.det_id, r.track_id, r.age, r.confirmed) for r in detections.track_boxes(df).collect())
    assert got == sorted(naive_tracks(rows))


BOXES = "camera_id string, frame_no bigint, det_id bigint, x1 double, y1 double, x2 double, y2 double, ts_ms bigint"


def busy(seed, people=5, frames=600, grid=1):
    """A camera that never pauses; on a coarse grid, equal overlaps and crossings are usual."""
    rnd = random.Random(seed)
    at = [[rnd.randrange(40), rnd.randrange(20)] for _ in range(people)]
    rows = []
    for f in range(frames):
        for p in at:
            p[0], p[1] = p[0] + rnd.randrange(-2, 3), p[1] + rnd.randrange(-1, 2)
            if rnd.random() < 0.85:
                x, y = float(p[0] * 10 * grid), float(p[1] * 10 * grid)
                rows.append(("C", f, len(rows), x, y, x + 60, y + 120, f * 200))
    return rows


@pytest.mark.parametrize("seed,grid,chunking", [(1, 1, (40, 8)), (2, 1, (40, 0)), (3, 2, (64, 64)), (4, 3, (33, 70)), (5, 0.7, (100, 40))])
def test_chunks_of_one_endless_camera(spark, seed, grid, chunking):
    rows = busy(seed, grid=grid)
    df = spark.createDataFrame(rows, BOXES).repartition(3)
    trace = []
    out = detections.track_boxes(df, frames=chunking[0], warm_up=chunking[1], trace=trace)
    assert sorted((r.det_id, r.track_id, r.age, r.confirmed) for r in out.collect()) == sorted(naive_tracks(rows))
    assert trace[0] == -(-600 // chunking[0])


def test_a_long_warm_up_leaves_little_to_repeat(spark):
    rows = [r for r in busy(6, people=2, frames=2000, grid=8)]
    trace = []
    out = detections.track_boxes(spark.createDataFrame(rows, BOXES), frames=100, warm_up=80, trace=trace)
    assert sorted((r.det_id, r.track_id, r.age, r.confirmed) for r in out.collect()) == sorted(naive_tracks(rows))
    assert trace[0] == 20 and sum(trace[1:]) <= 10


def test_chunks_of_many_cameras(spark):
    rows = walk(7, frames=300)
    more = [(c, f + shift, *r) for c, shift in (("A", 0), ("B", 17), ("D", -50)) for _, f, *r in rows]
    out = detections.track_boxes(spark.createDataFrame(more, BOXES), frames=50, warm_up=10).collect()
    want = sorted(naive_tracks(rows))
    for camera in "ABD":
        assert sorted((r.det_id, r.track_id, r.age, r.confirmed) for r in out if r.camera_id == camera) == want
    with pytest.raises(ValueError):
        detections.track_boxes(spark.createDataFrame(rows, BOXES), frames=20)


def test_a_track_takes_its_first_claim():
    from mcid.operators.tracker import Tracker

    t = Tracker(confirm_at=2)
    a, b = (0.0, 0.0, 10.0, 10.0), (50.0, 50.0, 60.0, 60.0)
    assert t.frame(1, [(1, 1, a), (2, 2, b)]) == [(1, 1, 1, False), (2, 2, 1, False)]
    # 4 claims the track that 3 has taken; 5 overlaps nothing
    assert t.frame(2, [(3, 3, a), (4, 4, (1.0, 0.0, 11.0, 10.0)), (5, 5, (90.0, 0.0, 99.0, 9.0))]) == [(3, 1, 2, True), (5, 5, 1, False)]
    assert t.live["track"].tolist() == [1, 2, 5]
    # 31 frames later 2 is gone before the claims, and 5 after them
    assert t.frame(33, [(6, 6, a)]) == [(6, 1, 3, True)] and t.live["track"].tolist() == [1]
    assert t.frame(64, []) == [] and not len(t.live)


@pytest.mark.parametrize("limit", [0, 512])
def test_equal_scores_keep_the_primary_box(spark, limit):
    rows = [
        ("C", 1, 7, 0.0, 0.0, 10.0, 10.0, 0.9, "sahi"), ("C", 1, 7, 1.0, 0.0, 11.0, 10.0, 0.9, "pphuman"),
        ("C", 1, 3, 0.0, 1.0, 10.0, 11.0, 0.9, "sahi"), ("C", 2, 1, 0.0, 0.0, 10.0, 10.0, 0.5, "sahi"),
        ("C", 2, 1, 0.5, 0.0, 10.0, 10.0, 0.5, "sahi"), ("C", 2, 2, 40.0, 0.0, 50.0, 10.0, 0.5, "pphuman"),
    ]
    df = spark.createDataFrame(rows, "camera_id string, frame_no bigint, box_id bigint, x1 double, y1 double, x2 double, y2 double, score double, source string")
    got = detections.suppress(df, ["camera_id", "frame_no"], array_limit=limit)
    assert sorted((r.frame_no, r.box_id, r.x1, r.source) for r in got.collect()) == [(1, 7, 1.0, "merged"), (2, 1, 0.0, "sahi"), (2, 2, 40.0, "pphuman")]


def test_sessions_split_at_the_gap(spark):
    rows = [("C", 1, i, t, "Z", 0.0, 0.0, 1.0, 1.0) for i, t in enumerate([0, 999, 1998, 2998, 4500])]
    df = spark.createDataFrame(rows, "camera_id string, local_track_id bigint, det_id bigint, ts_ms bigint, zone_id string, x1 double, y1 double, x2 double, y2 double")
    got = tracklets.build(df, gap_ms=1000, min_detections=1)
    # a pause of exactly the gap starts a new tracklet
    assert sorted((r.start_ms, r.end_ms, r.frame_count) for r in got.collect()) == [(0, 1998, 3), (2998, 2998, 1), (4500, 4500, 1)]


def test_first_boxes_are_bounded_and_in_order(spark):
    rows = [("C", 1, i, i * 10, "Z", float(i), 0.0, 1.0, 1.0) for i in range(400)]
    df = spark.createDataFrame(rows, "camera_id string, local_track_id bigint, det_id bigint, ts_ms bigint, zone_id string, x1 double, y1 double, x2 double, y2 double")
    got = tracklets.build(df, gap_ms=50, min_detections=1, max_crops=15).collect()
    assert len(got) == 1 and [b[0] for b in got[0].frame_bboxes] == [float(i) for i in range(15)]


def test_short_tracks_are_dropped(spark):
    rows = [("C", 1, i, i * 100, "Z", 0.0, 0.0, 1.0, 1.0) for i in range(5)]
    cols = "camera_id string, local_track_id bigint, det_id bigint, ts_ms bigint, zone_id string, x1 double, y1 double, x2 double, y2 double"
    df = spark.createDataFrame(rows, cols)
    assert tracklets.build(df, min_detections=6).count() == 0
    with_vector = df.withColumn("embedding", F.array(F.lit(1.0).cast("float")))
    assert tracklets.build(with_vector, min_detections=6).count() == 1


def test_crops_without_scores(spark):
    cols = "camera_id string, local_track_id bigint, det_id bigint, ts_ms bigint, zone_id string, x1 double, y1 double, x2 double, y2 double, crop_uri string, quality double"
    rows = [("C", t, t * 100 + k, 1000 + k * 40_000 * (t == 3) + k, None, 1.0, 2.0, 3.0, 4.0, f"u{t}{k}", q(k)) for t, q in ((1, lambda k: None), (2, lambda k: [0.0, None, 0.4, 0.2, None, 0.4][k]), (4, lambda k: 0.0)) for k in range(6)]
    built = tracklets.build(spark.createDataFrame(rows, cols), min_detections=99, min_crops=5)
    got = {r.local_track_id: (r.best_crop_uri, r.quality_score, r.embedding_count, r.n_embeddings) for r in built.collect()}
    # 4 has no crop that counts
    assert got == {1: ("u10", 0.0, 0, 0), 2: ("u22", 0.4, 0, 0)}
