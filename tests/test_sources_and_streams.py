import json
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from mcid.operators import candidates, detections
from mcid.sources import readers, writers
from mcid.streaming import processors, run

SF = "/root/testdata/sf0.001"


def test_detection_defaults(spark):
    lines = [
        '{"camera_id":"cam2_merged","frame_id":"7","local_track_id":3}',
        '{"camera_id":"CAM_01","frame_id":1,"local_track_id":3,"bbox":[1,2,3]}',
        '{"camera_id":"CAM_01","frame_id":"x","local_track_id":3,"bbox":[1,2,3,4]}',
        '{"frame_id":1,"local_track_id":3}',
        "not json",
    ]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    good, bad = readers.parse_detections(df, now_ms=F.lit(5))
    row = good.first()
    assert (row.camera_id, row.event_id, row.source, row.timestamp_ms, row.bbox) == ("CAM_02", "det_CAM_02_7_3", "pphuman", 5, [0.0] * 4)
    assert sorted(r.reason for r in bad.collect()) == ["bad_json", "bad_number", "missing_field", "short_bbox"]


def test_files(spark, tmp_path):
    (tmp_path / "cameras.json").write_text('{"camera_id":"A","rtsp_url_env_key":"K","width":10,"height":5}\n{"camera_id":"B"}\n')
    (tmp_path / "zones.json").write_text('{"zone_id":"Z","camera_id":"A","polygon_json":"[[0,0],[1,0],[1,1]]"}\n')
    (tmp_path / "camera_links.json").write_text('{"from_camera_id":"A","to_camera_id":"B"}\n')
    cams, zones, links = readers.load_dimensions(spark, str(tmp_path))
    assert [(c.camera_id, c.name, c.fps_target, c.is_active) for c in cams.collect()] == [("A", "A", 25, True)]
    assert zones.first().zone_type == "floor" and links.first().enabled
    (tmp_path / "mot.txt").write_text("1,2,10,20,30,40,0.5,-1,-1,-1\nbad\n1,2,3\n")
    got = readers.read_mot(spark, str(tmp_path / "mot.txt")).collect()
    assert [(r.frame_id, r.x2, r.y2) for r in got] == [(1, 40.0, 60.0)]
    doc = {"dataset_name": "d", "fps": 10, "global_persons": [{"global_person_id": "P1", "segments": [{"camera_id": "A", "start_frame": 1, "end_frame": 2, "start_time": 0.1, "end_time": 0.2, "quality_flag": "ok"}]}]}
    (tmp_path / "labels.json").write_text(json.dumps(doc, indent=1))
    assert readers.read_label_segments(spark, str(tmp_path / "labels.json")).first().global_person_id == "P1"


def test_dry_retention_changes_nothing(spark):
    ids = spark.createDataFrame([("G", "active", 0)], "global_id string, status string, last_seen_ms bigint")
    facts = spark.createDataFrame([(0,)], "ts_ms bigint")
    objects = facts.withColumnRenamed("ts_ms", "modified_ms")
    now = F.lit(30 * 86_400_000)
    kept, summary = writers.retention(ids, facts, facts, objects, now, dry_run=True)
    assert kept["identities"].first().status == "active" and kept["events"].count() == 1
    assert summary.first().identities_expired == 1
    kept, _ = writers.retention(ids, facts, facts, objects, now)
    assert kept["identities"].first().status == "expired" and kept["events"].count() == 0


def test_constrained_column(spark):
    df = spark.createDataFrame([("match",), ("oops",), (None,)], "decision_type string")
    good, bad = writers.constrain(df, "decision_type", ["match", "new"])
    assert good.count() == 1 and bad.count() == 2


# ---- event order ---------------------------------------------------------------------------
def arrivals(spark, path, rows, schema, files, late_ms, seed):
    """Rows over several files, each up to ``late_ms`` after rows of later times; then one far row that moves the watermark."""
    rnd = random.Random(seed)
    at = schema.split(", ").index("ts_ms bigint")
    arriving = sorted(rows, key=lambda r: r[at] + rnd.random() * late_ms)
    size = -(-len(arriving) // files)
    for k in range(0, len(arriving), size):
        spark.createDataFrame(arriving[k : k + size], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


DET = "det_id bigint, camera_id string, local_track_id bigint, frame_no bigint, ts_ms bigint, x1 double, y1 double, x2 double, y2 double"


def seen_boxes(seed, n=400):
    rnd = random.Random(seed)
    rows, frame = [], 1000  # rows at time 0 would be late from the start
    for k in range(n):
        frame += rnd.choice([0, 0, 1, 1, 2, 40])
        x = float(rnd.randrange(4) * 40 + rnd.randrange(20))
        rows.append((k, rnd.choice(["A", "B"]), rnd.randrange(4), frame, frame * 200 + k % 3, x, 10.0, x + 60, 150.0))
    return rows


@pytest.mark.parametrize("files,late_ms", [(1, 0), (5, 4000), (9, 9000)])
def test_thinning_and_tracking_do_not_depend_on_arrival(spark, tmp_path, files, late_ms):
    rows = seen_boxes(files)
    batch = spark.createDataFrame(rows, DET)
    end = max(r[4] for r in rows) - 10_000
    live = arrivals(spark, str(tmp_path / "in"), rows, DET, files, late_ms, files)
    got = sorted(map(tuple, run.to_table(processors.thinned(live, 2.0), "thin")[0].collect()))
    assert got == sorted(map(tuple, detections.thin_rate(batch, 2.0).where(f"ts_ms <= {end}").collect())) and len(got) > 50
    # boxes of a frame come in different files
    got = sorted(map(tuple, run.to_table(processors.tracked(live), "tracks")[0].collect()))
    assert got == sorted(map(tuple, detections.track_boxes(batch).where(f"(frame_no + 1) * 200 - 1 <= {end}").collect())) and len(got) > 200


@pytest.mark.parametrize("files,late_ms", [(1, 0), (6, 500_000)])
def test_bindings_do_not_depend_on_arrival(spark, tmp_path, files, late_ms):
    rnd = random.Random(files)
    det = [(k, rnd.choice("AB"), rnd.randrange(5), None, 1_000_000 + k * 7000 + rnd.randrange(5000)) for k in range(400)]
    named = [(-1, rnd.choice("AB"), rnd.randrange(5), f"G{k}", 1_000_000 + k * 60_000) for k in range(48)]
    schema = "det_id bigint, camera_id string, local_track_id bigint, global_id string, ts_ms bigint"
    live = arrivals(spark, str(tmp_path / "in"), det + named, schema, files, late_ms, files)
    out = run.to_table(processors.bindings(live.where("det_id >= 0"), live.where("det_id < 0")), "bindings")[0]
    both = spark.createDataFrame(det + named, schema)
    want = candidates.bind_identity(both.where("det_id >= 0").drop("global_id"), both.where("det_id < 0").drop("det_id"))
    end = max(r[4] for r in det + named) - 600_000
    pairs = sorted(((r.det_id, r.global_id or "") for r in out.collect()))
    assert pairs == sorted((r.det_id, r.global_id or "") for r in want.where(f"ts_ms <= {end}").collect())
    assert len(pairs) > 250 and sum(g != "" for _, g in pairs) > 150


@pytest.mark.parametrize("files,late_ms", [(1, 0), (7, 3_000_000)])
def test_stays_do_not_depend_on_arrival(spark, tmp_path, files, late_ms):
    rnd = random.Random(3)
    rows = [(k, f"G{rnd.randrange(6)}", f"Z{rnd.randrange(2)}", "C", rnd.choice(["enter", "exit"]), 1_000_000 + k * 900_000 + rnd.randrange(900_000)) for k in range(500)]
    cols = "event_id bigint, global_id string, zone_id string, camera_id string, event_type string, ts_ms bigint"
    limit, end = 8 * 3600, max(r[5] for r in rows) - 3_600_000
    want, inside = [], {}
    for _, person, zone, _, kind, at in sorted(rows, key=lambda r: r[5]):
        if at > end:
            break
        key = (person, zone)
        if key in inside and at >= inside[key] + limit * 1000:
            want.append((*key, inside[key], inside.pop(key) + limit * 1000))
        if kind == "enter":
            inside.setdefault(key, at)
        elif key in inside:
            want.append((*key, inside.pop(key), at))
    want += [(*key, at, at + limit * 1000) for key, at in inside.items() if at + limit * 1000 <= end]
    live = arrivals(spark, str(tmp_path / "in"), rows, cols, files, late_ms, files)
    out = run.to_table(processors.stays(live, max_open_seconds=limit), "stays")[0]
    assert sorted((r.global_id, r.zone_id, r.entered_ms, r.exited_ms) for r in out.collect()) == sorted(want)
    assert sum(b - a == limit * 1000 for *_, a, b in want) > 3


def test_stays_over_several_batches(spark, tmp_path):
    """State carries over batches, and the timer closes what nobody left."""
    cols = "event_id bigint, global_id string, zone_id string, camera_id string, event_type string, ts_ms bigint"
    batches = [
        [(1, "G", "Z", "C", "enter", 5000), (2, "H", "Z", "C", "enter", 6000)],
        [(3, "G", "Z", "C", "enter", 20_000), (4, "G", "Z", "C", "exit", 65_000)],
        [(5, "X", "Z", "C", "exit", 90_000_000)],
        [(6, "X", "Z", "C", "exit", 95_000_000)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, cols).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(cols).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out, _ = run.to_table(processors.stays(live, "1 second"), "stays")
    got = sorted((r.global_id, r.entered_ms, r.duration_seconds) for r in out.collect())
    assert got == [("G", 5000, 60), ("H", 6000, 86_400)]


def test_stream_resolve_covers_all(spark):
    out = entry.queries()["stream_resolve"](spark, SF)
    assert out.count() == 1000 and out.select("tracklet_id").distinct().count() == 1000


def test_streams_read_a_table_that_is_a_folder(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    got = entry.queries()["stream_dedup"](spark, str(tmp_path))
    assert got.count() == events.count() > 0
    assert entry.queries()["stream_lag"](spark, str(tmp_path)).agg(F.sum("input_rows")).first()[0] == events.count()


def test_waiting_rows_send_no_frames():
    """Each frame travels as a batch, so a key with nothing to say sends none."""
    from unittest.mock import MagicMock

    import pandas as pd

    from mcid.streaming.processors import Stays

    stays = Stays(1000)
    stays.init(MagicMock())
    stays.timer.exists.return_value = False
    rows = pd.DataFrame({"at_ms": [5], "event_id": [1], "camera_id": ["CAM_01"], "event_type": ["enter"]})
    assert list(stays.handleInputRows(("G1", "Z1"), iter([rows]), None)) == []
    stays.waiting.appendList.assert_called_once_with([(5, 1, "CAM_01", "enter")])
    stays.handle.registerTimer.assert_called_once_with(5)


class Cell:
    """A keyed state in memory that counts its calls."""

    def __init__(self, calls):
        self.held, self.calls = {}, calls

    def __getattr__(self, name):
        known = {
            "exists": lambda: None in self.held, "get": lambda: self.held[None], "update": lambda v: self.held.update({None: v}),
            "keys": lambda: list(self.held), "getValue": lambda k: self.held[k], "updateValue": lambda k, v: self.held.update({k: v}),
            "removeKey": lambda k: self.held.pop(k), "iterator": lambda: list(self.held.items()), "clear": self.held.clear,
        }
        self.calls.append(name)
        return known[name]


@pytest.mark.parametrize("kind", ["thin", "tracks", "bindings"])
def test_rows_of_a_busy_key_wait_in_blocks(monkeypatch, kind):
    """A few calls to the state, whatever the number of rows; spans of time are applied one by one."""
    from unittest.mock import MagicMock

    import pandas as pd

    monkeypatch.setattr(processors, "BUCKET_MS", 60_000)
    calls, n, applied = [], 6000, []
    handle = MagicMock()
    handle.getMapState.side_effect = handle.getValueState.side_effect = lambda *a: Cell(calls)
    rnd = random.Random(kind)
    at = [1000 + k * 50 + rnd.randrange(3000) for k in range(n)]
    frames = pd.DataFrame({"at_ms": at, "det_id": range(n)})
    if kind == "thin":
        one, key = processors.Thin(500), ("A",)
    elif kind == "tracks":
        one, key = processors.Tracks({}), ("A",)
        frames = frames.assign(frame_no=frames.at_ms // 200, x1=[rnd.randrange(60) * 1.0 for _ in at], y1=0.0).assign(at_ms=lambda f: f.frame_no * 200 + 199, x2=lambda f: f.x1 + 20, y2=9.0)
    else:
        one, key = processors.Bindings(10_000, 10**9), ("A", 0)
        frames = frames.assign(kind=frames.det_id % 2, local_track_id=frames.det_id % 5, global_id=[f"G{k}" if k % 2 == 0 else None for k in range(n)])
    one.init(handle)
    inner = one.apply
    one.apply = lambda key, rows, watermark: applied.append(rows.num_rows) or inner(key, rows, watermark)
    for part in (frames[:4000], frames[4000:]):
        list(one.handleInputRows(key, iter([part[:1000], part[1000:]]), None))
    # twice, so that a state is kept between
    got = []
    for mark in (150_000, 10**9):
        got += list(one.handleExpiredTimer(key, MagicMock(getCurrentWatermarkInMs=lambda mark=mark: mark), None))
    got = pd.concat(got)
    assert len(applied) > 5 and max(applied) < n / 3 and len(calls) < n / 10
    if kind == "thin":
        want, last = [], None
        for t in sorted(at):
            if last is None or t - last >= 500:
                want.append(t)
                last = t
        assert got.ts_ms.tolist() == want
    elif kind == "tracks":
        from mcid.operators.tracker import Tracker

        tracker, want, seen = Tracker(), [], 0
        for frame, boxes in frames.sort_values(["frame_no", "det_id"]).groupby("frame_no"):
            rows = [(r.det_id, seen + i + 1, (r.x1, r.y1, r.x2, r.y2)) for i, r in enumerate(boxes.itertuples())]
            seen += len(rows)
            want += [(frame, *r) for r in tracker.frame(frame, rows)]
        assert list(got[["frame_no", "det_id", "track_id", "age", "confirmed"]].itertuples(index=False, name=None)) == want
    else:
        own, last, want = {}, None, []
        for r in sorted(frames.itertuples(), key=lambda r: (r.at_ms, r.kind, r.global_id or "", r.local_track_id, r.det_id)):
            if r.kind == 0:
                own[r.local_track_id] = last = (r.global_id, r.at_ms)
                continue
            hit = next((h for h in (own.get(r.local_track_id), last) if h and r.at_ms - h[1] <= 10_000), (None,))
            want.append((r.det_id, hit[0]))
        assert list(got[["det_id", "global_id"]].itertuples(index=False, name=None)) == want
