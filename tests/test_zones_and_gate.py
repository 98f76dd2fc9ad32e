from pyspark.sql import functions as F

from mcid.operators import dwell, evaluation, telemetry

EVENTS = "global_id string, zone_id string, camera_id string, event_type string, ts_ms bigint, event_id bigint"


def stays(spark, *events):
    rows = [("G", "Z", "C", kind, t * 1000, i) for i, (kind, t) in enumerate(events)]
    return dwell.sessions(spark.createDataFrame(rows, EVENTS))


def test_dwell_goldens(spark):
    assert [r.duration_seconds for r in stays(spark, ("enter", 100), ("exit", 160)).collect()] == [60]
    again = stays(spark, ("enter", 100), ("enter", 130), ("exit", 160)).collect()
    assert [(r.entered_ms, r.duration_seconds) for r in again] == [(100_000, 60)]
    assert stays(spark, ("exit", 160)).count() == 0
    swept = dwell.force_close(stays(spark, ("enter", 0)), F.lit(20_000), max_open_seconds=10).first()
    assert (swept.status, swept.duration_seconds) == ("closed", 20)
    kept = dwell.force_close(stays(spark, ("enter", 0)), F.lit(10_000), max_open_seconds=10).first()
    assert kept.status == "open"


def test_transitions(spark):
    rows = [("G", "C", z, t, t) for t, z in enumerate([None, "A", "A", "B", None, None, "A"])]
    df = spark.createDataFrame(rows, "global_id string, camera_id string, zone_id string, ts_ms bigint, det_id bigint")
    got = sorted((r.ts_ms, r.event_type, r.zone_id) for r in dwell.transitions(df).collect())
    assert got == [(1, "enter", "A"), (3, "enter", "B"), (3, "exit", "A"), (4, "exit", "B"), (6, "enter", "A")]


def test_deltas(spark):
    rows = [("k", 1, 3, 0), ("k", 2, 3, 0), ("k", 3, 8, 0), ("k", 4, 8, 1)]
    df = spark.createDataFrame(rows, "key string, at bigint, total bigint, epoch bigint")
    got = sorted((r["at"], r.delta) for r in dwell.delta_counters(df, ["key"], "at", "total", "epoch").collect())
    assert got == [(1, 3), (3, 5), (4, 8)]


def test_empty_ranks(spark):
    none = dwell.with_validity(stays(spark, ("exit", 1)), F.lit(0))
    assert set(dwell.zone_ranks(none, F.lit(0)).first()) == {"N/A"}


def gate(spark, metrics, mode="smoke"):
    rows = [("r", m, k, n, v) for m, k, n, v in metrics]
    df = spark.createDataFrame(rows, "report_id string, metric string, key string, nested int, value double")
    reports = spark.createDataFrame([("r", mode)], "report_id string, mode string")
    return evaluation.gate_check(df, reports).first()


def test_gate(spark):
    assert gate(spark, [("false_merge_rate", "", 0, 0.01)]).passed
    bad = gate(spark, [("false_merge_rate", "", 0, 0.06), ("per_camera_analytics_fps", "CAM_01", 0, 4.0)])
    assert bad.failures == "false_merge_rate=0.0600 > threshold=0.0500; fps[CAM_01]=4.00 < threshold=5.00"
    # the top level hides the nested value, and missing values pass outside production
    assert gate(spark, [("false_merge_rate", "", 0, 0.01), ("false_merge_rate", "", 1, 0.9)]).passed
    missing = gate(spark, [("false_merge_rate", "", 1, 0.01)], "production_benchmark")
    assert missing.failures == "missing required metrics: cross_camera_match_accuracy, id_fragmentation_rate"


def test_fps_and_status(spark):
    rows = [("C", i * 100, i, True) for i in range(11)]
    ticks = spark.createDataFrame(rows, "camera_id string, ts_ms bigint, event_id bigint, ok boolean")
    assert telemetry.fps_report(ticks).first().fps == 10.0
    assert telemetry.rolling_fps(ticks).orderBy("ts_ms").collect()[-1].fps == 10.0
    down = spark.createDataFrame(
        [("C", t * 1000, t, ok) for t, ok in ((0, True), (1, False), (10, False), (11, False), (61, False), (62, True), (63, False))],
        "camera_id string, ts_ms bigint, event_id bigint, ok boolean",
    )
    got = [r.status for r in telemetry.camera_status(down).orderBy("ts_ms").collect()]
    assert got == [2, 2, 2, 1, 0, 2, 2]


def test_registry_percentiles(spark):
    df = spark.createDataFrame([("C", i, float(i)) for i in range(300)], "camera_id string, ts_ms bigint, v double")
    r = telemetry.recent_percentiles(df, ["camera_id"], ["ts_ms"], "v").first()
    assert (r.p50, r.p95, r.p99, r.samples) == (44 + 127.0, 44 + 243.0, 44 + 253.0, 256)
