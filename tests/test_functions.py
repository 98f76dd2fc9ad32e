import math
import uuid

import pytest
from pyspark.sql import functions as F

from mcid.functions import boxes, names, polygons, scoring, times, vectors


def box(*v):
    return boxes.Box(*(F.lit(float(x)) for x in v))


def test_iou(one):
    got = one(
        same=boxes.iou(box(0, 0, 10, 10), box(0, 0, 10, 10)),
        apart=boxes.iou(box(0, 0, 10, 10), box(20, 20, 30, 30)),
        half=boxes.iou(box(0, 0, 10, 10), box(0, 5, 10, 15)),
        empty=boxes.iou(box(0, 0, 0, 0), box(0, 0, 0, 0)),
    )
    assert got == {"same": 1.0, "apart": 0.0, "half": pytest.approx(1 / 3), "empty": 0.0}


def test_geometry(one):
    cx, cy = boxes.centroid(box(0, 0, 10, 20))
    got = one(cx=cx, cy=cy, h=boxes.height(box(0, 30, 5, 10)), a=boxes.area(box(0, 0, 4, 5)))
    assert got == {"cx": 5.0, "cy": 10.0, "h": 0.0, "a": 20.0}


def test_crop_quality(one):
    def q(b, lv, br):
        return boxes.crop_quality(b, F.lit(float(lv)), F.lit(float(br)), F.lit(1920), F.lit(1080))

    good = box(100, 100, 200, 340)
    got = one(
        best=q(good, 200, 128),
        small=q(box(100, 100, 150, 150), 200, 128),
        blurry=q(good, 40, 128),
        dark=q(good, 200, 20),
        cut=q(box(0, 100, 200, 340), 200, 128),
    )
    assert got == {"best": pytest.approx(1.0), "small": 0.0, "blurry": 0.0, "dark": 0.0, "cut": 0.0}


def test_tiles(one):
    got = one(
        many=boxes.tile_starts(F.lit(1300), F.lit(512), F.lit(0.25)),
        one=boxes.tile_starts(F.lit(500), F.lit(512), F.lit(0.25)),
        flush=boxes.tile_starts(F.lit(896), F.lit(512), F.lit(0.25)),
    )
    assert got == {"many": [0, 384, 768, 788], "one": [0], "flush": [0, 384]}


def test_polygons(one):
    square = polygons.parse(F.lit("[[0,0],[10,0],[10,10],[0,10]]"))
    got = one(
        inside=polygons.contains(square, F.lit(5.0), F.lit(5.0)),
        outside=polygons.contains(square, F.lit(15.0), F.lit(5.0)),
        line=polygons.contains(polygons.parse(F.lit("[[0,0],[10,0]]")), F.lit(5.0), F.lit(0.0)),
        bad=polygons.parse(F.lit("[[0,0],[1")),
        scaled=polygons.scale(polygons.parse(F.lit("[[0.5,0.25]]")), F.lit(5.0), F.lit(10.0)),
    )
    # halves round to even: 2.5 gives 2
    assert got == {"inside": True, "outside": False, "line": False, "bad": None, "scaled": [[2.0, 2.0]]}


def test_strict_polygon_stops(spark):
    with pytest.raises(Exception, match="invalid polygon"):
        spark.range(1).select(polygons.parse_strict(F.lit("nope"), F.lit("Z1"))).collect()


def test_scores(one):
    parts = scoring.breakdown(
        F.lit(0.9), F.lit(0.0), F.lit(True), F.lit(None).cast("double"), F.lit(None).cast("string"), F.lit("Z")
    )
    got = one(**parts)
    assert got["quality_score"] == 0.5 and got["zone_score"] == 0.5 and got["camera_topology_score"] == 1.0
    assert got["final_score"] == pytest.approx(0.55 * 0.9 + 0.2 + 0.15 + 0.025 + 0.025)
    late = one(t=scoring.temporal(F.lit(150.0)), none=scoring.temporal(F.lit(1.0), 0))
    assert late == {"t": pytest.approx(math.exp(-(150**2) / 7200)), "none": 0.0}


def test_weights_keep_their_ratio():
    w = scoring.Weights(2, 2, 2, 2, 2).normalized()
    assert w.reid == pytest.approx(0.2)
    assert scoring.Weights(0, 0, 0, 0, 0).normalized() == scoring.Weights(0, 0, 0, 0, 0)


@pytest.mark.parametrize(
    "top1, top2, link, final, expected",
    [
        (None, None, None, 0.0, "new"),
        (0.99, None, False, 0.99, "new"),
        (0.95, 0.80, None, 0.50, "match"),
        (0.97, 0.95, True, 0.90, "ambiguous"),
        (0.90, 0.70, True, 0.85, "match"),
        (0.90, 0.70, True, 0.75, "candidate"),
        (0.90, 0.89, True, 0.75, "ambiguous"),
        (0.90, 0.70, True, 0.60, "new"),
    ],
)
def test_policy(one, top1, top2, link, final, expected):
    def d(v):
        return F.lit(v).cast("double")

    args = d(top1), d(top2), F.lit(link).cast("boolean"), F.lit(final)
    held = scoring.Policy(new_id_when_ambiguous=False)
    got = one(a=scoring.decide(*args), b=scoring.decide(*args, held))
    assert got["a"] == expected
    assert got["b"] == ("held" if expected == "ambiguous" else expected)


def test_point_id_is_a_name_uuid(one):
    got = one(id=vectors.point_id(F.lit("m"), F.lit("t1"), F.lit(3)))["id"]
    assert got == str(uuid.uuid5(uuid.NAMESPACE_URL, "m:t1:03"))


def test_vectors(one):
    v = F.array(F.lit(3.0), F.lit(4.0))
    zero = F.array(F.lit(0.0), F.lit(0.0))
    got = one(u=vectors.unit(v), z=vectors.unit(zero), c=vectors.cosine(v, v), n=vectors.cosine(v, zero))
    assert got == {"u": [pytest.approx(0.6), pytest.approx(0.8)], "z": [0.0, 0.0], "c": pytest.approx(1.0), "n": 0.0}


def test_names(one):
    got = one(
        a=names.camera_id(F.lit("cam1_merged")),
        b=names.camera_id(F.lit("CAM_02")),
        c=names.camera_id(F.lit("lobby")),
        s=names.zone_slug(F.lit("Toys & Games Zone")),
        e=names.zone_slug(F.lit(" !! ")),
        k=names.zone_key(F.lit("Toys & Games Zone")),
        t=names.topic_name(F.lit("a/b"), F.lit("CAM_02"), F.lit("telemetry"), F.lit("cam_2")),
        x=names.topic_name(F.lit("a/b"), F.lit("CAM_02"), F.lit("nothing"), F.lit("cam_2")),
    )
    assert got == {
        "a": "CAM_01", "b": "CAM_02", "c": "LOBBY", "s": "toys-and-games-zone", "e": "unknown-zone",
        "k": "Toys&GamesZone", "t": "a/b/cam2/summary", "x": None,
    }


def test_times(one):
    got = one(
        s=times.to_unix_ms(F.lit(1_700_000_000.5)),
        m=times.to_unix_ms(F.lit(1_700_000_000_500)),
        age=times.age_seconds(F.lit(10), F.lit(5)),
        day=times.session_id(F.lit(1_704_067_200_000)),
    )
    assert got == {"s": 1_700_000_000_500, "m": 1_700_000_000_500, "age": 0.0, "day": "S-2024-01-01"}
