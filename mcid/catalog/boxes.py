"""Boxes, polygons, tiles and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import Views
from ..functions import boxes, polygons, vectors
from ..operators import spatial
from . import query


def framed(v: Views) -> DataFrame:
    """Detections with the size of their own camera's frame."""
    return v.detections.join(v.cameras.select("camera_id", "width", "height"), "camera_id")


FRAMED = "(SELECT det.*, width, height FROM det JOIN cameras USING (camera_id))"


@query("bbox_centroid", "det", "SELECT det_id, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM det")
def bbox_centroid(v: Views) -> DataFrame:
    cx, cy = boxes.centroid(boxes.box())
    return v.detections.select("det_id", cx.alias("cx"), cy.alias("cy"))


@query("bbox_height", "det", "SELECT det_id, greatest(0, y2 - y1) AS height FROM det")
def bbox_height(v: Views) -> DataFrame:
    return v.detections.select("det_id", boxes.height(boxes.box()).alias("height"))


@query("bbox_area", "det", "SELECT det_id, greatest(0, x2 - x1) * greatest(0, y2 - y1) AS area FROM det")
def bbox_area(v: Views) -> DataFrame:
    return v.detections.select("det_id", boxes.area(boxes.box()).alias("area"))


@query(
    "bbox_iou",
    "det aux",
    """
    SELECT det_id, round(CASE WHEN u > 0 THEN i / u ELSE 0 END, 9) AS iou
    FROM (SELECT det_id, i, (d.x2 - d.x1) * (d.y2 - d.y1) + (a.x2 - a.x1) * (a.y2 - a.y1) - i AS u
          FROM (SELECT d.det_id, d, a, greatest(0, least(d.x2, a.x2) - greatest(d.x1, a.x1))
                 * greatest(0, least(d.y2, a.y2) - greatest(d.y1, a.y1)) AS i
                FROM det d JOIN aux a ON d.det_id = a.aux_id))""",
)
def bbox_iou(v: Views) -> DataFrame:
    joined = v.detections.alias("d").join(v.aux.alias("a"), F.expr("d.det_id = a.aux_id"))
    return joined.select("det_id", F.round(boxes.iou(boxes.box("d"), boxes.box("a")), 9).alias("iou"))


@query(
    "bbox_pad",
    "det cameras",
    f"""
    SELECT * FROM (
      SELECT det_id, greatest(0, floor(x1 - (x2 - x1) * 0.1::DOUBLE))::BIGINT AS px1,
             greatest(0, floor(y1 - (y2 - y1) * 0.1::DOUBLE))::BIGINT AS py1,
             least(width, ceil(x2 + (x2 - x1) * 0.1::DOUBLE))::BIGINT AS px2,
             least(height, ceil(y2 + (y2 - y1) * 0.1::DOUBLE))::BIGINT AS py2
      FROM {FRAMED}) WHERE px2 > px1 AND py2 > py1""",
)
def bbox_pad(v: Views) -> DataFrame:
    p = boxes.padded(boxes.box(), F.col("width"), F.col("height"))
    out = framed(v).select("det_id", *[c.alias(f"p{n}") for n, c in zip(p._fields, p)])
    return out.where((F.col("px2") > F.col("px1")) & (F.col("py2") > F.col("py1")))


@query(
    "bbox_clip",
    "det cameras",
    f"""
    SELECT * FROM (
      SELECT det_id, greatest(0, least(round_even(x1 * 0.55::DOUBLE, 0)::BIGINT, width - 1))::BIGINT AS cx1,
             greatest(0, least(round_even(y1 * 1.45::DOUBLE, 0)::BIGINT, height - 1))::BIGINT AS cy1,
             greatest(0, least(round_even(x2 * 0.55::DOUBLE, 0)::BIGINT, width))::BIGINT AS cx2,
             greatest(0, least(round_even(y2 * 1.45::DOUBLE, 0)::BIGINT, height))::BIGINT AS cy2
      FROM {FRAMED}) WHERE cx2 > cx1 AND cy2 > cy1""",
)
def bbox_clip(v: Views) -> DataFrame:
    scaled = boxes.Box(boxes.box().x1 * 0.55, boxes.box().y1 * 1.45, boxes.box().x2 * 0.55, boxes.box().y2 * 1.45)
    c = boxes.clipped(scaled, F.col("width"), F.col("height"))
    out = framed(v).select("det_id", *[e.alias(f"c{n}") for n, e in zip(c._fields, c)])
    return out.where(~boxes.is_empty(boxes.Box(*(F.col(f"c{n}") for n in c._fields))))


@query(
    "cut_by_frame",
    "det cameras",
    f"SELECT det_id, x1 <= 2 OR y1 <= 2 OR x2 >= width - 2 OR y2 >= height - 2 AS cut FROM {FRAMED}",
)
def cut_by_frame(v: Views) -> DataFrame:
    return framed(v).select("det_id", boxes.cut_by_frame(boxes.box(), F.col("width"), F.col("height")).alias("cut"))


def crop_signals(v: Views) -> DataFrame:
    e, i = F.col("event_id"), F.col("frame_id")
    return framed(v).select(
        "*",
        ((e * 7 + i * 13) % 300).cast("double").alias("laplacian_var"),
        ((e * 11 + i * 3) % 256).cast("double").alias("brightness"),
    )


def crop_scores(v: Views) -> DataFrame:
    q = boxes.crop_quality(boxes.box(), F.col("laplacian_var"), F.col("brightness"), F.col("width"), F.col("height"))
    return crop_signals(v).select("*", q.alias("quality"))


CROPS = f"""
    (SELECT *, CASE WHEN y2 - y1 < 60 OR sharp = 0 OR bright = 0 OR x1 <= 2 OR y1 <= 2
                      OR x2 >= width - 2 OR y2 >= height - 2 THEN 0::DOUBLE
               ELSE least(1, tall * 0.4::DOUBLE + sharp * 0.3::DOUBLE + bright * 0.2::DOUBLE + 0.1::DOUBLE) END AS quality
     FROM (SELECT *, least(1, greatest(0, (y2 - y1 - 60) / 180 + 0.5::DOUBLE)) AS tall,
                  least(1, greatest(0, (lv - 50) / 100)) AS sharp,
                  CASE WHEN br < 30 OR br > 235 THEN 0::DOUBLE ELSE 1 - abs(br - 128) / 128 END AS bright
           FROM (SELECT *, ((event_id * 7 + frame_id * 13) % 300)::DOUBLE AS lv,
                        ((event_id * 11 + frame_id * 3) % 256)::DOUBLE AS br FROM {FRAMED})))"""


@query("crop_quality", "det cameras", f"SELECT det_id, round(quality, 9) AS quality FROM {CROPS}")
def crop_quality(v: Views) -> DataFrame:
    return crop_scores(v).select("det_id", F.round("quality", 9).alias("quality"))


@query("quality_ok", "det cameras", f"SELECT det_id FROM {CROPS} WHERE quality >= 0.5")
def quality_ok(v: Views) -> DataFrame:
    return crop_scores(v).where(boxes.quality_ok(F.col("quality"))).select("det_id")


# ---- polygons ---------------------------------------------------------------
def zone_texts(v: Views) -> DataFrame:
    """A polygon text per event; some are cut short."""
    e = F.col("event_id")
    whole = F.format_string("[[%d,%d],[%d,%d],[%d,%d]]", e % 100, e % 50, e % 100 + 300, e % 70, e % 90, e % 60 + 200)
    broken = F.when(e % 10 == 3, F.lit("[[1,2],[3")).when(e % 10 == 7, F.lit("[[1],[2,3],[4,5]]"))
    return v.events.select("event_id", F.coalesce(broken, whole).alias("polygon_json"))


@query(
    "parse_polygon",
    "ev",
    """
    SELECT event_id, event_id % 10 NOT IN (3, 7) AS valid,
           CASE WHEN event_id % 10 NOT IN (3, 7) THEN 3 ELSE 0 END::BIGINT AS corners,
           CASE WHEN event_id % 10 NOT IN (3, 7) THEN (event_id % 100 + 300)::DOUBLE END AS second_x
    FROM ev""",
)
def parse_polygon(v: Views) -> DataFrame:
    p = polygons.parse(F.col("polygon_json"))
    parsed = zone_texts(v).select("event_id", p.alias("p"))
    return parsed.select(
        "event_id",
        F.col("p").isNotNull().alias("valid"),
        F.coalesce(F.array_size("p"), F.lit(0)).cast("bigint").alias("corners"),
        F.expr("p[1][0]").alias("second_x"),
    )


@query(
    "scale_polygon",
    "ev",
    """
    SELECT event_id, round_even((event_id % 100)::DOUBLE * (960::DOUBLE / 3072), 0)::BIGINT AS x,
           round_even((event_id % 50)::DOUBLE * (540::DOUBLE / 2048), 0)::BIGINT AS y
    FROM ev WHERE event_id % 10 NOT IN (3, 7)""",
)
def scale_polygon(v: Views) -> DataFrame:
    p = polygons.scale(polygons.parse(F.col("polygon_json")), F.lit(960.0 / 3072.0), F.lit(540.0 / 2048.0))
    return (
        zone_texts(v)
        .select("event_id", p.alias("p"))
        .where("p IS NOT NULL")
        .select("event_id", F.expr("cast(p[0][0] as bigint)").alias("x"), F.expr("cast(p[0][1] as bigint)").alias("y"))
    )


CONTAINS = """
    list_sum(list_transform(range(len(p)), lambda i:
      CASE WHEN (p[i + 1][2] > py) <> (p[(i + len(p) - 1) % len(p) + 1][2] > py)
            AND px < (p[(i + len(p) - 1) % len(p) + 1][1] - p[i + 1][1]) * (py - p[i + 1][2])
                / CASE WHEN p[(i + len(p) - 1) % len(p) + 1][2] = p[i + 1][2] THEN 1e-12
                       ELSE p[(i + len(p) - 1) % len(p) + 1][2] - p[i + 1][2] END + p[i + 1][1]
           THEN 1 ELSE 0 END)) % 2 = 1"""


@query(
    "point_in_polygon",
    "ev",
    f"""
    SELECT event_id, {CONTAINS} AS inside
    FROM (SELECT event_id, (event_id * 13 % 400)::DOUBLE AS px, (event_id * 29 % 250)::DOUBLE AS py,
                 [[event_id % 100, event_id % 50], [event_id % 100 + 300, event_id % 70],
                  [event_id % 90, event_id % 60 + 200]]::DOUBLE[][] AS p
          FROM ev WHERE event_id % 10 NOT IN (3, 7))""",
)
def point_in_polygon(v: Views) -> DataFrame:
    e = F.col("event_id")
    parsed = zone_texts(v).select("event_id", polygons.parse(F.col("polygon_json")).alias("p")).where("p IS NOT NULL")
    inside = polygons.contains(F.col("p"), (e * 13 % 400).cast("double"), (e * 29 % 250).cast("double"))
    return parsed.select("event_id", inside.alias("inside"))


# ---- tiles --------------------------------------------------------------------
TILE_SQL = """
    WITH sides AS (
      SELECT event_id, 400 + event_id % 1700 AS w, 300 + (event_id * 3) % 900 AS h, 512 AS patch,
             greatest(1, round_even(512 * (1 - (event_id % 5)::DOUBLE / 10), 0)::BIGINT) AS step FROM ev),
    xs AS (SELECT DISTINCT event_id, s AS x0 FROM (
        SELECT event_id, unnest(CASE WHEN w <= patch THEN [0] ELSE list_append(range(0, w - patch + 1, step), w - patch) END) AS s FROM sides)),
    ys AS (SELECT DISTINCT event_id, s AS y0 FROM (
        SELECT event_id, unnest(CASE WHEN h <= patch THEN [0] ELSE list_append(range(0, h - patch + 1, step), h - patch) END) AS s FROM sides))
    SELECT event_id, x0::BIGINT AS x0, y0::BIGINT AS y0 FROM xs JOIN ys USING (event_id)"""


def frame_sizes(v: Views) -> DataFrame:
    e = F.col("event_id")
    return v.events.select(
        "event_id",
        (400 + e % 1700).cast("int").alias("w"),
        (300 + (e * 3) % 900).cast("int").alias("h"),
        F.lit(512).alias("patch"),
        (e % 5 / F.lit(10.0)).alias("overlap"),
    )


@query("tile_grid", "ev", TILE_SQL)
def tile_grid(v: Views) -> DataFrame:
    return spatial.tile_grid(frame_sizes(v), "w", "h", "patch", "overlap").select("event_id", "x0", "y0")


@query("tiles", "ev", TILE_SQL)
def tiles(v: Views) -> DataFrame:
    """The same grid through the table function, called from SQL."""
    spatial.register_tiles(v.spark)
    frame_sizes(v).createOrReplaceTempView("mcid_frame_sizes")
    return v.spark.sql(
        "SELECT event_id, t.x0, t.y0 FROM mcid_frame_sizes, LATERAL tiles(w, h, patch, overlap) t"
    )


@query(
    "tile_to_frame",
    "aux",
    """
    SELECT aux_id, x1 + (aux_id % 4) * 384 AS x1, y1 + (aux_id % 3) * 256 AS y1,
           x2 + (aux_id % 4) * 384 AS x2, y2 + (aux_id % 3) * 256 AS y2, score
    FROM aux WHERE score >= 0.4 AND (x2 - x1) * (y2 - y1) >= 30""",
)
def tile_to_frame(v: Views) -> DataFrame:
    a = F.col("aux_id")
    tiled = v.aux.withColumn("tile_x", (a % 4) * 384).withColumn("tile_y", (a % 3) * 256)
    return spatial.tile_to_frame(tiled).select("aux_id", "x1", "y1", "x2", "y2", "score")


# ---- vectors --------------------------------------------------------------------
@query(
    "l2_normalize",
    None,
    """
    SELECT vec_id, round(list_dot_product(u, u), 6) AS length, unnest(range(1, len(u) + 1))::INTEGER AS position, round(unnest(u), 6) AS value
    FROM (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u
          FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * (1 + vec_id % 9)) AS e FROM embeddings))""",
)
def l2_normalize(v: Views) -> DataFrame:
    grown = v.table("embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("vec_id") % 9)).alias("e")
    )
    unit = grown.select("vec_id", vectors.unit(F.col("e")).alias("u"))
    length = F.round(vectors.dot(F.col("u"), F.col("u")), 6).alias("length")
    return unit.select("vec_id", length, F.posexplode("u").alias("p", "x")).select(
        "vec_id", "length", (F.col("p") + 1).alias("position"), F.round("x", 6).alias("value")
    )


@query(
    "cosine",
    "points vecs",
    """
    SELECT tracklet_id, round(list_cosine_similarity(vector, e), 6) AS cosine
    FROM points JOIN vecs ON vec_id = event_id % (SELECT count(*) FROM embeddings)""",
)
def cosine(v: Views) -> DataFrame:
    n = v.table("embeddings").agg(F.count("*")).scalar()
    base = v.table("embeddings").select("vec_id", "embedding")
    keyed = v.points.withColumn("vec_id", F.col("event_id") % n)
    return keyed.join(base, "vec_id").select(
        "tracklet_id", F.round(vectors.cosine(F.col("vector"), F.col("embedding")), 6).alias("cosine")
    )


@query(
    "dim_check",
    None,
    """
    SELECT (vec_id % 4 <> 2) AS right_dim, count(*) AS vectors, min(vec_id) AS first_id FROM embeddings GROUP BY 1""",
)
def dim_check(v: Views) -> DataFrame:
    cut = v.table("embeddings").withColumn(
        "embedding", F.when(F.col("vec_id") % 4 == 2, F.slice("embedding", 1, 32)).otherwise(F.col("embedding"))
    )
    good, bad = spatial.dim_check(cut, "embedding", 64)

    def counted(df: DataFrame, ok: bool) -> DataFrame:
        return df.groupBy(F.lit(ok).alias("right_dim")).agg(
            F.count("*").alias("vectors"), F.min("vec_id").alias("first_id")
        )

    return counted(good, True).unionByName(counted(bad, False))


@query(
    "point_id",
    "ev",
    """
    SELECT event_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-'
           || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3)
           || '-' || substr(h, 21, 12) AS point_id
    FROM (SELECT event_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8')
            || ('msmt:T' || event_id || ':' || lpad((event_id % 15)::VARCHAR, 2, '0'))::BLOB) AS h FROM ev)""",
)
def point_id(v: Views) -> DataFrame:
    e = F.col("event_id")
    pid = vectors.point_id(F.lit("msmt"), F.concat(F.lit("T"), e), (e % 15).cast("int"))
    return v.events.select("event_id", pid.alias("point_id"))
