"""Scalar rules as SQL functions, so that the optimizer inlines them in queries."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..functions.scoring import Policy, Weights


def _definitions(weights: Weights, policy: Policy) -> list[str]:
    w = weights.normalized()
    override = (
        f"WHEN top1 >= {policy.override}D AND mcid_margin(top1, top2) > {policy.margin}D THEN 'match'"
        if policy.override is not None
        else ""
    )
    unsure = "ambiguous" if policy.new_id_when_ambiguous else "held"
    corners = "sequence(0, greatest(size(polygon) - 1, 0))"
    before = "polygon[(i + size(polygon) - 1) % size(polygon)]"
    return [
        """bbox_iou(ax1 DOUBLE, ay1 DOUBLE, ax2 DOUBLE, ay2 DOUBLE, bx1 DOUBLE, by1 DOUBLE, bx2 DOUBLE, by2 DOUBLE)
        RETURNS DOUBLE RETURN coalesce(try_divide(
            greatest(0D, least(ax2, bx2) - greatest(ax1, bx1)) * greatest(0D, least(ay2, by2) - greatest(ay1, by1)),
            greatest(0D, ax2 - ax1) * greatest(0D, ay2 - ay1) + greatest(0D, bx2 - bx1) * greatest(0D, by2 - by1)
            - greatest(0D, least(ax2, bx2) - greatest(ax1, bx1)) * greatest(0D, least(ay2, by2) - greatest(ay1, by1))), 0D)""",
        f"""point_in_polygon(polygon ARRAY<ARRAY<DOUBLE>>, px DOUBLE, py DOUBLE) RETURNS BOOLEAN RETURN
            size(polygon) >= 3 AND size(filter({corners}, i ->
              (polygon[i][1] > py) <> ({before}[1] > py) AND px < ({before}[0] - polygon[i][0]) * (py - polygon[i][1])
                / CASE WHEN {before}[1] = polygon[i][1] THEN 1e-12D ELSE {before}[1] - polygon[i][1] END + polygon[i][0])) % 2 = 1""",
        """cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN coalesce(try_divide(
            aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x),
            sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x))), 0D)""",
        f"""final_score(cosine DOUBLE, temporal DOUBLE, topology DOUBLE, quality DOUBLE, zone DOUBLE) RETURNS DOUBLE RETURN
            least(1D, greatest(0D, cosine * {w.reid!r}D + temporal * {w.temporal!r}D + topology * {w.camera!r}D
            + quality * {w.quality!r}D + zone * {w.zone!r}D))""",
        """mcid_margin(top1 DOUBLE, top2 DOUBLE) RETURNS DOUBLE RETURN
            CASE WHEN top1 IS NULL THEN 0D WHEN top2 IS NULL THEN 1D ELSE top1 - top2 END""",
        f"""decide(top1 DOUBLE, top2 DOUBLE, link BOOLEAN, final DOUBLE) RETURNS STRING RETURN
            CASE WHEN top1 IS NULL THEN 'new' WHEN link = FALSE THEN 'new' {override}
                 WHEN final >= {policy.auto_match}D AND mcid_margin(top1, top2) > {policy.margin}D THEN 'match'
                 WHEN final >= {policy.candidate}D AND mcid_margin(top1, top2) > {policy.margin}D THEN 'candidate'
                 WHEN final >= {policy.candidate}D THEN '{unsure}' ELSE 'new' END""",
        """zone_slug(name STRING) RETURNS STRING RETURN coalesce(nullif(trim(BOTH '-' FROM
            regexp_replace(replace(lower(trim(coalesce(nullif(name, ''), 'unknown-zone'))), '&', ' and '), '[^a-z0-9]+', '-')), ''), 'unknown-zone')""",
    ]


def register(spark: SparkSession, weights: Weights = Weights(), policy: Policy = Policy()) -> None:
    for text in _definitions(weights, policy):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {text}")
