"""Zone polygons: parsing, scaling and the point-in-polygon test."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POLYGON = "array<array<double>>"


def parse(text: Column) -> Column:
    """Polygon from ``[[x,y],...]`` text; NULL when it is not one."""
    raw = F.from_json(text, POLYGON, {"mode": "PERMISSIVE"})
    whole = F.forall(raw, lambda p: (F.size(p) == 2) & p[0].isNotNull() & p[1].isNotNull())
    return F.when(whole, raw)


def parse_strict(text: Column, zone_id: Column) -> Column:
    """Like :func:`parse`, but a bad polygon stops the job."""
    return F.coalesce(
        parse(text), F.raise_error(F.concat(F.lit("invalid polygon for zone "), zone_id)).cast(POLYGON)
    )


def scale(polygon: Column, sx: Column, sy: Column) -> Column:
    """Multiply by ``(sx, sy)`` and round half-even to whole pixels."""
    return F.transform(
        polygon,
        lambda p: F.array(F.bround(p[0] * sx, 0), F.bround(p[1] * sy, 0)).cast("array<double>"),
    )


def contains(polygon: Column, px: Column, py: Column) -> Column:
    """Even-odd rule over the implicitly closed edges; fewer than 3 corners is empty."""
    n = F.size(polygon)

    def crosses(i: Column) -> Column:
        a = F.get(polygon, i)
        b = F.get(polygon, (i + n - 1) % n)
        rise = b[1] - a[1]
        at = (b[0] - a[0]) * (py - a[1]) / F.when(rise == 0, F.lit(1e-12)).otherwise(rise) + a[0]
        return ((a[1] > py) != (b[1] > py)) & (px < at)

    edges = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), crosses)
    return F.when(n < 3, F.lit(False)).otherwise(F.size(edges) % 2 == 1)
