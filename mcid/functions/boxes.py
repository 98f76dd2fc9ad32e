"""Boxes in pixels: geometry, overlap, padding, clipping and crop quality.

A box is four double columns or expressions ``(x1, y1, x2, y2)``.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column


def box(prefix: str = "") -> Box:
    """The box held in columns ``x1..y2``, or ``<prefix>.x1..`` of a struct/alias."""
    dot = f"{prefix}." if prefix else ""
    return Box(*(F.col(dot + n) for n in ("x1", "y1", "x2", "y2")))


def box_from_array(a: Column) -> Box:
    return Box(*(F.get(a, F.lit(i)) for i in range(4)))


def _at_least_zero(c: Column) -> Column:
    return F.greatest(F.lit(0.0), c)


def centroid(b: Box) -> tuple[Column, Column]:
    return (b.x1 + b.x2) / 2.0, (b.y1 + b.y2) / 2.0


def height(b: Box) -> Column:
    return _at_least_zero(b.y2 - b.y1)


def area(b: Box) -> Column:
    return _at_least_zero(b.x2 - b.x1) * _at_least_zero(b.y2 - b.y1)


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 when the union is empty."""
    w = _at_least_zero(F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1))
    h = _at_least_zero(F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1))
    inter = w * h
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def padded(b: Box, frame_w: Column, frame_h: Column, ratio: float = 0.10) -> Box:
    """Grow by ``ratio`` of each side and stay inside the frame (whole pixels)."""
    px, py = (b.x2 - b.x1) * ratio, (b.y2 - b.y1) * ratio
    return Box(
        F.greatest(F.lit(0), F.floor(b.x1 - px)).cast("bigint"),
        F.greatest(F.lit(0), F.floor(b.y1 - py)).cast("bigint"),
        F.least(frame_w, F.ceil(b.x2 + px)).cast("bigint"),
        F.least(frame_h, F.ceil(b.y2 + py)).cast("bigint"),
    )


def clipped(b: Box, frame_w: Column, frame_h: Column) -> Box:
    """Round half-even and clip so that the box lies inside the frame."""

    def at(v: Column, top: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.bround(v, 0).cast("bigint"), top)).cast("bigint")

    return Box(at(b.x1, frame_w - 1), at(b.y1, frame_h - 1), at(b.x2, frame_w), at(b.y2, frame_h))


def is_empty(b: Box) -> Column:
    return (b.x2 <= b.x1) | (b.y2 <= b.y1)


def cut_by_frame(b: Box, frame_w: Column, frame_h: Column, margin: float = 2.0) -> Column:
    return (b.x1 <= margin) | (b.y1 <= margin) | (b.x2 >= frame_w - margin) | (b.y2 >= frame_h - margin)


def _unit(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def crop_quality(
    b: Box,
    laplacian_var: Column,
    brightness: Column,
    frame_w: Column,
    frame_h: Column,
    min_height: float = 60.0,
) -> Column:
    """Blend of height, sharpness, brightness and wholeness; 0 rejects the crop."""
    h = height(b)
    tall = _unit((h - min_height) / (3.0 * min_height) + 0.5)
    sharp = _unit((laplacian_var - 50.0) / 100.0)
    bright = F.when((brightness < 30.0) | (brightness > 235.0), F.lit(0.0)).otherwise(
        1.0 - F.abs(brightness - 128.0) / 128.0
    )
    rejected = (h < min_height) | (sharp == 0) | (bright == 0) | cut_by_frame(b, frame_w, frame_h)
    blend = tall * 0.40 + sharp * 0.30 + bright * 0.20 + 0.10
    return F.when(rejected, F.lit(0.0)).otherwise(_unit(blend))


def quality_ok(score: Column, threshold: float = 0.5) -> Column:
    return score >= threshold


def tile_starts(length: Column, patch: Column, overlap: Column) -> Column:
    """First pixels of overlapping tiles along one side; the last is flush."""
    bounded = F.least(F.greatest(overlap, F.lit(0.0)), F.lit(0.95))
    step = F.greatest(F.lit(1), F.bround(patch * (F.lit(1.0) - bounded), 0).cast("int"))
    last = length - patch
    regular = F.sequence(F.lit(0), F.greatest(last, F.lit(0)), step)
    return F.when(length <= patch, F.array(F.lit(0))).otherwise(F.array_union(regular, F.array(last)))
