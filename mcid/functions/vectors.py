"""Appearance vectors as arrays: length, similarity and dimension checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column, eps: float = 1e-12) -> Column:
    """Vector of length one; a vector shorter than ``eps`` is left as it is."""
    n = norm(v)
    # the norm travels as a one-element array so that it is computed once per row
    return F.flatten(
        F.transform(
            F.array(n),
            lambda k: F.transform(v, lambda x: F.when(k < eps, x.cast("double")).otherwise(x / k)),
        )
    )


def cosine(a: Column, b: Column) -> Column:
    return F.when((norm(a) > 0) & (norm(b) > 0), dot(a, b) / (norm(a) * norm(b))).otherwise(F.lit(0.0))


def has_dim(v: Column, dim: int) -> Column:
    return F.size(v) == dim


def point_id(model: Column, tracklet_id: Column, index: Column) -> Column:
    """Name-based version-5 UUID of ``model:tracklet:NN`` in the URL namespace."""
    # fixed value: the URL namespace of RFC 4122
    space = F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8"))
    name = F.concat(model, F.lit(":"), tracklet_id, F.lit(":"), F.format_string("%02d", index))
    h = F.sha1(F.concat(space, F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws(
        "-",
        F.substring(h, 1, 8),
        F.substring(h, 9, 4),
        F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)),
        F.substring(h, 21, 12),
    )
