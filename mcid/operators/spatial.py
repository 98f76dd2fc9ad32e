"""Tile grids and vector dimension checks over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions import boxes, vectors


def tile_grid(df: DataFrame, width: str, height: str, patch: str, overlap: str) -> DataFrame:
    """One row per tile of each frame, with the tile's first pixel."""

    def starts(side: str):
        return boxes.tile_starts(F.col(side), F.col(patch), F.col(overlap))

    return (
        df.withColumn("x0", F.explode(starts(width)))
        .withColumn("y0", F.explode(starts(height)))
        .withColumn("x0", F.col("x0").cast("bigint"))
        .withColumn("y0", F.col("y0").cast("bigint"))
    )


@udtf(returnType="x0: bigint, y0: bigint")
class Tiles:
    """Table function ``tiles(w, h, patch, overlap)``, for use from SQL."""

    @staticmethod
    def _starts(side: int, patch: int, step: int) -> list[int]:
        if side <= patch:
            return [0]
        return sorted({*range(0, side - patch + 1, step), side - patch})

    def eval(self, w: int, h: int, patch: int, overlap: float):
        step = max(1, round(patch * (1.0 - min(max(overlap, 0.0), 0.95))))
        for y in self._starts(h, patch, step):
            for x in self._starts(w, patch, step):
                yield x, y


def register_tiles(spark: SparkSession) -> None:
    spark.udtf.register("tiles", Tiles)


def tile_to_frame(df: DataFrame, min_score: float = 0.4, min_area: float = 30.0) -> DataFrame:
    """Move tile boxes by the tile's first pixel; weak and tiny boxes go."""
    b = boxes.box()
    area = (b.x2 - b.x1) * (b.y2 - b.y1)
    return df.where((F.col("score") >= min_score) & (area >= min_area)).withColumns(
        {
            "x1": b.x1 + F.col("tile_x"),
            "x2": b.x2 + F.col("tile_x"),
            "y1": b.y1 + F.col("tile_y"),
            "y2": b.y2 + F.col("tile_y"),
        }
    )


def dim_check(df: DataFrame, column: str, dim: int) -> tuple[DataFrame, DataFrame]:
    """(vectors of the expected size, the rest)."""
    ok = F.coalesce(vectors.has_dim(F.col(column), dim), F.lit(False))
    return df.where(ok), df.where(~ok)
