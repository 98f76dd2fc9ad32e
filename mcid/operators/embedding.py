"""User-supplied embedding functions, and vector aggregates usable from SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def embed_crops(
    df: DataFrame, fn: Callable[[pd.DataFrame], np.ndarray], dim: int, batch: int = 16, column: str = "embedding"
) -> DataFrame:
    """Add unit vectors made by ``fn``, which gets at most ``batch`` rows at a time.

    Rows whose vector is missing or has another size come back with NULL, for
    ``dim_check`` to count.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            made = [fn(part.iloc[i : i + batch]) for i in range(0, len(part), batch)]
            if all(isinstance(m, np.ndarray) and m.ndim == 2 and m.shape[1] == dim and m.dtype != object for m in made):
                out = list(_unit_rows(np.concatenate(made).astype("float32"))) if made else []
            else:
                out = [None if v is None else np.asarray(v, dtype="float32") for m in made for v in m]
                out = [None if v is None or v.shape != (dim,) else _unit_rows(v[None])[0] for v in out]
            yield part.assign(**{column: out})

    fields = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return df.mapInPandas(run, f"{fields}, {column} array<float>")


def _unit_rows(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.where(n > 1e-12, m / np.maximum(n, np.float32(1e-12)), m)


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=-1, keepdims=True)
    return np.where(n < 1e-12, m, m / np.maximum(n, 1e-12))


def register_mean_vector(spark: SparkSession) -> None:
    """SQL aggregate ``mean_vector(array<double>)``: the length-one mean of length-one
    vectors. A group must fit in memory; ``tracklets.mean_vectors`` has no such
    limit and is the better choice for large groups."""

    @F.pandas_udf("array<double>")
    def mean_vector(v: pd.Series) -> list:
        return _unit(_unit(np.stack(v.to_numpy())).mean(axis=0)).tolist()

    spark.udf.register("mean_vector", mean_vector)
