"""Row-level helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that is evaluated once per row.

    A filter on a plain computed column is pushed below its projection and
    evaluates the expression again for each mention; a generated column is not.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))
