"""Ordered computations that stay parallel when one key holds most of the rows.

A plain window partitioned by camera or person sorts that key's whole history in
one task. Here the history is cut into chunks (usually of time): every chunk is
its own window partition, a small aggregate keeps what crosses a chunk border,
and a window over those chunk rows carries it forward. The chunk rows of a key
are bounded by the time span it covers, not by its number of events.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _windows(keys: Sequence[str], order: Sequence[str], backwards: bool = False):
    by = [F.col(c).desc() if backwards else F.col(c).asc() for c in order]
    chunk = F.col("_chunk").desc() if backwards else F.col("_chunk").asc()
    return Window.partitionBy(*keys, "_chunk").orderBy(*by), Window.partitionBy(*keys).orderBy(chunk)


def neighbour(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    fields: dict[str, str],
    chunk: Column,
    following: bool = False,
) -> DataFrame:
    """Add columns of the previous (or following) row of the same key.

    ``fields`` maps new column names to source columns; they are NULL at the end
    of the key's history. ``chunk`` must grow with ``order``.
    """
    rows = df.withColumn("_chunk", chunk)
    inside, across = _windows(keys, order, following)
    packed = F.struct(*[F.col(src).alias(new) for new, src in fields.items()])
    border = F.min_by if following else F.max_by
    carried = (
        rows.groupBy(*keys, "_chunk")
        .agg(border(packed, F.struct(*order)).alias("_edge"))
        .select(*keys, "_chunk", F.lag("_edge").over(across).alias("_carry"))
        .where(F.col("_carry").isNotNull())
    )
    near = F.coalesce("_near", "_carry")
    return (
        rows.withColumn("_near", F.lag(packed).over(inside))
        .join(carried, [*keys, "_chunk"], "left")
        .select(*df.columns, *[near[new].alias(new) for new in fields])
    )


def running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, chunk: Column, name: str
) -> DataFrame:
    """Add the running sum of ``value`` within the key, current row included."""
    rows = df.withColumns({"_chunk": chunk, "_value": value})
    inside, across = _windows(keys, order)
    before = F.sum("_sum").over(across.rowsBetween(Window.unboundedPreceding, -1))
    carried = (
        rows.groupBy(*keys, "_chunk")
        .agg(F.sum("_value").alias("_sum"))
        .select(*keys, "_chunk", F.coalesce(before, F.lit(0)).alias("_before"))
    )
    so_far = F.sum("_value").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return (
        rows.withColumn("_so_far", so_far)
        .join(carried, [*keys, "_chunk"], "left")
        .select(*df.columns, (F.col("_so_far") + F.col("_before")).alias(name))
    )


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, name: str) -> DataFrame:
    """Add a 1-based running number; ``keys`` may be empty for one global order."""
    return running_total(df, keys, order, F.lit(1).cast("bigint"), chunk, name)


def last_known(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, chunk: Column, name: str
) -> DataFrame:
    """Add the latest non-NULL ``value`` up to and including the current row."""
    rows = df.withColumns({"_chunk": chunk, "_value": value})
    inside, across = _windows(keys, order)
    at = F.when(F.col("_value").isNotNull(), F.struct(*order))
    before = F.last("_edge", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1))
    carried = (
        rows.groupBy(*keys, "_chunk")
        .agg(F.max_by("_value", at).alias("_edge"))
        .select(*keys, "_chunk", before.alias("_carry"))
    )
    here = F.last("_value", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return (
        rows.withColumn("_here", here)
        .join(carried, [*keys, "_chunk"], "left")
        .select(*df.columns, F.coalesce("_here", "_carry").alias(name))
    )


def runs(df: DataFrame, keys: Sequence[str], at: str, gap: int, name: str = "run") -> DataFrame:
    """Number the runs of ``at`` values that are less than ``gap`` apart.

    Values in the same ``gap``-wide bucket are always in one run, so rows are
    first reduced to one per bucket (map side). Only buckets are compared, and a
    key has at most one per ``gap`` of the span it covers, however many rows.
    Returns one row per bucket: keys, ``bucket``, ``lo``, ``hi``, and the run.
    """
    buckets = df.groupBy(*keys, F.floor(F.col(at) / gap).alias("bucket")).agg(
        F.min(at).alias("lo"), F.max(at).alias("hi")
    )
    return number_runs(buckets, keys, gap, name)


def number_runs(buckets: DataFrame, keys: Sequence[str], gap: int, name: str = "run") -> DataFrame:
    """Run numbers for buckets made as in :func:`runs`."""
    w = Window.partitionBy(*keys).orderBy("bucket")
    opens = F.when(F.col("lo") - F.lag("hi").over(w) < gap, 0).otherwise(1).cast("bigint")
    so_far = F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return buckets.withColumn("_opens", opens).withColumn(name, so_far).drop("_opens")


def fold_sorted(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    step: Callable[[], Callable[[tuple, dict[str, np.ndarray]], Iterable[tuple]]],
    schema: str,
) -> DataFrame:
    """Run a stateful step over each key's rows in order, a batch at a time.

    Keys are spread over partitions and rows stream through in Arrow batches, so
    memory holds one batch plus the step's own state and never a whole key.
    ``step()`` makes a fresh function for each key; it gets the key and the next
    slice of its columns, and gives output rows.
    """
    names = [field.split()[0] for field in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, apply = None, None
        for batch in batches:
            if batch.empty:
                continue
            cols = {c: batch[c].to_numpy() for c in batch.columns}
            new = np.zeros(len(batch), dtype=bool)
            for k in keys:
                new[1:] |= cols[k][1:] != cols[k][:-1]
            cuts = [0, *np.flatnonzero(new).tolist(), len(batch)]
            out: list[tuple] = []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                key = tuple(cols[k][lo] for k in keys)
                if key != current:
                    current, apply = key, step()
                out.extend(apply(key, {c: a[lo:hi] for c, a in cols.items()}))
            yield pd.DataFrame(out, columns=names)

    spread = df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *order)
    return spread.mapInPandas(run, schema)
