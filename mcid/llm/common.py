"""What the operators share: text helpers, cuts of lineage, connected components."""

from __future__ import annotations

import gc
import time
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import cut_lineage, delete_cuts

#: White space between words, as one Java and Python character class.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words of a text (null: none) as an array; computed by the JVM."""
    blank = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.array_remove(F.split(F.coalesce(blank, F.lit("")), " "), "")


def texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [b"" if x is None else x for x in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def bytes_batches(batches: Iterable[pa.RecordBatch], most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes, so that one with many long texts needs little memory."""
    for batch in batches:
        steps = max(1, -(-batch.nbytes // most))
        size = max(1, -(-batch.num_rows // steps))
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str | StructType, most: int = 16 << 20) -> DataFrame:
    """``mapInArrow`` for functions of one batch of about ``most`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bytes_batches(batches, most):
            yield from fn(batch)

    return df.mapInArrow(run, schema)


def release(spark: SparkSession, *cuts: DataFrame, shuffles: bool = False) -> None:
    """Delete cuts that nothing reads any more and, on demand, the shuffle files of finished jobs.

    Spark removes shuffle files once the driver has collected their plans as garbage; a long job of
    many steps would otherwise keep all of them until its end. Python's hold on a plan ends when its
    bridge to the JVM next looks for dropped objects, once a second.
    """
    delete_cuts(*cuts)
    if shuffles:
        gc.collect()
        time.sleep(1.5)
        spark.sparkContext._jvm.System.gc()


def components(edges: DataFrame) -> DataFrame:
    """Connected components: the smallest node reachable, for every node of an edge.

    ``edges``: a, b (any comparable type, not null). Returns node, root. Alternates "every larger
    neighbour joins my smallest" with the same for smaller neighbours until the edges form stars; the
    number of rounds grows with the logarithm of the longest path. A node with very many neighbours is
    a skewed join key, which AQE splits; its minimum is combined before the shuffle.
    """
    spark = edges.sparkSession
    stars = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = cut_lineage(small.select("e.*").where("u <> v").distinct())
        same = after.count() == stars.count() and after.join(stars, ["u", "v"], "left_anti").isEmpty()
        release(spark, stars)
        stars = after
        if same:
            break
    roots = stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
