"""Token totals kept up by signed deltas.

Method: a batch of changes becomes signed entries: an insert adds a document and its tokens, a delete takes
away what is held of the document, a revision does both. Each batch also writes its sums by source, language and
tokenizer version; totals are the sums of these small rows, so no document is counted again. The folder of a
batch's sums appears as a whole when its write is committed, and only batches that have one are read: a batch
that broke off leaves nothing visible, and running a committed one again changes nothing.

Cases: null or empty text has no tokens; null source, language or version is a group of its own; rows of one batch
that share an id all count, and a later delete or revision takes all of them; a delete of an unknown id does
nothing; rows without an id can be added but not found again; an empty batch commits without rows; other columns of
the input are not read, so their names cannot clash.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from . import bpe
from .common import map_arrow

ENTRY = "doc_id long, source string, lang string, version string, docs long, tokens long"
TOTAL = "source string, lang string, version string, docs long, tokens long"
KEYS = ("source", "lang", "version")


def counted(docs: DataFrame, version: str, count: Callable[[list[str]], list[int]]) -> DataFrame:
    """An entry of each document of ``docs`` (doc_id, source, lang, text)."""

    def run(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        n = count([t or "" for t in batch.column("text").to_pylist()])
        ids = batch.column("doc_id").cast(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [ids, batch.column("source"), batch.column("lang"), pa.array([version] * len(n), pa.string()), pa.array([1] * len(n), pa.int64()), pa.array(n, pa.int64())],
            ["doc_id", "source", "lang", "version", "docs", "tokens"],
        )

    return map_arrow(docs.select("doc_id", "source", "lang", "text"), run, ENTRY)


class Ledger:
    """Entries and sums by batch under ``path``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def committed(self) -> list[str]:
        """Batches whose sums were written to the end."""
        jvm = self.spark.sparkContext._jvm
        pattern = jvm.org.apache.hadoop.fs.Path(f"{self.path}/sums/*/_SUCCESS")
        found = pattern.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
        return sorted(s.getPath().getParent().getName() for s in found or [])

    def folders(self, kind: str, schema: str) -> DataFrame:
        names = self.committed()
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{kind}/{n}" for n in names])

    def held(self) -> DataFrame:
        """What the ledger holds of each document."""
        return (
            self.folders("entries", ENTRY)
            .groupBy("doc_id", *KEYS)
            .agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
            .where("docs <> 0 or tokens <> 0")
        )

    def taken_back(self, ids: DataFrame, versions: list[str] | None = None) -> DataFrame:
        """Entries that take away all that is held of the given documents."""
        held = self.held()
        if versions is not None:
            held = held.where(F.col("version").isin(versions))
        return held.join(ids.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", *KEYS, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens"))

    def commit(self, batch: str, added: DataFrame | None = None, deleted: DataFrame | None = None, revised: DataFrame | None = None) -> bool:
        """Commit a batch once. ``added``, ``revised``: entries. ``deleted``: doc_id. False: it was there already."""
        if batch in self.committed():
            return False
        parts = [added] if added is not None else []
        if deleted is not None:
            parts.append(self.taken_back(deleted))
        if revised is not None:
            versions = [r["version"] for r in revised.select("version").distinct().collect()]  # versions are few by meaning
            parts += [self.taken_back(revised, versions), revised]
        rows = self.spark.createDataFrame([], ENTRY)
        for p in parts:
            rows = rows.unionByName(p)
        entries, sums = (f"{self.path}/{kind}/{batch}" for kind in ("entries", "sums"))
        rows.write.mode("overwrite").parquet(entries)
        made = self.spark.read.schema(ENTRY).parquet(entries)
        made.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.mode("overwrite").parquet(sums)
        return True

    def totals(self) -> DataFrame:
        """source, lang, version, docs, tokens; groups that hold nothing are left out."""
        sums = self.folders("sums", TOTAL).groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where("docs <> 0 or tokens <> 0")


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """The documents that have a line twice, with only the first of each."""
    lines = F.split(F.col("text"), "\n")
    kept = docs.withColumn("_lines", lines).withColumn("_first", F.array_distinct("_lines"))
    return kept.where(F.size("_first") < F.size("_lines")).withColumn("text", F.array_join("_first", "\n")).drop("_lines", "_first")


def exact_copies(docs: DataFrame) -> DataFrame:
    """doc_id of documents whose text a smaller id has, by 256-bit digest."""
    slim = docs.where("doc_id is not null").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    first = slim.groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    return slim.join(first, "sha").where("doc_id > first").select("doc_id")


def upkeep(docs: DataFrame, version: str, path: str, pattern: str) -> DataFrame:
    """Totals after three batches: all documents, then revised texts without repeated lines, then exact copies deleted."""
    ledger = Ledger(docs.sparkSession, f"{shared_dir(docs.sparkSession)}/mcid-ledger-{uuid.uuid4().hex}")
    docs = docs.select("doc_id", "source", "lang", "text")

    def count(texts: list[str]) -> list[int]:
        return bpe.counts(texts, path, pattern)

    ledger.commit("1-load", added=counted(docs, version, count))
    ledger.commit("2-revise", revised=counted(without_repeated_lines(docs), version, count))
    ledger.commit("3-delete", deleted=exact_copies(docs))
    ledger.commit("3-delete", deleted=exact_copies(docs))  # a retried batch changes nothing
    return ledger.totals()
