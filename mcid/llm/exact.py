"""Exact duplicates by polynomial fingerprints that can be put together from parts.

A text's bytes, A-Z in lower case, are the digits of a number to the base 256; the fingerprint is that number
modulo ``PRIME``, with the length beside it. For two stretches, ``f(a + b) = f(a) * 256 ** len(b) + f(b)``, so a
long text is cut into chunks that are hashed apart from each other, wherever they lie: each chunk's value is
shifted by the bytes after it, and the shifted values only have to be added up. Spark adds them as four 32-bit
limbs, so partial sums meet before the shuffle and no task sees a long text whole.

Equal fingerprints are only a proposal. The texts of a group are compared chunk by chunk: a group is of one text
if, at every chunk, the smallest and the largest bytes of the group are the same. Smallest and largest are
combined in the tasks, so a group with a third of all rows sends one chunk per task. A bitmap of fixed size
tells which fingerprints occur twice; texts of others are not shuffled. Groups that do not agree are split
exactly: all rows are compared with one leader, those that differ go on to the next round, which takes as many
rounds as the group has texts.

Rows meet their group's result by a join on the fingerprint. Groups with more than a 4,096th of all rows - so,
fewer than 4,096 - are broadcast; all others are small.

Cases: null text counts as empty, and empty texts are equal to each other; a missing id is smaller than any
other, so ``keep_id`` is null only if all ids of the group are; of rows that share the largest id and the text,
one stays; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import map_arrow, release, texts
from .members import bitmap, holds

#: 2**127 - 2721: (PRIME - 1) / 2 is prime, too, so powers of 256 do not repeat within any text.
PRIME = (1 << 127) - 2721
#: Bytes of a chunk.
CHUNK = 1 << 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LIMBS = ["l0", "l1", "l2", "l3"]
KEY = ["fp", "n_bytes"]


def value(chunk: bytes, prime: int = PRIME) -> int:
    return int.from_bytes(chunk, "big") % prime


def shifted(h: int, after: int, prime: int = PRIME) -> int:
    """What a stretch adds to the value of a text that has ``after`` bytes behind it."""
    return h * pow(256, after, prime) % prime


def packed(h: int) -> bytes:
    return h.to_bytes(16, "big")


def mixed(fps: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """64 bits of a fingerprint and its length, for the bitmap."""
    halves = np.frombuffer(b"".join(fps), ">u8").astype(np.uint64).reshape(-1, 2)
    return halves[:, 0] * np.uint64(0x9E3779B97F4A7C15) ^ halves[:, 1] ^ sizes.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


class Prints:
    """Fingerprints of the texts of ``docs``."""

    def __init__(self, docs: DataFrame, chunk: int = CHUNK, prime: int = PRIME) -> None:
        self.chunk, self.prime = chunk, prime
        self.id_type = docs.schema["doc_id"].dataType.simpleString()
        text = F.coalesce("text", F.lit(""))
        rows = docs.select("doc_id", F.sha2(F.translate(text, UPPER, LOWER), 256).alias("text_sha256"), F.octet_length(text).cast("long").alias("n_bytes"), text.cast("binary").alias("body"))
        self.short = rows.where(F.col("n_bytes") <= chunk)
        self.long = self._long(rows.where(F.col("n_bytes") > chunk))

    def _long(self, rows: DataFrame) -> DataFrame:
        """Chunks of long texts with the fingerprint of the whole text."""
        size, prime = self.chunk, self.prime
        last = F.ceil(F.col("n_bytes") / size) - 1
        chunks = (
            rows.withColumn("rid", F.monotonically_increasing_id())
            .select("*", F.explode(F.sequence(F.lit(0), last)).alias("no"))
            .select("rid", "doc_id", F.when(F.col("no") == 0, F.col("text_sha256")).alias("text_sha256"), "n_bytes", "no", F.substring("body", (F.col("no") * size + 1).cast("int"), F.lit(size)).alias("body"))
        )

        def terms(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            bodies = [b.lower() for b in texts(batch, "body")]
            after = np.maximum(column(batch, "n_bytes").to_numpy() - (column(batch, "no").to_numpy() + 1) * size, 0)
            found = [shifted(value(b, prime), int(a), prime) for b, a in zip(bodies, after)]
            limbs = [pa.array([h >> 32 * k & 0xFFFFFFFF for h in found], pa.int64()) for k in range(4)]
            kept = [column(batch, c) for c in ("rid", "doc_id", "text_sha256", "n_bytes", "no")]
            yield pa.record_batch([*kept, pa.array(bodies, pa.binary()), *limbs], names=["rid", "doc_id", "text_sha256", "n_bytes", "no", "piece", *LIMBS])

        # written once: the numbers of rows must not change when a task runs again
        self.chunks = cut_lineage(map_arrow(chunks, terms, f"rid long, doc_id {self.id_type}, text_sha256 string, n_bytes long, no long, piece binary, {', '.join(f'{c} long' for c in LIMBS)}"))

        def added(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            sums = zip(*(column(batch, c).to_pylist() for c in LIMBS))
            fps = [packed(sum(s << 32 * k for k, s in enumerate(four)) % prime) for four in sums]
            yield pa.record_batch([column(batch, "rid"), pa.array(fps, pa.binary())], names=["rid", "fp"])

        sums = self.chunks.groupBy("rid").agg(*[F.sum(c).alias(c) for c in LIMBS])
        return self.chunks.drop(*LIMBS).join(map_arrow(sums, added, "rid long, fp binary"), "rid")

    def rows(self) -> DataFrame:
        """doc_id, text_sha256, n_bytes, fp: one row per document."""
        prime = self.prime

        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            fps = [packed(value(b.lower(), prime)) for b in texts(batch, "body")]
            kept = [column(batch, c) for c in ("doc_id", "text_sha256", "n_bytes")]
            yield pa.record_batch([*kept, pa.array(fps, pa.binary())], names=["doc_id", "text_sha256", "n_bytes", "fp"])

        short = map_arrow(self.short, run, f"doc_id {self.id_type}, text_sha256 string, n_bytes long, fp binary")
        return short.unionByName(self.long.where("no = 0").select(short.columns))

    def pieces(self, among: DataFrame) -> DataFrame:
        """fp, n_bytes, no, piece: the chunks of texts whose fingerprints are in ``among`` (and a few others).

        A batch gives each distinct chunk once.
        """
        prime, bits = self.prime, among.sparkSession.sparkContext.broadcast(bitmap(hashes(among)))

        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            bodies = [b.lower() for b in texts(batch, "body")]
            sizes = column(batch, "n_bytes").to_numpy()
            fps = [packed(value(b, prime)) for b in bodies]
            kept: dict[bytes, set[bytes]] = {}
            for k in np.flatnonzero(holds(bits.value, mixed(fps, sizes))).tolist():
                kept.setdefault(fps[k], set()).add(bodies[k])
            found = [(fp, len(b), b) for fp, some in kept.items() for b in some]
            columns = list(zip(*found)) or [(), (), ()]
            yield pa.record_batch(
                [pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int64()), pa.array([0] * len(found), pa.int64()), pa.array(columns[2], pa.binary())],
                names=["fp", "n_bytes", "no", "piece"],
            )

        short = map_arrow(self.short.select("n_bytes", "body"), run, "fp binary, n_bytes long, no long, piece binary")
        return short.unionByName(self.long.select("fp", "n_bytes", "no", "piece").join(among.select(*KEY), KEY, "left_semi"))

    def whole(self, among: DataFrame) -> DataFrame:
        """The chunks of all rows whose fingerprints are in ``among``, with the columns of :meth:`rows` and a row number."""
        prime = self.prime

        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            bodies = [b.lower() for b in texts(batch, "body")]
            fps = [packed(value(b, prime)) for b in bodies]
            kept = [column(batch, c) for c in ("doc_id", "text_sha256", "n_bytes")]
            yield pa.record_batch([*kept, pa.array(bodies, pa.binary()), pa.array(fps, pa.binary())], names=["doc_id", "text_sha256", "n_bytes", "piece", "fp"])

        short = map_arrow(self.short, run, f"doc_id {self.id_type}, text_sha256 string, n_bytes long, piece binary, fp binary")
        named = short.join(among.select(*KEY), KEY, "left_semi").withColumns({"no": F.lit(0).cast("long"), "rid": -1 - F.monotonically_increasing_id()})
        return cut_lineage(named.unionByName(self.long.join(among.select(*KEY), KEY, "left_semi").select(named.columns)))


def hashes(groups: DataFrame) -> DataFrame:
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        h = mixed(column(batch, "fp").to_pylist(), column(batch, "n_bytes").to_numpy()) if batch.num_rows else np.zeros(0, np.uint64)
        yield pa.record_batch([pa.array(h.view(np.int64))], names=["h"])

    return map_arrow(groups.select(*KEY), run, "h long")


def split(chunks: DataFrame) -> DataFrame:
    """Classes of equal texts within each fingerprint: the columns of :meth:`Prints.rows`, rid and class."""
    done: DataFrame | None = None
    left = chunks
    while True:
        leaders = left.where("no = 0").groupBy(*KEY).agg(F.min("rid").alias("class"))
        led = left.join(leaders, KEY)
        sample = led.where("rid = class").select(*KEY, "no", F.col("piece").alias("lead"))
        differ = left.join(sample, [*KEY, "no"]).where("piece <> lead").select("rid").distinct()
        settled = cut_lineage(led.where("no = 0").join(differ, "rid", "left_anti").drop("piece", "no"))
        done = settled if done is None else done.unionByName(settled)
        rest = cut_lineage(left.join(differ, "rid", "left_semi").select(chunks.columns))
        release(chunks.sparkSession, left)
        left = rest
        if left.isEmpty():
            release(chunks.sparkSession, left)
            return done


def judged(docs: DataFrame, chunk: int = CHUNK, prime: int = PRIME) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, fingerprint."""
    spark = docs.sparkSession
    prints = Prints(docs, chunk, prime)
    rows = cut_lineage(prints.rows().withColumns({"rid": F.monotonically_increasing_id(), "class": F.lit(0).cast("long")}))
    twice = cut_lineage(rows.groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1"))
    compared = prints.pieces(twice).groupBy(*KEY, "no").agg(F.min("piece").alias("low"), F.max("piece").alias("high"))
    mixed_up = cut_lineage(compared.where("low <> high").select(*KEY).distinct())
    if not mixed_up.isEmpty():
        parts = split(prints.whole(mixed_up))
        rows = cut_lineage(rows.join(mixed_up, KEY, "left_anti").unionByName(parts))
    release(spark, prints.chunks, twice)
    key = [*KEY, "class"]
    groups = cut_lineage(rows.groupBy(*key).agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "rid")).alias("last")))
    great = F.col("group_size") > max(1000, rows.count() // 4096)
    at_once = rows.join(F.broadcast(groups.where(great)), key, "left")
    small = at_once.where("group_size IS NULL").drop("group_size", "last").join(groups.where(~great), key)
    return at_once.where("group_size IS NOT NULL").unionByName(small).select(
        "doc_id",
        F.col("last.doc_id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("last.rid")).alias("kept"),
        "text_sha256",
        F.lower(F.hex("fp")).alias("fingerprint"),
    )


def same_text(text: str) -> Column:
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), 256)


def keep_last(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The rows of ``docs`` that stay, one of each text; rows that share id and text count as one."""
    stay = judged(docs, chunk).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    found = docs.withColumn("_own", same_text("text"))
    joined = found.join(stay, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_sha")), "left_semi")
    return joined.dropDuplicates(["doc_id", "_own"]).drop("_own")
