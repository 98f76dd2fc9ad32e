"""SimHash near-duplicates by covering locality-sensitive hashing.

Method: each bit of the fingerprint carries a nonzero code of ``radius + 1`` bits; table ``v`` keeps the
bits whose code has an odd inner product with ``v``. Any ``radius`` differing bits span a space of at most
``radius`` dimensions, so some nonzero ``v`` is orthogonal to all of them: its mask holds none of the
differing bits, and the pair meets in that table. No pair within the radius is lost.

Hot buckets: a bucket holds distinct fingerprints only. One with more than ``bucket`` of them is split by
a second covering family over the bits that the first mask left out (the same argument holds there), so a
group is at most ``2 ** free bits`` large whatever the input. A group gives a spanning forest of its links,
never all its pairs.

Cases: null or empty text has fingerprint zero, linked like any other; fewer than ``n`` words are one
shingle; repeated rows and repeated ids each keep their row; a null id keeps its row and takes the smallest
id of its component (null if none has one); an empty table gives no rows; other columns of the input are
not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ..session import cut_lineage
from .common import components, map_arrow, release, texts

BITS = 64


def fingerprint(text: bytes, n: int = 3, step: int = 1 << 15) -> int:
    """Bits set in over half the hashes of a text's shingles."""
    w = text.lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w)] if len(w) < n else list(map(b" ".join, zip(*(w[i:] for i in range(n)))))
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(shingles), step):
        part = shingles[at : at + step]
        h = np.fromiter(map(xxh64_intdigest, part, repeat(42)), np.uint64, len(part))
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += np.add.reduce(bits, axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(shingles)).tobytes(), "big")


def fingerprints(docs: DataFrame, n: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        fp = np.array([fingerprint(t, n) for t in texts(batch, "text")], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(fp)], ["doc_id", "fp"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, fp long")


def masks(radius: int, within: int = 2**BITS - 1) -> list[int]:
    """Covering masks over the set bits of ``within``."""
    codes = 2 ** (radius + 1)
    places = [i for i in range(BITS) if within >> i & 1]
    code = {p: 1 + k % (codes - 1) for k, p in enumerate(places)}
    return [sum(1 << p for p in places if (code[p] & v).bit_count() % 2) for v in range(1, codes)]


def signed(x: int) -> int:
    return x - 2**BITS if x >> (BITS - 1) else x


def keyed(fps: DataFrame, tables: list[list[int]], fp: Column, into: str) -> DataFrame:
    """A row per fingerprint and mask: ``into`` is (mask number, masked bits). ``tables`` lists masks by ``t`` where given."""
    arrays = [F.array(*[F.struct(F.lit(i).alias("t"), fp.bitwiseAND(F.lit(signed(m))).alias("k")) for i, m in enumerate(t)]) for t in tables]
    if len(arrays) == 1:
        return fps.withColumn(into, F.explode(arrays[0]))
    choice = F.element_at(F.array(*[F.array(*[F.lit(signed(m)) for m in t]) for t in tables]), F.col("t") + 1)
    return fps.select("*", F.posexplode(choice).alias("_t", "_m")).withColumn(into, F.struct(F.col("_t").alias("t"), fp.bitwiseAND(F.col("_m")).alias("k"))).drop("_t", "_m")


def forest(fps: list[int], radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within one group of distinct fingerprints."""
    n = len(fps)
    if n <= 24:
        reached, out = list(range(n)), []
        for i in range(1, n):
            for j in range(i):
                if reached[i] != reached[j] and ((fps[i] ^ fps[j]) & (2**BITS - 1)).bit_count() <= radius:
                    out.append((fps[i], fps[j]))
                    old, new = reached[i], reached[j]
                    reached = [new if r == old else r for r in reached]
        return out
    # breadth first: each fingerprint is taken out once and compared with those still outside
    rest, out = np.array(fps, np.int64).view(np.uint64), []
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                found = rest[near]
                out += [(signed(int(x)), signed(int(y))) for y in found]
                front += list(found)
                rest = rest[~near]
    return out


def forests(groups: DataFrame, radius: int) -> DataFrame:
    """Links a, b of groups with a list ``fps``."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        links = [e for fps in batch.column("fps").to_pylist() for e in forest(fps, radius)]
        yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    return map_arrow(groups.select("fps"), run, "a long, b long")


def links(fps: DataFrame, radius: int = 3, bucket: int = 8192) -> DataFrame:
    """Links a, b between distinct fingerprints ``fp``: enough of those within ``radius`` to keep the components."""
    first = masks(radius)
    spread = keyed(fps.select("fp"), [first], F.col("fp"), "b").select("fp", "b.t", "b.k")
    sizes = spread.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    met = cut_lineage(spread.join(sizes, ["t", "k"]))
    small = met.where(F.col("n") <= bucket).groupBy("t", "k").agg(F.collect_list("fp").alias("fps"))
    second = [masks(radius, (2**BITS - 1) & ~m) for m in first]
    hot = keyed(met.where(F.col("n") > bucket), second, F.col("fp"), "s").select("t", "k", "s", "fp")
    hot = hot.groupBy("t", "k", "s").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return forests(small.select("fps").union(hot.select("fps")), radius).distinct()


def near_duplicates(docs: DataFrame, radius: int = 3, n: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable by links."""
    spark = docs.sparkSession
    prints = cut_lineage(fingerprints(docs, n))
    by_fp = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = components(links(by_fp, radius))
    linked = cut_lineage(by_fp.join(roots.withColumnRenamed("node", "fp"), "fp"))
    lows = linked.groupBy("root").agg(F.min("low").alias("best"))
    best = linked.join(lows, "root").select("fp", "best")
    ids = cut_lineage(by_fp.join(best, "fp", "left").select("fp", F.coalesce("best", "low").alias("component_id")))
    release(spark, linked)
    # a fingerprint shared by very many rows is a skewed key here; the join splits it
    return prints.join(ids, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_first(docs: DataFrame, radius: int = 3, n: int = 3) -> DataFrame:
    """The documents with the smallest id of their component.

    Rows that repeat an id count once (the smallest row stays); a row without an id cannot be
    named by a group and stays.
    """
    return firsts(docs, near_duplicates(docs, radius, n))


def firsts(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows that ``keep_first`` keeps; ``found`` has doc_id and component_id."""
    kept = cut_lineage(found.where("doc_id = component_id").select("doc_id").distinct())
    return one_per_id(docs.where("doc_id is not null")).join(kept, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.where("doc_id is null"))


def one_per_id(docs: DataFrame) -> DataFrame:
    """One row per doc_id; only ids that occur more than once are compared by their rows."""
    again = cut_lineage(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    first = docs.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*docs.columns)).alias("r")).select("r.*")
    return docs.join(again, "doc_id", "left_anti").unionByName(first)
