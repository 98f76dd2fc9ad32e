"""Near copies by the Jaccard similarity of their sets of word shingles.

Method: texts become sets of 64-bit shingle hashes; equal sets count once. Bands of min-hashes propose links.
So does SimHash: the fingerprints of :mod:`simhash` that its covering masks find within ``RADIUS`` bits, without a miss.
Connected proposals form tentative groups, so each set is sent to one place only, and there real set sizes decide:
a link is kept if and only if the similarity reaches the threshold, compared in whole numbers. A pair at 0.8 shares
no band with a chance of (1 - 0.8 ** ROWS) ** BANDS, about 2 in a million; a more similar one with less. SimHash
alone cannot do this: at 0.8 two fingerprints of 64 bits differ in about ten bits, beyond what covering masks can hold.

Hot groups: one with more than ``most`` shingles is cut into blocks, and each pair of blocks is compared in one
task. A group gives a spanning forest of its links, never all its pairs.

Cases: null or empty text has the empty set, linked to the others without words; fewer than ``n`` words are one
shingle; repeated rows and repeated ids each keep their row; a null id keeps its row and takes the smallest id of
its component (null if none has one); an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ..session import cut_lineage
from .common import bytes_batches, components, map_arrow, release, texts
from . import simhash
from .simhash import firsts

BANDS, ROWS = 56, 7
#: Bits in which fingerprints differ that SimHash proposes.
RADIUS = 3
#: Bits of the filter that keeps sets without a proposal from being sent.
FILTER = 1 << 24


def shingles(text: bytes, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    w = text.lower().split()
    if not w:
        return np.empty(0, np.uint64)
    grams = [b" ".join(w)] if len(w) < n else list(map(b" ".join, zip(*(w[i:] for i in range(n)))))
    return np.unique(np.fromiter(map(xxh64_intdigest, grams, repeat(42)), np.uint64, len(grams)))


def fingerprint(grams: np.ndarray) -> int:
    """SimHash of a set: bits that are set in over half of its hashes."""
    if not len(grams):
        return 0
    ones = np.zeros(simhash.BITS, np.int64)
    for at in range(0, len(grams), 1 << 15):
        part = grams[at : at + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.add.reduce(np.unpackbits(part, axis=1), axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(grams)).tobytes(), "big")


def set_id(grams: np.ndarray) -> int:
    return xxh64_intdigest(grams.tobytes(), 7)


def band_keys(sets: list[np.ndarray], step: int = 1 << 15) -> list[bytes]:
    """``BANDS`` keys of 8 bytes for each set; none for an empty one."""
    draw = np.random.default_rng(42)
    flips, factors = draw.integers(0, 2**64, (2, BANDS * ROWS), np.uint64)
    factors |= np.uint64(1)
    out: list[bytes] = [b""] * len(sets)
    full = [i for i, s in enumerate(sets) if len(s)]
    ends = np.cumsum([len(sets[i]) for i in full])
    at = 0
    while at < len(full):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + step, "right")))
        part = full[at:to]
        x = np.concatenate([sets[i] for i in part])
        starts = np.concatenate([[0], ends[at : to - 1] - base]).astype(np.int64)
        y = np.empty_like(x)
        keys = np.empty((BANDS, len(part)), np.uint64)
        for band in range(BANDS):
            key = np.full(len(part), band + 1, np.uint64)
            for k in range(band * ROWS, (band + 1) * ROWS):
                np.bitwise_xor(x, flips[k], out=y)
                np.multiply(y, factors[k], out=y)
                key = (key ^ np.minimum.reduceat(y, starts)) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
            keys[band] = key
        for i, row in zip(part, np.ascontiguousarray(keys.T)):
            out[i] = row.tobytes()
        at = to
    return out


def sketches(docs: DataFrame, n: int = 5) -> DataFrame:
    """doc_id, sid (names the set), size (of the set), fp (its SimHash) and keys (packed)."""

    def run(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        sets = [shingles(t, n) for t in texts(batch, "text")]
        sid = np.array([set_id(s) for s in sets], np.uint64).view(np.int64)
        arrays = [batch.column("doc_id").cast(pa.int64()), pa.array(sid), pa.array([len(s) for s in sets], pa.int64()),
                  pa.array([simhash.signed(fingerprint(s)) for s in sets], pa.int64()), pa.array(band_keys(sets), pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "sid", "size", "fp", "keys"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, sid long, size long, fp long, keys binary", 4 << 20)


def proposals(by_set: DataFrame) -> DataFrame:
    """Edges a, b that connect all sets which SimHash or a common band key brings together."""
    return near_prints(by_set).unionByName(common_bands(by_set)).distinct()


def near_prints(by_set: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges a, b that connect all sets whose fingerprints are within ``radius`` bits; an empty set needs none."""
    full = by_set.where("size > 0").select("fp", "sid")
    # a fingerprint is named by the smallest of its sets
    name = cut_lineage(full.groupBy("fp").agg(F.min("sid").alias("a")))
    equal = full.join(name, "fp").where("sid <> a").select("a", F.col("sid").alias("b"))
    met = simhash.links(name.select("fp"), radius)
    near = met.join(name.select(F.col("fp").alias("a"), F.col("a").alias("_a")), "a").join(name.select(F.col("fp").alias("b"), F.col("a").alias("_b")), "b")
    return equal.unionByName(near.select(F.col("_a").alias("a"), F.col("_b").alias("b")))


def common_bands(by_set: DataFrame) -> DataFrame:
    """Edges a, b that connect all sets with a common band key."""

    def run(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        keys = [np.frombuffer(k, np.int64) for k in batch.column("keys").to_pylist()]
        sid = np.repeat(batch.column("sid").to_numpy(), [len(k) for k in keys])
        key = np.concatenate(keys) if keys else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(sid)], ["key", "sid"])

    spread = map_arrow(by_set.select("sid", "keys"), run, "key long, sid long")
    shared = spread.groupBy("key").agg(F.min("sid").alias("a"), F.max("sid").alias("z")).where("a < z").select("key", "a")
    return spread.join(shared, "key").where("sid <> a").select("a", F.col("sid").alias("b"))


def sets_of(docs: DataFrame, wanted: DataFrame, n: int = 5) -> DataFrame:
    """sid and grams (packed) of the sets whose ``sid`` is in ``wanted``, and of few others; each once."""
    place = F.pmod("sid", F.lit(FILTER))
    rows = wanted.select(F.shiftright(place, 3).alias("at"), F.expr(f"shiftleft(1, cast(pmod(sid, {FILTER}) % 8 as int))").alias("bit"))
    found = rows.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    known = np.zeros(FILTER >> 3, np.uint8)
    known[found["at"].to_numpy()] = found["bits"].to_numpy()

    def run(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        ids, grams = [], []
        for text in texts(batch, "text"):
            s = shingles(text, n)
            sid = set_id(s)
            at = sid % FILTER
            if known[at >> 3] >> (at & 7) & 1:
                ids.append(sid)
                grams.append(s.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.uint64).view(np.int64)), pa.array(grams, pa.binary())], ["sid", "grams"])

    return map_arrow(docs.select("text"), run, "sid long, grams binary").groupBy("sid").agg(F.first("grams").alias("grams"))


def forest(sids: list[int], sets: list[np.ndarray], least: tuple[int, int]) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct sets, found over their shared shingles."""
    p, q = least
    sizes = np.array([len(s) for s in sets], np.int64)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)[np.argsort(ids, kind="stable")]
    border = np.concatenate([[0], np.cumsum(np.bincount(ids))])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    out, outside = [], np.ones(len(sets), bool)
    for first in range(len(sets)):
        front = [first] if outside[first] else []
        outside[first] = False
        while front:
            x = front.pop()
            mine = ids[starts[x] : starts[x + 1]]
            counts = border[mine + 1] - border[mine]
            at = np.repeat(border[mine] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            common = np.bincount(owner[at], minlength=len(sets))
            near = np.flatnonzero(outside & (common > 0) & ((p + q) * common >= p * (sizes[x] + sizes)))
            outside[near] = False
            out += [(sids[x], sids[y]) for y in near]
            front += near.tolist()
    return out


def links(docs: DataFrame, by_set: DataFrame, least: tuple[int, int] = (4, 5), n: int = 5, most: int = 1 << 22) -> DataFrame:
    """Links a, b between sets: enough of those with the least similarity to keep the components."""
    spark = docs.sparkSession
    groups = cut_lineage(components(proposals(by_set)).withColumnRenamed("node", "sid"))
    weight = groups.join(by_set.select("sid", "size"), "sid").groupBy("root").agg(F.ceil(F.sum("size") / most).alias("blocks"))
    placed = cut_lineage(groups.join(weight, "root"))
    block = F.pmod(F.xxhash64("sid"), "blocks")
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: F.struct(F.least(k, "block").alias("i"), F.greatest(k, "block").alias("j")))
    sent = sets_of(docs, placed.select("sid"), n).join(placed, "sid").withColumn("block", block)
    sent = sent.select("root", "sid", "grams", F.explode(pairs).alias("p")).select("root", "p.i", "p.j", "sid", "grams")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            found = forest(sids, sets, least) if len(sids) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        group, sids, sets = None, [], []
        for batch in bytes_batches(batches):
            for root, i, j, sid, grams in zip(*(c.to_pylist() for c in batch.columns)):
                if group != (root, i, j):
                    yield done()
                    group, sids, sets = (root, i, j), [], []
                sids.append(sid)
                sets.append(np.frombuffer(grams, np.uint64))
        yield done()

    found = sent.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(run, "a long, b long")
    found = cut_lineage(found)
    release(spark, groups, placed)
    return found


def near_copies(docs: DataFrame, least: tuple[int, int] = (4, 5), n: int = 5, most: int = 1 << 22) -> DataFrame:
    """doc_id and component_id, the smallest doc_id reachable by links of similarity ``least`` (a fraction) or more."""
    spark = docs.sparkSession
    marked = cut_lineage(sketches(docs, n))
    by_set = cut_lineage(marked.groupBy("sid").agg(F.min("doc_id").alias("low"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("keys").alias("keys")))
    roots = components(links(docs, by_set, least, n, most))
    linked = cut_lineage(by_set.select("sid", "low").join(roots.withColumnRenamed("node", "sid"), "sid"))
    lows = linked.groupBy("root").agg(F.min("low").alias("best"))
    best = linked.join(lows, "root").select("sid", "best")
    ids = cut_lineage(by_set.join(best, "sid", "left").select("sid", F.coalesce("best", "low").alias("component_id")))
    release(spark, linked, by_set)
    # a set shared by very many rows is a skewed key here; the join splits it
    return marked.select("doc_id", "sid").join(ids, "sid").select("doc_id", "component_id")


def keep_first(docs: DataFrame, least: tuple[int, int] = (4, 5), n: int = 5) -> DataFrame:
    """The documents with the smallest id of their component; rows as in ``simhash.keep_first``."""
    return firsts(docs, near_copies(docs, least, n))
