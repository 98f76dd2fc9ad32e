"""Best-fit packing of documents into sequences, under conflicts.

Method: items go to shards of bounded size by a hash of their place, so that a hot source or a large group of copies
is spread evenly; bins do not cross shards. In a shard, items come longest first. Open bins are ordered by
residual (a bitmap of the residuals in use finds the successor of a length at once), and bins of one residual
by the bitmap of their sources. The search takes the smallest residual that fits, passes over groups whose
source bitmap, and bins whose cluster bitmap, holds the item's bit, and goes on to the next residual until the
tightest compatible bin is found; only then is a new bin opened.

A document longer than a bin is cut into full pieces, each a bin of its own, and a rest that is packed.

Cases: null or empty text has no words and gets no bin (bin and start are null); null source is a source of its own;
equal items go by id, then by place; repeated rows are items of their own and copies of each other; a row without an
id is packed; an empty table gives no rows; other columns of the input are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import words

#: Items of a shard, about.
SHARD = 8192
PLACED = "doc_id long, piece int, n_words long, bin long, start long"


def items(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, source, cluster (of texts with the same words), place."""
    df = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("\0")).alias("source"), words(F.col("text")).alias("w"))
    return cut_lineage(df.select("doc_id", F.size("w").cast("long").alias("n_words"), "source", F.xxhash64(F.array_join("w", " ")).alias("cluster")))


class Bins:
    """Open bins of one shard."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.used = 0  # bit r: a bin with residual r is open
        self.by_residual: list[dict[int, list[int]]] = [{} for _ in range(capacity + 1)]
        self.residual: list[int] = []
        self.clusters: list[int] = []

    def place(self, n: int, source: int, cluster: int) -> tuple[int, int]:
        """Bin and start of an item of ``n`` words; ``source`` and ``cluster`` are bits (0: no conflict possible)."""
        above = self.used >> n
        r = n
        while above:
            skip = (above & -above).bit_length() - 1
            r += skip
            groups = self.by_residual[r]
            for sources, bins in groups.items():
                if not sources & source:
                    for k, b in enumerate(bins):
                        if not self.clusters[b] & cluster:
                            del bins[k]
                            if not bins:
                                del groups[sources]
                                if not groups:
                                    self.used ^= 1 << r
                            self.put(b, r - n, sources | source, cluster)
                            return b, self.capacity - r
            above >>= skip + 1
            r += 1
        self.residual.append(self.capacity)
        self.clusters.append(0)
        b = len(self.residual) - 1
        self.put(b, self.capacity - n, source, cluster)
        return b, 0

    def put(self, b: int, r: int, sources: int, cluster: int) -> None:
        self.residual[b] = r
        self.clusters[b] |= cluster
        if r:
            self.by_residual[r].setdefault(sources, []).append(b)
            self.used |= 1 << r


def pack_shard(rows: pa.Table, capacity: int, first_bin: int) -> pa.RecordBatch:
    """Placements of one shard's items, which come longest first."""
    ids, sizes, sources, clusters = (rows[c].to_pylist() for c in ("doc_id", "n_words", "source", "cluster"))
    bit = {s: 1 << k for k, s in enumerate(dict.fromkeys(sources))}
    seen = dict(zip(*(x.tolist() for x in np.unique(np.array(clusters, np.int64), return_counts=True))))
    shared = {c: 1 << k for k, c in enumerate(c for c, n in seen.items() if n > 1)}
    out: list[tuple] = []
    whole = 0
    rests = []
    for i, n in enumerate(sizes):
        for piece in range(n // capacity):
            out.append((ids[i], piece, capacity, -1 - whole, 0))
            whole += 1
        if n % capacity:
            rests.append((n % capacity, i))
    rests.sort(key=lambda x: -x[0])  # stable: equal rests stay in the order of the items
    bins = Bins(capacity)
    for n, i in rests:
        b, start = bins.place(n, bit[sources[i]], shared.get(clusters[i], 0))
        out.append((ids[i], sizes[i] // capacity, n, b, start))
    # full pieces take the numbers after the shared bins
    base = len(bins.residual)
    out = [(d, p, n, first_bin + (b if b >= 0 else base - 1 - b), s) for d, p, n, b, s in out]
    out += [(ids[i], 0, 0, None, None) for i, n in enumerate(sizes) if not n]
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["doc_id", "piece", "n_words", "bin", "start"])


def pack(docs: DataFrame, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, n_words, bin, start: a row per document, or per piece of one longer than a bin."""
    found = items(docs)
    shards = max(1, -(-found.count() // SHARD))
    placed = found.withColumn("place", F.monotonically_increasing_id()).withColumn("shard", F.pmod(F.xxhash64("place"), F.lit(shards)).cast("int"))
    # the table of items is small beside the texts; a shard is a bounded number of them
    dealt = placed.repartition("shard").sortWithinPartitions("shard", F.desc("n_words"), F.asc_nulls_last("doc_id"), "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None
        for batch in batches:
            keys = batch.column("shard").to_numpy()
            cuts = np.flatnonzero(np.diff(keys)) + 1
            for a, z in zip([0, *cuts], [*cuts, batch.num_rows]):
                if a == z:
                    continue
                if held and keys[a] != at:
                    yield pack_shard(pa.Table.from_batches(held), capacity, int(at) << 32)
                    held = []
                at = keys[a]
                held.append(batch.slice(a, z - a))
        if held:
            yield pack_shard(pa.Table.from_batches(held), capacity, int(at) << 32)

    return dealt.mapInArrow(run, PLACED)
