"""Repeated word sequences across documents by prefix-partitioned suffix trees.

A *suffix* is a position with at least ``window`` words after it. One is removable if its first ``window``
words also start in a document with a smaller id; words covered by a removable window are removed.

Method, in three jobs:

1. Candidates. Equal windows hold equal smallest five-word hashes ("anchors"), and neighbouring windows
   mostly share one, so a document gives about one anchor row per five words. Only windows whose anchor
   occurs in two documents can repeat. Anchors are combined within a batch before the shuffle: one row per
   batch stands for all of its documents, the others go to keys of their own.
2. Trees. A run of candidate windows with one anchor is a stretch of text that is shuffled once for all its
   suffixes, and once for all documents of a batch that share it. The anchor is the five-word prefix by which stretches are grouped; the tree of a group is cut at depth
   ``window`` and streamed in order of document ids, so the first visit of a node that deep is its smallest
   document and later ones are removable: memory holds the nodes of one group. Groups of more than ``GROUP`` stretches
   are split by longer prefixes: their suffixes are range-partitioned by their words, with bounds of as many
   words as equal shares take, and a path shared by very many documents is cut further by document id. There the
   suffixes come sorted; only the first and last path of a part can go on in another part, and these few paths are
   settled together afterwards. Windows are always compared by their words, not by hashes.
3. Removal. The removable positions of a document go back to its text.

Neither a document's nor a path's rows are gathered beyond the length of one document.

Cases: null or empty text has no windows; a document without an id removes nothing and loses nothing;
repeated rows get the same result each, as only smaller ids count; rows that share an id but not the text
are told apart; an empty table gives no rows; other columns of the input keep their values and are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from ..session import cut_lineage
from .common import bytes_batches, map_arrow, release, texts

#: Words of an anchor.
ANCHOR = 5
#: Windows of a run, at most.
RUN = 64
#: Stretches of a group that one task takes whole.
GROUP = 20_000
#: Bytes of text that one task works on at once.
STEP = 4 << 20


class WordHashes(dict):
    """Hash of a word, remembered for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxh64_intdigest(word)
        return h


HASHES = WordHashes()


def anchors(docs: list[list[bytes]], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: anchor, document, first window, number of windows."""
    size = np.fromiter(map(len, docs), np.int64, len(docs))
    total, width = int(size.sum()), window - ANCHOR + 1
    none = np.zeros(0, np.int64)
    if total < window:
        return none.astype(np.uint64), none, none, none
    h = np.fromiter(map(HASHES.__getitem__, chain.from_iterable(docs)), np.uint64, total)
    gram = np.zeros(total - ANCHOR + 1, np.uint64)
    for k in range(ANCHOR):
        gram = gram * np.uint64(0x9E3779B97F4A7C15) + h[k : total - ANCHOR + 1 + k]
    gram ^= gram >> np.uint64(29)
    gram *= np.uint64(0xBF58476D1CE4E5B9)
    gram ^= gram >> np.uint64(32)
    low, have = gram, 1
    while have < width:  # smallest of ``width`` neighbours, by doubling
        step = min(have, width - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    first = np.cumsum(size) - size
    doc = np.repeat(np.arange(len(docs)), size)[: len(low)]
    at = np.arange(len(low)) - first[doc]
    inside = at + window <= size[doc]
    low, doc, at = low[inside], doc[inside], at[inside]
    if not len(low):
        return none.astype(np.uint64), none, none, none
    new = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])]))
    # a text of few words in a circle has one anchor for very many windows
    into = np.arange(len(low)) - np.repeat(new, np.diff(np.append(new, len(low))))
    new = np.flatnonzero(into % RUN == 0)
    return low[new], doc[new], at[new], np.diff(np.append(new, len(low)))


def anchor_rows(docs: DataFrame, window: int) -> DataFrame:
    """anchor, salt, rid, start, n, multi: one row with salt 0 per anchor and batch (more only within one document)."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rid = batch.column("rid").to_numpy(zero_copy_only=False)
        a, d, s, n = anchors([t.split() for t in texts(batch, "text")], window)
        order = np.lexsort((s, d, a))
        a, d, s, n = a[order], d[order], s[order], n[order]
        multi, salt = np.zeros(len(a), bool), np.zeros(len(a), np.int32)
        if len(a):
            start = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
            count = np.diff(np.append(start, len(a)))
            several = np.minimum.reduceat(d, start) < np.maximum.reduceat(d, start)
            multi = np.repeat(several, count)
            # the others are known to repeat; they only need to be spread
            salt = np.where(multi, 1 + (d * 31 + s) % 1_000_003, 0).astype(np.int32)
            salt[start] = 0
        yield pa.RecordBatch.from_arrays(
            [pa.array(a.view(np.int64)), pa.array(salt), pa.array(rid[d]), pa.array(s.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(multi)],
            ["anchor", "salt", "rid", "start", "n", "multi"],
        )

    return map_arrow(docs.select("rid", "text"), run, "anchor long, salt int, rid long, start int, n int, multi boolean", STEP)


def candidates(docs: DataFrame, window: int) -> DataFrame:
    """rid, runs: the windows of each document whose anchor occurs in another document."""
    rows = anchor_rows(docs, window)
    same = Window.partitionBy("anchor", "salt")
    met = rows.select(
        "rid", "anchor", "start", "n", "multi", (F.min("rid").over(same) < F.max("rid").over(same)).alias("two"), F.max("multi").over(same).alias("known")
    )
    return met.where("multi or two or known").groupBy("rid").agg(F.collect_list(F.struct("anchor", "start", "n")).alias("runs"))


def stretches(docs: DataFrame, runs: DataFrame, window: int) -> DataFrame:
    """The words of every candidate run: anchor, doc_id, rid, start, words, others.

    Equal stretches of a batch are one row: that of the smallest document, with the others' doc_id, rid and
    start packed as whole numbers.
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        runs = batch.column(batch.schema.get_field_index("runs"))
        count = pc.list_value_length(runs).to_numpy()
        anchor, start, n = (runs.flatten().field(i).to_numpy() for i in range(3))
        ends, to = np.cumsum(count), (start + n + window - 1).tolist()
        starts, out = start.tolist(), []
        for text, a, z in zip(texts(batch, "text"), ends - count, ends):
            w = text.split()
            out += [b" ".join(w[i:j]) for i, j in zip(starts[a:z], to[a:z])]
        words = pa.array(out, pa.binary()).dictionary_encode()
        doc, rid = (np.repeat(batch.column(batch.schema.get_field_index(c)).to_numpy(), count) for c in ("doc_id", "rid"))
        which = words.indices.to_numpy()
        order = np.lexsort((start, rid, doc, which))
        first = np.append(np.flatnonzero(np.diff(which[order], prepend=-1)), len(order))
        packed = np.stack([doc, rid, start], axis=1).astype("<i8")[order]
        rest = np.ones(len(order), bool)
        rest[first[:-1]] = False
        sizes = np.concatenate([[0], np.cumsum(np.diff(first) - 1)]) * 24
        others = pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer(sizes.astype(np.int32)), pa.py_buffer(packed[rest].tobytes())])
        lead = order[first[:-1]]
        cols = [pa.array(c[lead]) for c in (anchor, doc, rid, start)]
        yield pa.RecordBatch.from_arrays([*cols, words.dictionary.take(pa.array(which[lead])).cast(pa.string()), others], ["anchor", "doc_id", "rid", "start", "words", "others"])

    schema = "anchor long, doc_id long, rid long, start int, words string, others binary"
    return map_arrow(docs.select("doc_id", "rid", "text").join(runs, "rid"), run, schema)


def places(doc: int, rid: int, start: int, others: bytes) -> list[tuple[int, int, int]]:
    """doc_id, rid, start of all stretches that a row stands for."""
    if not others:
        return [(doc, rid, start)]
    return [(doc, rid, start), *map(tuple, np.frombuffer(others, "<i8").reshape(-1, 3).tolist())]


def trees(found: DataFrame, window: int) -> DataFrame:
    """Removable suffixes of groups that one task takes whole: doc_id, rid, pos."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, nodes = None, {}
        for batch in bytes_batches(batches, STEP):
            out: tuple[list, list, list] = ([], [], [])
            for a, doc, rid, start, words, others in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if a != anchor:
                    anchor, nodes = a, {}
                w = words.split(" ")
                lows = [nodes.setdefault(" ".join(w[i : i + window]), doc) for i in range(len(w) - window + 1)]
                for d, r, s in places(doc, rid, start, others):
                    for i, low in enumerate(lows):
                        if low < d:
                            out[0].append(d)
                            out[1].append(r)
                            out[2].append(s + i)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, (pa.int64(), pa.int64(), pa.int32()))], ["doc_id", "rid", "pos"])

    dealt = found.select("anchor", "doc_id", "rid", "start", "words", "others").repartition("anchor").sortWithinPartitions("anchor", "doc_id")
    return dealt.mapInArrow(run, "doc_id long, rid long, pos int")


def suffixes(found: DataFrame, window: int) -> DataFrame:
    """words (cut after ``window``), doc_id, rid, pos of every suffix of the given stretches."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out: tuple[list, list, list, list] = ([], [], [], [])
        for doc, rid, start, words, others in zip(*(batch.column(i).to_pylist() for i in range(5))):
            w = words.split(" ")
            paths = [" ".join(w[i : i + window]) for i in range(len(w) - window + 1)]
            for d, r, s in places(doc, rid, start, others):
                out[0].extend(paths)
                out[1].extend([d] * len(paths))
                out[2].extend([r] * len(paths))
                out[3].extend(range(s, s + len(paths)))
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], ["words", "doc_id", "rid", "pos"])

    return map_arrow(found.select("doc_id", "rid", "start", "words", "others"), run, "words string, doc_id long, rid long, pos int", STEP)


def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walk the tree of one sorted part; memory holds one batch and one path.

    Gives the removable suffixes, with null words, and all suffixes of the part's first and last path, with
    their words and ``removable`` left open.
    """
    path: str | None = None  # the path that goes on from the batch before
    first = True  # that path is the part's first
    held: list[pa.RecordBatch] = []  # rows of the last path in sight, which may be the part's last
    low = 0

    def settled(rows: pa.RecordBatch, keep: pa.Array) -> pa.RecordBatch:
        rows = rows.filter(keep)
        return rows.set_column(0, "words", pa.nulls(rows.num_rows, pa.string()))

    for rows in batches:
        if not rows.num_rows:
            continue
        w = rows.column("words")
        new = np.ones(rows.num_rows, bool)
        new[1:] = pc.not_equal(w[1:], w[:-1]).to_numpy(zero_copy_only=False)
        new[0] = w[0].as_py() != path
        start = np.flatnonzero(new)
        doc = rows.column("doc_id").to_numpy()
        ends = np.append(start, rows.num_rows)
        if not new[0]:
            part = rows.slice(0, ends[0])
            if first:
                yield part  # an open path is passed on at once, so a long one needs no memory
            else:
                held.append(part)
                if sum(h.num_rows for h in held) > 100_000:  # settled but for its first rows, which stand for it
                    big = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    yield settled(big.slice(1), pa.array(big.column("doc_id").to_numpy()[1:] > low))
                    held = [big.slice(0, 1)]
        if len(start):
            if path is not None and not first:
                for h in held:
                    yield settled(h, pa.array(h.column("doc_id").to_numpy() > low))
            begins_part = path is None
            # paths that begin and end within this batch
            lows = doc[start]
            group = np.cumsum(new) - 1
            inner = np.zeros(rows.num_rows, bool)
            lo = ends[1] if begins_part and len(start) > 1 else start[0]
            hi = start[-1]
            if hi > lo:
                inner[lo:hi] = doc[lo:hi] > lows[group[lo:hi]]
                yield settled(rows, pa.array(inner))
            if begins_part and len(start) > 1:
                yield rows.slice(0, ends[1])
            path = w[int(start[-1])].as_py()
            first = begins_part and len(start) == 1
            last = rows.slice(int(start[-1]))
            low = int(lows[-1])
            held = []
            if first:
                yield last
            else:
                held = [last]
    if path is not None and not first:
        yield from held


def removable(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, rid, pos of every removable window."""
    spark = docs.sparkSession
    runs = cut_lineage(candidates(docs, window))
    release(spark, shuffles=True)
    found = cut_lineage(stretches(docs, runs, window))
    release(spark, runs, shuffles=True)
    large = cut_lineage(found.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > GROUP).select("anchor"))
    small = cut_lineage(trees(found.join(large, "anchor", "left_anti"), window))
    # the range partitioning samples its input, so that is written first
    cut = cut_lineage(suffixes(found.join(large, "anchor", "left_semi"), window))
    release(spark, found, large)
    order = ["words", "doc_id", "rid", "pos"]
    walked = cut_lineage(cut.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(walk, "words string, doc_id long, rid long, pos int"))
    release(spark, cut, shuffles=True)
    lows = walked.where("words is not null").groupBy("words").agg(F.min("doc_id").alias("low"))
    late = walked.join(lows, "words").where("doc_id > low")
    parts = [small, walked.where("words is null"), late]
    return parts[0].union(parts[1].select("doc_id", "rid", "pos")).union(parts[2].select("doc_id", "rid", "pos"))


def with_removals(docs: DataFrame, window: int) -> DataFrame:
    """The documents with column ``__mcid_pos``: positions of their removable windows, or null."""
    docs = docs.withColumn("__mcid_rid", F.xxhash64("doc_id", "text"))
    known = docs.where("doc_id is not null").select("doc_id", "text", F.col("__mcid_rid").alias("rid"))
    found = cut_lineage(removable(known, window).groupBy("doc_id", "rid").agg(F.collect_set("pos").alias("__mcid_pos")))
    release(docs.sparkSession, shuffles=True)
    found = found.select(F.col("doc_id").alias("__mcid_doc"), F.col("rid").alias("__mcid_r"), "__mcid_pos")
    return docs.join(found, (F.col("__mcid_rid") == F.col("__mcid_r")) & (F.col("doc_id") == F.col("__mcid_doc")), "left").drop("__mcid_doc", "__mcid_r", "__mcid_rid")


def gone(pos: list[int] | None, n: int, window: int) -> np.ndarray:
    """Flags of the words that removable windows cover."""
    edge = np.zeros(n + 1, np.int64)
    if pos:
        p = np.array(pos)
        np.add.at(edge, p, 1)
        np.add.at(edge, p + window, -1)
    return np.cumsum(edge)[:n] > 0


def digests(docs: DataFrame, window: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space)."""

    def run(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        size, lost, sha = [], [], []
        for text, pos in zip(texts(batch, "text"), batch.column(batch.schema.get_field_index("__mcid_pos")).to_pylist()):
            w = text.split()
            size.append(len(w))
            out = gone(pos, len(w), window)
            lost.append(int(out.sum()))
            kept = w if not pos else [x for x, o in zip(w, out) if not o]
            sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), pa.array(size, pa.int64()), pa.array(lost, pa.int64()), pa.array(sha, pa.string())],
            ["doc_id", "n_words", "n_removed", "kept_sha256"],
        )

    found = with_removals(docs.select("doc_id", "text"), window)
    return map_arrow(found, run, "doc_id long, n_words long, n_removed long, kept_sha256 string", STEP)


def cut_text(text: bytes, pos: list[int], window: int) -> bytes:
    """The text without its removed words; what stands between kept words stays as it is."""
    spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)]
    out, kept, at = gone(pos, len(spans), window), [], 0
    for i in np.flatnonzero(np.diff(np.concatenate([[0], out.astype(np.int8)])) == 1):
        j = i + int(np.argmin(np.append(out[i:], False)))
        kept.append(text[at : spans[i][0]])
        at = spans[j][0] if j < len(spans) else len(text)
    return b"".join([*kept, text[at:]])


def remove_repeats(docs: DataFrame, window: int = 13) -> DataFrame:
    """The documents with repeated words removed from ``text`` (and ``n_chars`` corrected); those left without a word go."""

    names = docs.columns

    def run(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        pos = batch.column(batch.schema.get_field_index("__mcid_pos")).to_pylist()
        changed = [None if not p else cut_text(t, p, window) for t, p in zip(texts(batch, "text"), pos)]
        keep = pa.array([c is None or bool(c.strip()) for c in changed])
        cols = [batch.column(i) for i in range(len(names))]
        text = names.index("text")
        cols[text] = pa.array([old if new is None else new.decode() for old, new in zip(cols[text].to_pylist(), changed)], pa.string())
        if "n_chars" in names:
            i = names.index("n_chars")
            cols[i] = pa.array([old if new is None else len(new.decode()) for old, new in zip(cols[i].to_pylist(), changed)], cols[i].type)
        yield pa.RecordBatch.from_arrays(cols, names).filter(keep)

    found = with_removals(docs, window)
    return map_arrow(found, run, T.StructType(docs.schema.fields), STEP)
