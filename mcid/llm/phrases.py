"""Phrase collocations by Toivonen's sampling: a sample proposes, full passes decide.

Phrases of 1 to ``longest`` words that occur ``least`` times or more are wanted ("frequent"), with exact counts.

* A sample of the documents is mined first, level by level, at a lowered bound. Its phrases are the proposal.
* A full pass counts every phrase whose two parts - all but the last, all but the first word - are proposed: the
  proposal and its negative border, which is never written out. Words are always counted. The border is large and
  nearly all of it rare, so it is shuffled as digests: a digest's total bounds the counts of its phrases from above.
* A phrase outside the proposal that is, or by its digest may be, frequent is a border failure: longer ones that
  start from it may have been missed. Then all such phrases are added to the proposal, and an expansion pass counts
  what only now has both parts in it, and the phrases of the frequent digests by their words. Few phrases are new
  to it, so it takes them as proposed at once and goes on to longer ones. A proposal that was not mined (an empty
  sample) is expanded by one length a pass. In the end every frequent phrase was counted: its parts are frequent, so
  proposed or taken as proposed.

The proposal travels as a bitmap of fixed size (:mod:`members`). It may hold a phrase by mistake, which makes a
pass count more, never less and never wrongly; so the broadcast is bounded whatever the number of phrases.

Within a batch, words and phrases are numbered by dictionaries, a phrase being the number of its first part and
its last word; no hash decides what is equal. A batch sends each of its phrases once with its count, and counts
meet again before the shuffle, so a word that is a third of the text is one row per batch.

Scores are exact in 38 decimal digits: ``1000 * a * n`` fits while occurrences are below 10 ** 17.

Cases: null text counts as empty, a null language as ``und``; repeated rows count each; an empty table gives no
rows; other columns are not read. A text is one row and must fit in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ..session import cut_lineage
from .common import map_arrow, release, texts
from .members import LOG_BITS, bitmap, holds, packed, unpacked

#: Ends of pieces, and what each byte becomes: a byte that UTF-8 never has, a space, a letter in lower case.
ENDS = b".,;:!?\n\x0b\x0c\r"
CUT = 0xFF
TABLE = bytes(CUT if b in ENDS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
FACTOR = np.uint64(0x9E3779B97F4A7C15)
COUNTS = "lang string, phrase string, h long, n long"


class Words:
    """The words of a batch of texts in one language: numbers, pieces, names and hashes."""

    def __init__(self, lang: str, bodies: list[bytes]) -> None:
        cut = bytes([CUT])
        data = cut.join(bodies).translate(TABLE).replace(cut, b" " + cut + b" ")
        offsets = pa.py_buffer(np.array([0, len(data)], np.int32).tobytes())
        whole = pa.Array.from_buffers(pa.string(), 1, [None, offsets, pa.py_buffer(data)])
        coded = pc.split_pattern(whole, " ").values.dictionary_encode()
        ids, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary.cast(pa.binary())
        nothing, end = (pc.index(names, pa.scalar(w, pa.binary())).as_py() for w in (b"", cut))
        ids = ids[ids != nothing]
        ends = ids == end
        self.piece = np.cumsum(ends)[~ends]
        self.ids = ids[~ends]
        self.names = names
        start = lang.encode() + b"\0"
        self.hashes = np.fromiter((xxh64_intdigest(start + w) for w in names.to_pylist()), np.uint64, len(names))


def phrases(
    words: Words, new: np.ndarray | None, old: np.ndarray | None, asked: np.ndarray | None, longest: int, digests: bool
) -> Iterator[tuple[pa.Array | None, np.ndarray, np.ndarray]]:
    """Names (None: of the border, by digest only), hashes and counts of what a pass with the proposal ``new`` counts and one
    with ``old`` did not, and of the phrases in ``asked``, of which that one only counted digests. With ``asked``, what is
    counted is taken as proposed.

    Proposals are bitmaps; None stands for none, with which nothing longer than a word is counted.
    """
    n, nothing = len(words.names), np.zeros(len(words.names), bool)
    names, hashes = words.names, words.hashes
    was = nothing if old is None else holds(old, hashes)
    if old is None:
        counts = np.bincount(words.ids, minlength=n)
        some = np.flatnonzero(counts)
        yield names.take(pa.array(some)), hashes[some], counts[some]
    # per position, the phrase that starts there; -1 where it is not proposed
    proposed = nothing if new is None else holds(new, hashes)
    at = np.where(proposed[words.ids], words.ids, -1) if n else words.ids
    for size in range(2, longest + 1):
        left, right = at[:-1], at[1:]
        last = size - 1
        both = np.flatnonzero((left >= 0) & (right >= 0))
        both = both[both + last < len(words.ids)]
        both = both[words.piece[both] == words.piece[both + last]]
        if not len(both):
            return
        coded = pa.array(left[both] << 32 | words.ids[both + last]).dictionary_encode()
        keys, codes = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        first = np.zeros(len(keys), np.int64)
        first[codes[::-1]] = both[::-1]
        head, tail = keys >> 32, keys & 0xFFFFFFFF
        reached = was[head] & was[at[first + 1]]
        fresh = ~reached
        counts = np.bincount(codes, minlength=len(keys))
        hashes = hashes[head] * FACTOR + words.hashes[tail]
        proposed = holds(new, hashes)
        # a phrase that the other pass did not come to led it nowhere, even if its bitmap held it by mistake
        held = np.zeros(len(keys), bool) if old is None else holds(old, hashes)
        was = reached & held
        if asked is not None:
            fresh |= holds(asked, hashes) & ~held
            proposed |= fresh
        named = np.flatnonzero(fresh & proposed if digests else fresh)
        # only phrases that are given by name, or that longer ones start from, need one
        shown = np.flatnonzero(proposed | fresh & (not digests))
        spelled = pc.binary_join_element_wise(names.take(pa.array(head[shown])), words.names.take(pa.array(tail[shown])), pa.scalar(b" ", pa.binary()))
        place = np.full(len(keys), -1, np.int64)
        place[shown] = np.arange(len(shown))
        yield spelled.take(pa.array(place[named])), hashes[named], counts[named]
        if digests:
            rest = np.flatnonzero(fresh & ~proposed)
            yield None, hashes[rest], counts[rest]
        # longer phrases start from proposed ones alone, so codes are places among the spelled
        names, hashes, was = spelled, hashes[shown], was[shown]
        at = np.full(len(at) - 1, -1, np.int64)
        at[both] = np.where(proposed[codes], place[codes], -1)


class Proposal:
    """A bitmap, or none, on its way to the tasks."""

    def __init__(self, spark: SparkSession, bits: np.ndarray | None) -> None:
        self.words = 0 if bits is None else len(bits)
        self.sent = spark.sparkContext.broadcast(b"" if bits is None else packed(bits))

    def bits(self) -> np.ndarray | None:
        return unpacked(self.sent.value, self.words) if self.words else None

    def drop(self) -> None:
        """Take it off the executors, once the tables made with it are written."""
        self.sent.destroy(blocking=True)


def count(docs: DataFrame, new: Proposal, old: Proposal, asked: Proposal, longest: int, digests: bool = False) -> DataFrame:
    """Counts of what one pass counts: exact for phrases; with ``digests``, the border has no phrase and counts of digests.

    With no ``old``, an empty phrase holds the number of words of each language.
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        langs = np.array(batch.column(0).to_pylist(), object)
        bodies, now, before, some = texts(batch, "text"), new.bits(), old.bits(), asked.bits()
        for lang in sorted(set(langs.tolist())):
            words = Words(lang, [bodies[k] for k in np.flatnonzero(langs == lang)])
            if before is None:
                yield rows(lang, pa.array([b""]), np.zeros(1, np.uint64), np.array([len(words.ids)]))
            for names, h, n in phrases(words, now, before, some, longest, digests):
                yield rows(lang, names, h, n)
        pa.default_memory_pool().release_unused()

    def rows(lang: str, names: pa.Array | None, h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        if names is None:
            fixed = [pa.nulls(len(n), pa.string()), pa.nulls(len(n), pa.string())]
        else:
            fixed = [pa.array([lang], pa.string()).take(pa.array(np.zeros(len(n), np.int64))), names.cast(pa.string())]
        return pa.record_batch([*fixed, pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=[f.split()[0] for f in COUNTS.split(", ")])

    found = map_arrow(docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text"), run, COUNTS, most=2 << 20)
    size = F.when(F.col("phrase") == "", 0).otherwise(1 + F.length("phrase") - F.length(F.replace("phrase", F.lit(" "))))
    return found.groupBy("lang", "phrase", "h").agg(F.sum("n").alias("n")).withColumn("size", size)


def outside(found: DataFrame, proposal: Proposal, longest: int) -> DataFrame:
    """The phrases of ``found`` that a proposal does not hold, if a longer one can start from them."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        bits = proposal.bits()
        yield batch if bits is None else batch.filter(pa.array(~holds(bits, batch.column(0).to_numpy().view(np.uint64))))

    return map_arrow(found.where(F.col("size").between(1, longest - 1)).select("h"), run, "h long")


def mine(docs: DataFrame, least: float, longest: int, proposal: np.ndarray | None = None, log_bits: int = LOG_BITS) -> tuple[list[DataFrame], np.ndarray | None]:
    """All frequent phrases, one table per pass (lang, phrase, size, h, n), and the last proposal."""
    spark = docs.sparkSession
    passes: list[DataFrame] = []
    old: np.ndarray | None = None
    asked: np.ndarray | None = None
    while True:
        sent = now, before, some = [Proposal(spark, bits) for bits in (proposal, old, asked)]
        digests = proposal is not None and old is None
        counted = cut_lineage(count(docs, now, before, some, longest, digests).where((F.col("size") == 0) | (F.col("n") >= least)))
        frequent, border = counted.where("phrase IS NOT NULL"), counted.where("phrase IS NULL")
        passes.append(frequent)
        # a pass that takes as proposed what it counts has followed all of it to the end
        closed = asked is not None or border.isEmpty() and outside(frequent, now, longest).isEmpty()
        for p in sent:
            p.drop()
        if closed:
            return passes, proposal
        asked = bitmap(border, log_bits) if digests else None
        more = bitmap(frequent.where(F.col("size").between(1, longest - 1)).select("h").unionByName(border.select("h")), log_bits)
        # nothing was counted beyond words before there was a proposal
        old = np.zeros_like(more) if proposal is None else proposal
        proposal = more | old


def sample_of(docs: DataFrame, share: float) -> DataFrame:
    """The documents whose digest says so: the same ones each time."""
    return docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < int(share * 1_000_000))


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = 5, share: float = 0.1, lowered: float = 0.6, log_bits: int = LOG_BITS) -> DataFrame:
    """lang, phrase, size, n: all phrases that occur ``least`` times or more; of size 0, each language's number of words.

    ``share`` of the documents are the sample; there, a phrase is proposed from ``lowered`` times the count that
    its share would give; ``log_bits`` is the size of a bitmap. None of them changes the result.
    """
    rows = docs.select("doc_id", "lang", "text")
    tried, proposal = mine(sample_of(rows, share), least * share * lowered, longest, log_bits=log_bits)
    release(docs.sparkSession, *tried)
    passes, _ = mine(rows, least, longest, proposal, log_bits)
    found = passes[0]
    for more in passes[1:]:
        found = found.unionByName(more)
    return found.drop("h")


def scored(found: DataFrame) -> DataFrame:
    """Candidates with their weakest cut: lang, phrase, a, l, r, n, score."""
    wide = "decimal(38,0)"
    parts = found.where("size > 0").select("lang", "phrase", F.col("n").alias("f"))
    totals = found.where("size = 0").select("lang", F.col("n").alias("total"))
    cut = found.where("size > 1").select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w")).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    sides = cut.select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice("w", 1, F.col("k")), " ").alias("first"),
        F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("rest"),
    )
    with_l = sides.join(parts.withColumnsRenamed({"phrase": "first", "f": "l"}), ["lang", "first"])
    with_r = with_l.join(parts.withColumnsRenamed({"phrase": "rest", "f": "r"}), ["lang", "rest"]).join(totals, "lang")
    score = F.expr(f"(1000 * CAST(a AS {wide}) * CAST(total AS {wide})) div (CAST(l AS {wide}) * CAST(r AS {wide}))")
    weakest = F.min(F.struct(score.alias("score"), "k", "l", "r"))
    best = with_r.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("total").alias("n"), weakest.alias("c"))
    return best.select("lang", "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), "n", F.col("c.score").alias("score"))


def around(found: DataFrame) -> DataFrame:
    """lang, phrase, longer: the most frequent longer candidate around each phrase of two words or more."""
    w = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size(w) - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))))
    return found.where("size > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer"))


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, percent: int = 100, top: int = 2000, **sampling: float | int) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language by score.

    A candidate goes if a longer one around it has ``percent`` of its occurrences or more.
    """
    found = cut_lineage(frequent_phrases(docs, least, longest, **sampling))
    own = scored(found).join(around(found), ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a")))
    order: list[Column] = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    ranked = own.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return ranked.where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
