"""Fill-in-the-middle: texts are cut in three and written so that the middle comes last.

A text's bytes are cut into blocks of ``BLOCK``. For each block a Fenwick tree holds how many units and how many
code points end in it. The k-th unit's end is found by binary lifting: from the largest power of two down, a step
is taken while the units passed stay below k, which leaves the one block that holds the end; only this block is
then looked at byte by byte. The same steps add up the code points before it. A tree is built once per text and
asked for each cut; building takes linear time, a cut takes the logarithm of the number of blocks and one block.

Units are code points, or the matches of a pattern from left to right; what lies between two matches belongs to
the one after it, what follows the last match is a unit of its own.

Where a text with an id is cut is fixed by the digest of ``seed:doc_id``, so a task that runs again gives the
same output. Texts that contain a mark, empty texts, and a tenth of all stay as they are ("plain").

Cases: null text counts as empty, a missing id gives the digest of ``seed:`` alone; rows that share an id but not
the text are cut on their own; an empty table gives no rows; other columns are kept by :func:`transform`, unless
they have the name of a column it adds. A text is one row and must fit in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, texts

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of a block.
BLOCK = 1 << 12


class Blocks:
    """Where the units of a text end: ``last`` marks their last bytes, ``points`` those of code points."""

    def __init__(self, last: np.ndarray, points: np.ndarray, block: int = BLOCK) -> None:
        self.last, self.points, self.block = last, points, block
        starts = np.arange(0, len(last), block)
        counts = [np.add.reduceat(marks, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64) for marks in (last, points)]
        self.tree = np.zeros((len(starts) + 1, 2), np.int64)
        self.tree[1:] = np.stack(counts, axis=1)
        step = 1
        while step < len(self.tree):
            # nodes of this size hand their sums on to the next larger ones
            low = np.arange(step, len(self.tree) - step, 2 * step)
            self.tree[low + step] += self.tree[low]
            step *= 2

    def total(self) -> tuple[int, int]:
        """Units and code points of the whole text."""
        at, found = len(self.tree) - 1, np.zeros(2, np.int64)
        while at > 0:
            found += self.tree[at]
            at &= at - 1
        return int(found[0]), int(found[1])

    def end(self, k: int) -> tuple[int, int]:
        """Bytes and code points of the first ``k`` units."""
        if k <= 0:
            return 0, 0
        at, units, points = 0, 0, 0
        step = 1 << (len(self.tree) - 1).bit_length()
        while step:
            if at + step < len(self.tree) and units + self.tree[at + step, 0] < k:
                at += step
                units += int(self.tree[at, 0])
                points += int(self.tree[at, 1])
            step >>= 1
        low = at * self.block
        inside = int(np.flatnonzero(self.last[low : low + self.block])[k - units - 1]) + 1
        return low + inside, points + int(np.count_nonzero(self.points[low : low + inside]))


def ends(body: bytes, unit: regex.Pattern | None) -> tuple[np.ndarray, np.ndarray]:
    """Marks of the last bytes of units and of code points."""
    raw = np.frombuffer(body, np.uint8)
    points = np.ones(len(raw), bool)
    if len(raw):
        points[:-1] = (raw[1:] & 0xC0) != 0x80
    if unit is None:
        return points, points
    at = np.flatnonzero(points)
    stops = [m.end() for m in unit.finditer(body.decode()) if m.end() > m.start()]
    if len(at) and (not stops or stops[-1] < len(at)):
        stops.append(len(at))
    last = np.zeros(len(raw), bool)
    last[at[np.array(stops, np.int64) - 1]] = True
    return last, points


def draws(seed: str, doc_id: object) -> list[int]:
    """Four numbers below 2**32, fixed by seed and id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]


def transform(docs: DataFrame, seed: str = "1", plain_above: int = 90, spm_below: int = 20, unit: str | None = None, block: int = BLOCK) -> DataFrame:
    """``docs`` with n (units), form, prefix_chars, middle_chars and output.

    ``plain_above``, ``spm_below``: of 100, texts from the first on stay plain; of the others, those below the
    second have the suffix first. ``unit``: a pattern; code points if None.
    """
    pattern = None if unit is None else regex.compile(unit)
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    new = {"n": T.LongType(), "form": T.StringType(), "prefix_chars": T.LongType(), "middle_chars": T.LongType(), "output": T.StringType()}
    rows = docs.drop(*new)
    schema = T.StructType([*rows.schema.fields, *[T.StructField(c, t) for c, t in new.items()]])

    def cut(doc_id: object, body: bytes) -> tuple:
        h1, h2, h3, h4 = draws(seed, doc_id)
        blocks = Blocks(*ends(body, pattern), block)
        n = blocks.total()[0]
        if not body or h3 % 100 >= plain_above or any(m in body for m in marks):
            return n, "plain", None, None, body
        (a, a_chars), (b, b_chars) = (blocks.end(k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
        p, s, m = marks
        prefix, middle, suffix = body[:a], body[a:b], body[b:]
        if h4 % 100 < spm_below:
            return n, "spm", a_chars, b_chars - a_chars, b"".join((s, suffix, p, prefix, m, middle))
        return n, "psm", a_chars, b_chars - a_chars, b"".join((p, prefix, s, suffix, m, middle))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
        found = list(zip(*map(cut, ids, texts(batch, "text")))) or [()] * 5
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64()]
        made = [pa.array(c, k) for c, k in zip(found, kinds)] + [pa.array(found[4], pa.binary()).cast(pa.string())]
        yield pa.record_batch([*batch.columns, *made], names=[*batch.schema.names, *new])

    return map_arrow(rows, run, schema)


def restored(output: str, form: str) -> Column:
    """The text that was cut: marks do not occur in it, so the output splits at them in one way only."""
    spm = F.split(F.substr(F.col(output), F.lit(1 + len(SUFFIX))), f"{PREFIX}|{MIDDLE}", -1)
    psm = F.split(F.substr(F.col(output), F.lit(1 + len(PREFIX))), f"{SUFFIX}|{MIDDLE}", -1)
    return (
        F.when(F.col(form) == "spm", F.concat(spm[1], spm[2], spm[0]))
        .when(F.col(form) == "psm", F.concat(psm[0], psm[2], psm[1]))
        .otherwise(F.col(output))
    )


def digests(docs: DataFrame, seed: str = "1") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the digests of output and restored text."""
    made = transform(docs.select("doc_id", "text"), seed)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored("output", "form"), 256).alias("restored_sha256"),
    )
