"""Box tracking over chunks of a camera's history that are worked on before their past is known.

A chunk needs the tracks that are live when it begins. It guesses them by a warm-up over the frames before it,
starting from nothing; boxes replace each other fast, so the guess is mostly right. What a chunk needs to know
are places and times of the live tracks, not their names: names from before are kept as places in the first
state. Then each chunk's guess is compared with the state in which the chunk before it ended. Chunks that
guessed wrong run again from that state, the others stand, until all agree; the first wrong chunk of a camera
is right after the next round, so this ends, and ends with what one pass over the whole history gives.

If two tracks overlap a box equally, the older one wins. So the order of a guess matters only in chunks in
which that happened; in others, the same tracks in another order will do.

Names go back along the chunks by pointer doubling. No camera is ever in one task, however long it is busy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, delete_cuts
from .lockstep import Boxes, Followed, Tracks, follow

#: What a row is: a given or guessed live track, a box, a live track at the end, a chunk.
GIVEN, BOX, LAST, CHUNK = range(4)
KEY = ["camera_id", "chunk"]
SIDES = ["x1", "y1", "x2", "y2"]
INPUT = [*KEY, "kind", "frame_no", "place", "det_no", *SIDES]
OUTPUT = "camera_id string, chunk long, kind int, frame_no long, place long, track long, age long, x1 double, y1 double, x2 double, y2 double, tied boolean"
#: Rows that are tracked side by side.
ROWS = 200_000


def track(
    df: DataFrame, iou_above: float, confirm_at: int, forget_after: int, frames: int = 1024, warm_up: int = 128, trace: list[int] | None = None
) -> DataFrame:
    """camera_id, frame_no, det_id, track_id, age, confirmed for boxes (camera_id, frame_no, det_id, det_no, x1..y2).

    ``frames`` is the length of a chunk and must exceed ``forget_after + 1``. ``trace`` gets the number of chunks
    of each round.
    """
    if frames <= forget_after + 1:
        raise ValueError("a chunk must be longer than a track is remembered")
    boxes = df.select(
        "camera_id", F.floor(F.col("frame_no") / frames).alias("chunk"), F.lit(BOX).alias("kind"), F.col("frame_no").cast("long").alias("frame_no"),
        F.col("det_id").cast("long").alias("place"), F.col("det_no").cast("long").alias("det_no"), *[F.col(c).cast("double").alias(c) for c in SIDES],
    )
    boxes = cut_lineage(boxes)
    before = boxes.where(F.pmod(F.col("frame_no"), F.lit(frames)) >= frames - warm_up).withColumn("chunk", F.col("chunk") + 1)
    # a warm-up for a chunk without boxes is of no use
    before = before.join(boxes.select(*KEY).distinct(), KEY, "left_semi")
    done = cut_lineage(_run(boxes.unionByName(before.select(INPUT)), frames, iou_above, forget_after))
    if trace is not None:
        trace.append(done.where(F.col("kind") == CHUNK).count())
    while True:
        judged = cut_lineage(_borders(done))
        wrong = judged.where("NOT agreed").select(*KEY)
        if wrong.isEmpty():
            break
        if trace is not None:
            trace.append(wrong.count())
        given = judged.where("NOT agreed").select(*KEY, F.explode("was").alias("t")).select(
            *KEY, F.lit(GIVEN).alias("kind"), F.col("t.seen").alias("frame_no"), F.col("t.place").alias("place"), F.lit(0).cast("long").alias("det_no"), *[F.col(f"t.{c}").alias(c) for c in SIDES]
        )
        again = _run(boxes.join(wrong, KEY, "left_semi").select(INPUT).unionByName(given), frames, iou_above, forget_after)
        after = cut_lineage(done.join(wrong, KEY, "left_anti").select(done.columns).unionByName(again))
        delete_cuts(done, judged)
        done = after
    named = _names(judged)
    found = done.where(F.col("kind") == BOX).withColumn("_at", F.when(F.col("track") < 0, -1 - F.col("track")))
    older = named.select(*KEY, F.col("place").alias("_at"), F.col("track").alias("_track"), F.col("age").alias("_age"))
    joined = found.where("_at IS NULL").select(*KEY, "frame_no", "place", "track", "age").unionByName(
        found.where("_at IS NOT NULL").join(older, [*KEY, "_at"]).select(*KEY, "frame_no", "place", F.col("_track").alias("track"), (F.col("age") + F.col("_age")).alias("age"))
    )
    delete_cuts(boxes)
    return joined.select(
        "camera_id", "frame_no", F.col("place").alias("det_id"), F.col("track").alias("track_id"), "age", (F.col("age") >= confirm_at).alias("confirmed")
    )


def _run(rows: DataFrame, frames: int, iou_above: float, forget_after: int) -> DataFrame:
    spread = rows.repartition(*[F.col(k) for k in KEY]).sortWithinPartitions(*KEY, "kind", "frame_no", "place")
    names = [f.split()[0] for f in OUTPUT.split(", ")]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Tables of whole chunks."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < ROWS:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            chunk, camera = t.column("chunk").to_numpy(), t.column("camera_id").to_numpy()
            end = t.num_rows
            while end and chunk[end - 1] == chunk[-1] and camera[end - 1] == camera[-1]:
                end -= 1
            if end:
                yield t.slice(0, end)
                held = t.slice(end).to_batches()
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole(batches):
            if t.num_rows:
                yield from _track_table(t, frames, iou_above, forget_after, names)

    return spread.mapInArrow(run, OUTPUT)


def _track_table(t: pa.Table, frames: int, iou_above: float, forget_after: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    camera, (chunk, kind, frame, place, number) = t.column("camera_id").to_numpy(), (t.column(c).to_numpy() for c in INPUT[1:6])
    box = np.stack([t.column(c).to_numpy() for c in SIDES], axis=1)
    new = np.ones(len(chunk), bool)
    new[1:] = (chunk[1:] != chunk[:-1]) | (camera[1:] != camera[:-1])
    piece, heads = np.cumsum(new) - 1, np.flatnonzero(new)
    at, start = np.flatnonzero(kind == BOX), np.flatnonzero(kind == GIVEN)
    start = start[np.lexsort((place[start], piece[start]))]  # oldest first
    zero = np.zeros(len(start), np.int64)
    given = Tracks(piece[start], zero.copy(), zero.copy(), frame[start], box[start])
    border = chunk[heads] * frames
    found: Followed = follow(Boxes(piece[at], frame[at], number[at], box[at]), given, border, border + frames, iou_above, forget_after)

    def batch(kind: int, of: np.ndarray, frame_no, place, track, age, sides, tied) -> pa.RecordBatch:
        n = len(of)
        columns = [camera[heads][of], chunk[heads][of], np.full(n, kind, np.int32), frame_no, place, track, age, *np.asarray(sides, float).reshape(n, 4).T, tied]
        return pa.record_batch([pa.array(c) if k else pa.array(c, pa.string()) for k, c in enumerate(columns)], names=names)

    own = np.flatnonzero((found.age > 0) & (frame[at] >= border[piece[at]]))
    rows, no = at[own], np.zeros(len(own), bool)
    yield batch(BOX, piece[rows], frame[rows], place[rows], found.track[own], found.age[own], box[rows], no)
    for state, which in ((found.first, GIVEN), (found.last, LAST)):
        state = state.take(np.argsort(state.piece, kind="stable"))
        order = np.arange(len(state)) - np.searchsorted(state.piece, state.piece, "left")
        yield batch(which, state.piece, state.seen, order, state.track, state.age, state.box, np.zeros(len(state), bool))
    zeros = np.zeros(len(heads), np.int64)
    yield batch(CHUNK, np.arange(len(heads)), zeros, zeros, zeros, zeros, np.zeros((len(heads), 4)), found.tied)


def _state(done: DataFrame, kind: int, name: str) -> DataFrame:
    """The live tracks of a border as one array, in order of place; few, as they fit the frames that are remembered."""
    one = F.struct("place", F.col("frame_no").alias("seen"), *SIDES, "track", "age")
    return done.where(F.col("kind") == kind).groupBy(*KEY).agg(F.array_sort(F.collect_list(one)).alias(name))


def _borders(done: DataFrame) -> DataFrame:
    """Each chunk with the tracks it began with (``now``), those the chunk before ended with (``was``), and whether they agree."""
    empty = F.expr("slice(array(struct(0L AS place, 0L AS seen, 0D AS x1, 0D AS y1, 0D AS x2, 0D AS y2, 0L AS track, 0L AS age)), 1, 0)")
    before = _state(done, LAST, "was").withColumn("chunk", F.col("chunk") + 1)
    joined = (
        done.where(F.col("kind") == CHUNK).select(*KEY, "tied")
        .join(_state(done, GIVEN, "now"), KEY, "left").join(before, KEY, "left")
        .withColumns({c: F.coalesce(c, empty) for c in ("now", "was")})
    )

    def seen(c: str) -> Column:
        return F.transform(c, lambda t: F.struct(t["seen"], *[t[s] for s in SIDES]))

    same = (seen("now") == seen("was")) | (~F.col("tied") & (F.array_sort(seen("now")) == F.array_sort(seen("was"))))
    return joined.withColumn("agreed", same)


def _names(borders: DataFrame) -> DataFrame:
    """camera_id, chunk, place: the track's number and its age before the chunk, for each track that a chunk began with."""
    def by_look(c: str) -> Column:
        return F.array_sort(F.transform(c, lambda t: F.struct(t["seen"], *[t[s] for s in SIDES], t["place"].alias("place"), t["track"].alias("track"), t["age"].alias("age"))))

    pairs = borders.select(*KEY, F.explode(F.arrays_zip(by_look("now").alias("a"), by_look("was").alias("b"))).alias("p"))
    links = cut_lineage(pairs.select(*KEY, F.col("p.a.place").alias("place"), F.col("p.b.track").alias("track"), F.col("p.b.age").alias("age"), (F.col("chunk") - 1).alias("at")))
    while not links.where("track < 0").isEmpty():
        up = links.select("camera_id", F.col("chunk").alias("at"), F.col("place").alias("_up"), F.col("track").alias("_track"), F.col("age").alias("_age"), F.col("at").alias("_at"))
        open_ = links.where("track < 0").withColumn("_up", -1 - F.col("track")).join(up, ["camera_id", "at", "_up"])
        moved = open_.select(*KEY, "place", F.col("_track").alias("track"), (F.col("age") + F.col("_age")).alias("age"), F.col("_at").alias("at"))
        after = cut_lineage(links.where("track >= 0").select(moved.columns).unionByName(moved))
        delete_cuts(links)
        links = after
    return links
