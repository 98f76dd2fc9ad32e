"""Streams with keyed state: stays, live bindings, thinning and tracking.

Rows change the state in the order of their event times, whatever order they arrive in: they wait in the state
until the watermark has passed them, and only then are applied, sorted. So the result does not depend on how the
input is cut into files and batches, and equals that of the batch operators on all rows up to the watermark.
Rows that come at or behind the watermark are late and dropped by Spark. A key holds the rows of the delay and its own state;
where a key has many rows, as a camera has, they wait in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from . import configure_state
from .windows import timed

DAY_MS = 86_400_000


class InOrder(StatefulProcessor):
    """Rows by event time. ``fields``: the columns to keep; the first one, ``at_ms``, says when a row is complete.

    One timer is set per key, at the earliest thing that waits: a row, or :meth:`limit`.
    """

    fields: dict[str, str]
    columns: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ", ".join(f"{n} {t}" for n, t in self.fields.items()))
        self.timer = handle.getValueState("timer", "at_ms bigint")
        self.ready(handle)

    def ready(self, handle: StatefulProcessorHandle) -> None:
        """Set up the processor's own state."""

    def apply(self, key: tuple, rows: list[tuple], watermark: int) -> list[tuple]:
        """Change the state by rows in order; none lies behind the watermark, and no more will come up to it."""
        raise NotImplementedError

    def limit(self) -> int | None:
        """When the state itself is due."""
        return None

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues):
        first = None
        for part in rows:
            if len(part):
                # plain values; pandas turns whole numbers with gaps into floats
                values = [[None if pd.isna(x) else x.item() if isinstance(x, np.generic) else x for x in part[c]] for c in self.fields]
                self.waiting.appendList(list(zip(*values)))
                low = min(values[0])
                first = low if first is None else min(first, low)
        self._wake(first)
        # nothing, not an empty frame: each frame travels as a batch of its own
        return iter(())

    def _wake(self, at: int | None) -> None:
        held = self.timer.get()[0] if self.timer.exists() else None
        if at is None or (held is not None and held <= at):
            return
        if held is not None:
            self.handle.deleteTimer(held)
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        watermark = timerValues.getCurrentWatermarkInMs()
        due, rest = [], []
        for row in self.waiting.get():
            (due if row[0] <= watermark else rest).append(tuple(row))
        due.sort(key=lambda r: [(x is not None, x) for x in r])
        out = self.apply(key, due, watermark)
        self.waiting.clear()
        if rest:
            self.waiting.put(rest)
        self.timer.clear()
        times = [r[0] for r in rest] + [t for t in (self.limit(),) if t is not None]
        self._wake(min(times, default=None))
        if out:
            yield pd.DataFrame(out, columns=self.columns)


#: Rows of a key that wait as one value of the state, and the span of time that is applied at once.
BLOCK_ROWS, BUCKET_MS = 500_000, 86_400_000
ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}


class InBlocks(InOrder):
    """:class:`InOrder` for keys with many rows: they wait as Arrow blocks by spans of time, and are applied one span after the other.

    So rows cost no calls to the state of their own, and no more than a span of a key is held at once.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.schema = pa.schema([(n, ARROW[t]) for n, t in self.fields.items()])
        self.waiting = handle.getMapState("waiting", "bucket bigint, number bigint", "block binary")
        self.count = handle.getValueState("blocks", "n bigint")
        self.timer = handle.getValueState("timer", "at_ms bigint")
        self.ready(handle)

    def reduced(self, rows: pa.Table) -> pa.Table:
        """What of the rows has to wait."""
        return rows

    def apply(self, key: tuple, rows: pa.Table, watermark: int) -> pd.DataFrame | None:
        """See :meth:`InOrder.apply`; ``rows`` are sorted by all fields."""
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues):
        n = first = None
        held: list[pa.RecordBatch] = []

        def put() -> None:
            nonlocal n, first
            if not held:
                return
            n = n if n is not None else self.count.get()[0] if self.count.exists() else 0
            for bucket, low, part in self._by_bucket(self.reduced(pa.Table.from_batches(held))):
                self._store(bucket, n, part)
                n += 1
                first = low if first is None else min(first, low)
            held.clear()

        for part in rows:
            if len(part):
                held.append(pa.RecordBatch.from_pandas(part[list(self.fields)], schema=self.schema, preserve_index=False))
                if sum(b.num_rows for b in held) >= BLOCK_ROWS:
                    put()
        put()
        if n is not None:
            self.count.update((n,))
        self._wake(first)
        return iter(())

    def _by_bucket(self, rows: pa.Table) -> Iterator[tuple[int, int, pa.Table]]:
        at = rows.column("at_ms").to_numpy()
        bucket = at // BUCKET_MS
        for b in np.unique(bucket).tolist():
            mine = np.flatnonzero(bucket == b)
            yield b, int(at[mine].min()), rows.take(pa.array(mine))

    def _store(self, bucket: int, number: int, rows: pa.Table) -> None:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self.schema) as out:
            out.write_table(rows)
        self.waiting.updateValue((bucket, number), (sink.getvalue().to_pybytes(),))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        watermark = timerValues.getCurrentWatermarkInMs()
        blocks = sorted((tuple(k) for k in self.waiting.keys()))
        times = []
        for bucket in sorted({b for b, _ in blocks}):
            if bucket * BUCKET_MS > watermark:
                times.append(bucket * BUCKET_MS)
                break
            own = [k for k in blocks if k[0] == bucket]
            rows = pa.concat_tables([pa.ipc.open_stream(self.waiting.getValue(k)[0]).read_all() for k in own])
            for k in own:
                self.waiting.removeKey(k)
            waits = pc.greater(rows.column("at_ms"), watermark)
            rest, due = rows.filter(waits), rows.filter(pc.invert(waits))
            if rest.num_rows:
                self._store(*own[0], rest)
                times.append(pc.min(rest.column("at_ms")).as_py())
            if due.num_rows:
                due = due.take(pc.sort_indices(due, sort_keys=[(n, "ascending") for n in self.fields], null_placement="at_start"))
                out = self.apply(key, due, min(watermark, (bucket + 1) * BUCKET_MS - 1))
                if out is not None and len(out):
                    yield out[self.columns]
            if rest.num_rows:
                break
        self.timer.clear()
        self.settled(key, watermark)
        self._wake(min(times, default=None))

    def settled(self, key: tuple, watermark: int) -> None:
        """All rows up to the watermark have been applied."""


def _ordered(df: DataFrame, keys: list[str], processor: InOrder, output: str, delay: str, at: Column) -> DataFrame:
    configure_state(df.sparkSession)
    rows = timed(df, delay).withColumn("at_ms", at).select("ts", *keys, *[F.col(n).cast(t).alias(n) for n, t in processor.fields.items() if n not in keys])
    return rows.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=output, outputMode="append", timeMode="eventTime"
    )


# ---- stays ----------------------------------------------------------------------
class Stays(InOrder):
    """Open on entry, close on exit; a stay that is open for the limit closes then, whether or not an exit comes later."""

    fields = {"at_ms": "bigint", "event_id": "bigint", "camera_id": "string", "event_type": "string"}
    columns = ["global_id", "zone_id", "camera_id", "entered_ms", "exited_ms", "duration_seconds", "status"]

    def __init__(self, max_open_ms: int) -> None:
        self.max_open_ms = max_open_ms

    def ready(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "camera_id string, entered_ms bigint")

    def apply(self, key: tuple, rows: list[tuple], watermark: int) -> list[tuple]:
        held = tuple(self.open.get()) if self.open.exists() else None
        out: list[tuple] = []

        def leave(at: int) -> None:
            nonlocal held
            camera, entered = held
            out.append((*key, camera, entered, at, max(0, (at - entered) // 1000), "closed"))
            held = None

        for at, _, camera, kind in rows:
            if held is not None and at >= held[1] + self.max_open_ms:
                leave(held[1] + self.max_open_ms)
            if kind == "enter" and held is None:
                held = (camera, at)
            elif kind == "exit" and held is not None:
                leave(at)
        if held is not None and held[1] + self.max_open_ms <= watermark:
            leave(held[1] + self.max_open_ms)
        if held is None:
            self.open.clear()
        else:
            self.open.update(held)
        return out

    def limit(self) -> int | None:
        return self.open.get()[1] + self.max_open_ms if self.open.exists() else None


def stays(events: DataFrame, delay: str = "1 hour", max_open_seconds: int = 86_400) -> DataFrame:
    """Stays that were left or reached the limit before the watermark."""
    output = "global_id string, zone_id string, camera_id string, entered_ms bigint, exited_ms bigint, duration_seconds bigint, status string"
    return _ordered(events, ["global_id", "zone_id"], Stays(max_open_seconds * 1000), output, delay, F.col("ts_ms"))


# ---- bindings -------------------------------------------------------------------
class Bindings(InBlocks):
    """Per camera and chunk of time: the latest identity of each track, and of the camera."""

    # at one time, bindings come before detections
    fields = {"at_ms": "bigint", "kind": "int", "global_id": "string", "local_track_id": "bigint", "det_id": "bigint"}
    columns = ["det_id", "global_id"]

    def __init__(self, ttl_ms: int, chunk_ms: int) -> None:
        self.ttl_ms, self.chunk_ms = ttl_ms, chunk_ms

    def ready(self, handle: StatefulProcessorHandle) -> None:
        self.tracks = handle.getMapState("tracks", "track bigint", "global_id string, at_ms bigint")
        self.latest = handle.getValueState("latest", "global_id string, at_ms bigint")

    def over(self, key: tuple, watermark: int) -> bool:
        """Whether nothing more can come into the chunk."""
        return watermark >= (key[1] + 1) * self.chunk_ms - 1

    def apply(self, key: tuple, rows: pa.Table, watermark: int) -> pd.DataFrame:
        before = {k[0]: tuple(v) for k, v in self.tracks.iterator()}
        live, last, ttl = dict(before), tuple(self.latest.get()) if self.latest.exists() else None, self.ttl_ms
        dets, gids = [], []
        for at, kind, gid, track, det in zip(*(rows.column(c).to_pylist() for c in self.fields)):
            if kind == 0:
                live[track] = last = (gid, at)
                continue
            own = live.get(track)
            hit = own if own and at - own[1] <= ttl else last if last and at - last[1] <= ttl else None
            dets.append(det)
            gids.append(hit[0] if hit else None)
        if not self.over(key, watermark):
            # what no row after the watermark can use any more goes
            fresh = {k: v for k, v in live.items() if watermark - v[1] <= ttl}
            for k in before.keys() - fresh.keys():
                self.tracks.removeKey((k,))
            for k, v in fresh.items():
                if before.get(k) != v:
                    self.tracks.updateValue((k,), v)
            if last is not None:
                self.latest.update(last)
        return pd.DataFrame({"det_id": dets, "global_id": pd.Series(gids, dtype=object)})

    def settled(self, key: tuple, watermark: int) -> None:
        if self.over(key, watermark):
            self.tracks.clear()
            self.latest.clear()


def bindings(detections: DataFrame, decided: DataFrame, delay: str = "10 minutes", ttl_ms: int = 600_000) -> DataFrame:
    """Identity of each live detection; see ``candidates.bind_identity``.

    A binding is of no use after the TTL, so time is cut into chunks that are keys of their own: a binding enters
    its chunk and, within the TTL of the border, the next one.
    """
    chunk_ms = 6 * ttl_ms

    def chunk(at: Column) -> Column:
        return F.floor(at / chunk_ms)

    at = F.col("ts_ms")
    both = detections.select(
        F.lit(1).alias("kind"), "det_id", "camera_id", "local_track_id", "ts_ms", F.lit(None).cast("string").alias("global_id"), chunk(at).alias("chunk")
    ).unionByName(
        decided.select(
            F.lit(0).alias("kind"), F.lit(-1).cast("bigint").alias("det_id"), "camera_id", "local_track_id", "ts_ms", "global_id",
            F.explode(F.array_distinct(F.array(chunk(at), chunk(at + ttl_ms)))).alias("chunk"),
        )
    )
    return _ordered(both, ["camera_id", "chunk"], Bindings(ttl_ms, chunk_ms), "det_id bigint, global_id string", delay, at)


# ---- thinning -------------------------------------------------------------------
class Thin(InBlocks):
    fields = {"at_ms": "bigint"}
    columns = ["camera_id", "ts_ms"]

    def __init__(self, interval_ms: int) -> None:
        self.interval_ms = interval_ms

    def ready(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at_ms bigint")

    def reduced(self, rows: pa.Table) -> pa.Table:
        return pa.table([np.unique(rows.column("at_ms").to_numpy())], schema=self.schema)

    def apply(self, key: tuple, rows: pa.Table, watermark: int) -> pd.DataFrame:
        ts, kept = np.unique(rows.column("at_ms").to_numpy()), []
        i = int(np.searchsorted(ts, self.last.get()[0] + self.interval_ms)) if self.last.exists() else 0
        while i < len(ts):
            kept.append(int(ts[i]))
            i = int(np.searchsorted(ts, kept[-1] + self.interval_ms))
        if kept:
            self.last.update((kept[-1],))
        return pd.DataFrame({"camera_id": key[0], "ts_ms": kept})


def thinned(df: DataFrame, hertz: float = 5.0, delay: str = "10 seconds") -> DataFrame:
    """Event times per camera, at most ``hertz`` a second."""
    return _ordered(df, ["camera_id"], Thin(round(1000 / hertz)), "camera_id string, ts_ms bigint", delay, F.col("ts_ms"))


# ---- tracking ---------------------------------------------------------------------
class Tracks(InBlocks):
    """Frames are tracked once they are over, so boxes of one frame may arrive apart."""

    fields = {"at_ms": "bigint", "frame_no": "bigint", "det_id": "bigint", "x1": "double", "y1": "double", "x2": "double", "y2": "double"}
    columns = ["camera_id", "frame_no", "det_id", "track_id", "age", "confirmed"]

    def __init__(self, options: dict) -> None:
        self.options = options

    def ready(self, handle: StatefulProcessorHandle) -> None:
        self.live = handle.getValueState("live", "tracks binary, n bigint")

    def apply(self, key: tuple, rows: pa.Table, watermark: int) -> pd.DataFrame:
        from ..operators.tracker import STATE, Tracker

        tracker, n = Tracker(**self.options), 0
        if self.live.exists():
            held, n = self.live.get()
            tracker.live = np.frombuffer(bytes(held), STATE).copy()
        frame_no = rows.column("frame_no").to_numpy()
        at, det, track, age = tracker.follow(frame_no, *(rows.column(c).to_numpy() for c in ("det_id", "x1", "y1", "x2", "y2")), n)
        self.live.update((tracker.live.tobytes(), n + len(frame_no)))
        return pd.DataFrame({"camera_id": key[0], "frame_no": at, "det_id": det, "track_id": track, "age": age, "confirmed": np.array(age, int) >= tracker.confirm_at})


def tracked(df: DataFrame, delay: str = "10 seconds", frame_ms: int = 200, **options) -> DataFrame:
    """Tracks per camera; see ``detections.track_boxes``. A frame spans ``frame_ms`` from ``frame_no * frame_ms``."""
    output = "camera_id string, frame_no bigint, det_id bigint, track_id bigint, age bigint, confirmed boolean"
    return _ordered(df, ["camera_id"], Tracks(options), output, delay, (F.col("frame_no") + 1) * frame_ms - 1)
