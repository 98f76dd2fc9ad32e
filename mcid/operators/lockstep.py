"""Many pieces of tracking history followed side by side, one frame of each at a time.

The rule is that of :class:`tracker.Tracker`; here the live tracks of all pieces are one set of arrays, so a
step costs a few array operations however many pieces there are.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np


@dataclass
class Rows:
    """Arrays of one length, one row per entry."""

    def take(self, at: np.ndarray):
        return type(self)(*(getattr(self, f.name)[at] for f in fields(self)))

    def __len__(self) -> int:
        return len(getattr(self, fields(self)[0].name))

    @classmethod
    def join(cls, parts: list):
        return cls(*(np.concatenate([getattr(p, f.name) for p in parts]) for f in fields(cls)))


@dataclass
class Boxes(Rows):
    """Boxes in order of piece, frame and detection."""

    piece: np.ndarray
    frame: np.ndarray
    number: np.ndarray
    box: np.ndarray


@dataclass
class Tracks(Rows):
    """Live tracks in order of piece, oldest first. A track from before a piece is ``-1 - place`` in its first state."""

    piece: np.ndarray
    track: np.ndarray
    age: np.ndarray
    seen: np.ndarray
    box: np.ndarray

    @classmethod
    def none(cls) -> "Tracks":
        return cls(*(np.zeros(0, np.int64) for _ in range(4)), np.zeros((0, 4)))


@dataclass
class Followed:
    """Track and age of each box (age 0: no row), the states at the pieces' two borders, and pieces with equal overlaps."""

    track: np.ndarray
    age: np.ndarray
    first: Tracks
    last: Tracks
    tied: np.ndarray


def overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union, row by row."""
    common = np.maximum(np.minimum(a[:, 2:], b[:, 2:]) - np.maximum(a[:, :2], b[:, :2]), 0).prod(axis=1)
    areas = [np.maximum(m[:, 2:] - m[:, :2], 0).prod(axis=1) for m in (a, b)]
    return common / np.maximum(areas[0] + areas[1] - common, 1e-6)


def claims(boxes: Boxes, live: Tracks, above: float) -> tuple[np.ndarray, np.ndarray]:
    """For each box the row of the live track of its piece with the greatest overlap, or -1; and whether it had an equal."""
    lo, hi = np.searchsorted(live.piece, boxes.piece, "left"), np.searchsorted(live.piece, boxes.piece, "right")
    count = hi - lo
    claim, tie = np.full(len(boxes), -1), np.zeros(len(boxes), bool)
    some = np.flatnonzero(count)
    if not len(some):
        return claim, tie
    n = count[some]
    start = np.cumsum(n) - n
    mine = np.repeat(some, n)
    other = np.arange(n.sum()) - np.repeat(start - lo[some], n)
    found = overlap(boxes.box[mine], live.box[other])
    best = np.maximum.reduceat(found, start)
    top = np.flatnonzero(found == np.repeat(best, n))
    who, first, times = np.unique(mine[top], return_index=True, return_counts=True)
    good = best > above
    claim[who] = np.where(good, other[top[first]], -1)
    tie[who] = good & (times > 1)
    return claim, tie


def follow(boxes: Boxes, given: Tracks, border: np.ndarray, after: np.ndarray, iou_above: float, forget_after: int) -> Followed:
    """Track all pieces. ``border``: each piece's first frame of its own; earlier ones only warm up.

    ``given``: the tracks that pieces start with. ``after``: the first frame that could follow a piece.
    """
    pieces = len(border)
    new_frame = np.ones(len(boxes), bool)
    new_frame[1:] = (boxes.piece[1:] != boxes.piece[:-1]) | (boxes.frame[1:] != boxes.frame[:-1])
    count = np.cumsum(new_frame)
    base = np.zeros(pieces, np.int64)
    head = np.ones(len(boxes), bool)
    head[1:] = boxes.piece[1:] != boxes.piece[:-1]
    base[boxes.piece[head]] = count[head]
    step = count - base[boxes.piece]
    by = np.argsort(step, kind="stable")
    cuts = np.searchsorted(step[by], np.arange(int(step.max(initial=-1)) + 2))
    track, age = np.zeros(len(boxes), np.int64), np.zeros(len(boxes), np.int64)
    live, firsts, entered, tied = given, [], np.zeros(pieces, bool), np.zeros(pieces, bool)
    never = np.iinfo(np.int64).min // 2

    def enter(which: np.ndarray) -> None:
        """Note the state of pieces whose own frames begin, and count their tracks from there."""
        nonlocal live
        which = which & ~entered
        if not which.any():
            return
        mine = which[live.piece]
        live = live.take(~mine | (border[live.piece] - live.seen <= forget_after + 1))
        mine = np.flatnonzero(which[live.piece])
        owner = live.piece[mine]
        place = np.arange(len(mine)) - np.searchsorted(owner, owner, "left")
        live.track[mine], live.age[mine] = -1 - place, 0
        firsts.append(live.take(mine))
        entered[which] = True

    for at, to in zip(cuts[:-1], cuts[1:]):
        rows = by[at:to]
        now = boxes.take(rows)
        clock = np.full(pieces, never)
        clock[now.piece] = now.frame
        enter(clock >= border)
        live = live.take(clock[live.piece] - live.seen <= forget_after + 1)
        claim, tie = claims(now, live, iou_above)
        tied[now.piece[tie]] = True
        old, first = np.unique(claim, return_index=True)
        old, first = old[old >= 0], first[old >= 0]
        live.box[old], live.seen[old] = now.box[first], now.frame[first]
        live.age[old] += 1
        track[rows[first]], age[rows[first]] = live.track[old], live.age[old]
        opens = np.flatnonzero(claim < 0)
        track[rows[opens]], age[rows[opens]] = now.number[opens], 1
        opened = Tracks(now.piece[opens], now.number[opens], np.ones(len(opens), np.int64), now.frame[opens], now.box[opens])
        live = Tracks.join([live.take(clock[live.piece] - live.seen <= forget_after), opened])
        live = live.take(np.argsort(live.piece, kind="stable"))
    enter(np.ones(pieces, bool))
    last = live.take(after[live.piece] - live.seen <= forget_after + 1)
    return Followed(track, age, Tracks.join([Tracks.none(), *firsts]), last, tied)
