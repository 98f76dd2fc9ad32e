"""One camera's live tracks as columns; the step shared by the batch and the stream tracker."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

STATE = np.dtype([("track", "i8"), ("box", "f8", 4), ("seen", "i8"), ("age", "i8")])


def overlaps(boxes: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Intersection over union of every box with every other one."""
    a, b = boxes[:, None, :], others[None, :, :]
    sides = np.minimum(a[..., 2:], b[..., 2:]) - np.maximum(a[..., :2], b[..., :2])
    common = np.maximum(sides, 0).prod(axis=-1)
    areas = [np.maximum(m[..., 2:] - m[..., :2], 0).prod(axis=-1) for m in (a, b)]
    return common / np.maximum(areas[0] + areas[1] - common, 1e-6)


@dataclass
class Tracker:
    """Greedy tracking by overlap. ``live`` holds a row per track, oldest first; that
    order decides between equal overlaps."""

    iou_above: float = 0.2
    confirm_at: int = 3
    forget_after: int = 30
    live: np.ndarray = field(default_factory=lambda: np.zeros(0, STATE))

    def claims(self, boxes: np.ndarray) -> np.ndarray:
        """For each box, the row of the live track with the greatest overlap above the bound, or -1."""
        if not len(self.live):
            return np.full(len(boxes), -1)
        found = overlaps(boxes, self.live["box"])
        row = found.argmax(axis=1)
        return np.where(found[np.arange(len(boxes)), row] > self.iou_above, row, -1)

    def frame(self, frame_no: int, boxes: list[tuple[int, int, tuple]]) -> list[tuple]:
        """(det, track, age, confirmed) for the boxes ``(det, number, box)`` of one frame.

        All boxes claim against the tracks as they stand before the frame. A live track takes its first
        claim; further claims of it give no row. A box without a claim opens the track of its own number.
        """
        det = np.array([b[0] for b in boxes], np.int64)
        opened = np.zeros(len(boxes), STATE)
        opened["track"] = [b[1] for b in boxes]
        opened["box"] = np.reshape([b[2] for b in boxes], (-1, 4))
        opened["seen"], opened["age"] = frame_no, 1
        # frames without boxes would have dropped these before this frame
        self.live = self.live[frame_no - self.live["seen"] <= self.forget_after + 1]
        claim = self.claims(opened["box"])
        rows, first = np.unique(claim, return_index=True)
        rows, first = rows[rows >= 0], first[rows >= 0]
        self.live["box"][rows] = opened["box"][first]
        self.live["seen"][rows] = frame_no
        self.live["age"][rows] += 1
        current = opened.copy()
        current[first] = self.live[rows]
        answered = claim < 0
        answered[first] = True
        self.live = np.concatenate([self.live[frame_no - self.live["seen"] <= self.forget_after], opened[claim < 0]])
        out = current[answered]
        return list(zip(det[answered].tolist(), out["track"].tolist(), out["age"].tolist(), (out["age"] >= self.confirm_at).tolist()))

    def follow(self, frame_no: np.ndarray, det: np.ndarray, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, n: int) -> tuple[list, list, list, list]:
        """(frame, det, track, age) for boxes in order of frame and detection, ``n`` of which were seen before; the rule of :meth:`frame`.

        Frames mostly hold a box or two and few tracks are live, for which plain numbers are faster than arrays.
        """
        out: tuple[list, list, list, list] = ([], [], [], [])
        ends = np.append(np.flatnonzero(frame_no[1:] != frame_no[:-1]) + 1, len(frame_no)).tolist()
        box = np.stack([x1, y1, x2, y2], axis=1)
        rows, frames, dets = box.tolist(), frame_no.tolist(), det.tolist()
        if np.isnan(box).any() or np.isnan(self.live["box"]).any():
            start = 0
            for end in ends:
                found = self.frame(frames[start], [(dets[i], n + i + 1, rows[i]) for i in range(start, end)])
                for one, values in zip(out, zip(*((frames[start], *f[:3]) for f in found))):
                    one.extend(values)
                start = end
            return out
        above, forget = self.iou_above, self.forget_after

        def area(b: list[float]) -> float:
            return max(b[2] - b[0], 0.0) * max(b[3] - b[1], 0.0)

        # place, its area, frame, age, number
        live = [[b, area(b), seen, age, track] for track, b, seen, age in self.live.tolist() for b in [list(b)]]
        start = 0
        for end in ends:
            now = frames[start]
            live = [t for t in live if now - t[2] <= forget + 1]
            taken: dict[int, int] = {}
            claims = []
            for i in range(start, end):
                a1, b1, a2, b2 = rows[i]
                own, best, claim = area(rows[i]), above, -1
                for k, t in enumerate(live):
                    c1, d1, c2, d2 = t[0]
                    w = (a2 if a2 < c2 else c2) - (a1 if a1 > c1 else c1)
                    if w <= 0:
                        continue
                    h = (b2 if b2 < d2 else d2) - (b1 if b1 > d1 else d1)
                    if h <= 0:
                        continue
                    found = w * h / max(own + t[1] - w * h, 1e-6)
                    if found > best:
                        best, claim = found, k
                claims.append((claim, own))
                if claim >= 0:
                    taken.setdefault(claim, i)
            opened = []
            for i, (claim, own) in zip(range(start, end), claims):
                if claim < 0:
                    t = [rows[i], own, now, 1, n + i + 1]
                    opened.append(t)
                elif taken[claim] == i:
                    t = live[claim]
                    t[0], t[1], t[2], t[3] = rows[i], own, now, t[3] + 1
                else:
                    continue
                for one, value in zip(out, (now, dets[i], t[4], t[3])):
                    one.append(value)
            live = [t for t in live if now - t[2] <= forget] + opened
            start = end
        self.live = np.array([(t[4], t[0], t[2], t[3]) for t in live], STATE)
        return out
