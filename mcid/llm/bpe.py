"""Byte-level BPE: encoding with a segment tree of pair ranks, and decoding.

Method: a piece of text is a row of byte tokens. A segment tree over the byte positions holds, for each
live position, the rank of the pair that starts there; its root is the smallest rank at the leftmost
position. A merge joins that pair, links its neighbours past it, and updates the three leaves whose pair
changed, each along one path to the root. A piece of ``n`` bytes costs O(n log n), however long. Short
pieces of a batch are merged together, a tree per row of an array.

Text is cut into pieces only where the piece pattern must cut as well: between two characters that are not
white space, at a single space or line break. Ids of such a stretch do not depend on its surroundings, so
each worker remembers them in a table of bounded size; a full table is emptied, which costs time only.

Cases: null or empty text has no ids; special tokens are ordinary text; a byte without an id in the rank
file is an error; repeated rows and ids keep their rows; an empty table gives no rows; other columns of the
input are not read, so their names cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_arrow

#: No pair starts here, or none that merges.
NONE = 1 << 62


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file of ``base64 rank`` lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: merge the leftmost pair of the smallest rank until none is left."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 1))  # of the token that starts at a position
    before = list(range(-1, n))  # start of the token before it
    width = 1 << max(0, n - 2).bit_length()
    tree = [NONE] * (2 * width)
    # a leaf holds rank and position as one number, so that the minimum is the leftmost
    for i in range(n - 1):
        rank = ranks.get(piece[i : i + 2])
        if rank is not None:
            tree[width + i] = rank << 32 | i
    for k in range(width - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b

    def put(i: int, value: int) -> None:
        k = width + i
        if tree[k] == value:
            return
        tree[k] = value
        while k > 1:
            other = tree[k ^ 1]
            low = value if value < other else other
            k >>= 1
            if tree[k] == low:
                return
            tree[k] = value = low

    def pair(i: int, mid: int) -> int:
        rank = ranks.get(piece[i : end[mid]])
        return NONE if rank is None else rank << 32 | i

    while tree[1] != NONE:
        i = tree[1] & 0xFFFFFFFF
        right = end[i]
        end[i] = after = end[right]
        if right < n - 1:
            put(right, NONE)
        if after < n:
            before[after] = i
            put(i, pair(i, after))
        else:
            put(i, NONE)
        if i:
            put(before[i], pair(before[i], i))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Pairs:
    """Ids of merged pairs, looked up for whole arrays: every way to cut a token into two tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.n = 1 + max(ranks.values(), default=0)
        found = sorted(
            (ranks[t[:k]] * self.n + ranks[t[k:]], rank)
            for t, rank in ranks.items()
            for k in range(1, len(t))
            if t[:k] in ranks and t[k:] in ranks
        )
        # a last key above all others, so that a search never runs off the end
        self.keys = np.array([k for k, _ in found] + [NONE], np.int64)
        self.ids = np.array([r for _, r in found] + [NONE], np.int64)
        self.bytes = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.n + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ids[at], NONE)


def merge_many(pieces: list[bytes], pairs: Pairs) -> list[list[int]]:
    """``merge_piece`` for pieces of at most 128 bytes that are no tokens: one segment tree per row of an array."""
    rows, size = len(pieces), np.fromiter(map(len, pieces), np.int64, len(pieces))
    n = 1 << int(size.max() - 1).bit_length()
    raw = np.frombuffer(b"".join(p.ljust(n, b"\0") for p in pieces), np.uint8).reshape(rows, n)
    tok = np.zeros((rows, n + 1), np.int64)
    tok[:, :n] = pairs.bytes[raw]
    place = np.arange(n, dtype=np.int64)
    if (tok[:, :n][place < size[:, None]] < 0).any():
        raise KeyError("a byte has no id")
    end = np.tile(place + 1, (rows, 1))
    before = np.tile(np.arange(-1, n, dtype=np.int64), (rows, 1))
    tree = np.full((rows, 2 * n), NONE, np.int64)
    rank = pairs.get(tok[:, : n - 1], tok[:, 1:n])
    tree[:, n : 2 * n - 1] = np.where((rank != NONE) & (place[:-1] + 1 < size[:, None]), rank << 8 | place[:-1], NONE)
    levels = n.bit_length() - 1
    for h in range(levels):
        lo, hi = n >> h + 1, n >> h
        tree[:, lo:hi] = np.minimum(tree[:, 2 * lo : 2 * hi : 2], tree[:, 2 * lo + 1 : 2 * hi : 2])
    live = np.flatnonzero(tree[:, 1] != NONE)
    while len(live):
        root = tree[live, 1]
        i, merged = root & 255, root >> 8
        right = end[live, i]
        after = end[live, right]
        inside = after < size[live]
        tok[live, i] = merged
        end[live, i] = after
        before[live, after] = i
        prior = before[live, i]
        has = prior >= 0
        follow = pairs.get(merged, tok[live, after])
        ahead = pairs.get(tok[live, np.maximum(prior, 0)], merged)
        tree[live, n + right] = NONE
        tree[live, n + i] = np.where(inside & (follow != NONE), follow << 8 | i, NONE)
        tree[live[has], n + prior[has]] = np.where(ahead[has] != NONE, ahead[has] << 8 | prior[has], NONE)
        at = n + np.concatenate([i, right, np.where(has, prior, i)])
        three = np.concatenate([live, live, live])
        for _ in range(levels):
            at >>= 1
            tree[three, at] = np.minimum(tree[three, 2 * at], tree[three, 2 * at + 1])
        live = live[tree[live, 1] != NONE]
    # a position starts a token if no token before it reaches past it
    starts = np.zeros((rows, n), bool)
    cur, live = np.zeros(rows, np.int64), np.arange(rows)
    while len(live):
        starts[live, cur] = True
        cur = end[live, cur]
        more = cur < size[live]
        live, cur = live[more], cur[more]
    ids, ends = tok[:, :n][starts].tolist(), np.cumsum(starts.sum(1)).tolist()
    return [ids[a:b] for a, b in zip([0, *ends], ends)]


class Encoder:
    """Encodes texts by a rank file and a piece pattern; remembers up to ``most`` stretches."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, most: int = 600_000):
        self.ranks, self.most, self.pairs = ranks, most, Pairs(ranks)
        self.pieces = regex.compile(pattern)
        self.cuts = regex.compile(r"(?<=\S) (?=\S)")
        self.vocabulary = {rank: token for token, rank in ranks.items()}
        self.decimal = {rank: str(rank) for rank in self.vocabulary}
        self.known: dict[str, tuple[int, ...]] = {}

    def stretches(self, text: str) -> list[str]:
        """Stretches of a text, each with the space before it."""
        if not text:
            return []
        lines = text.split("\n")
        # a line break stands alone only between two characters that are not white space
        if not all(p and not p[0].isspace() and not p[-1].isspace() for p in lines):
            lines = [text]
        out: list[str] = []
        for line in lines:
            out.append("\n")
            parts = line.split(" ")
            if line.split() != parts:  # other white space, or several together
                parts = self.cuts.split(line)
            out.append(parts[0])
            out += [" " + p for p in parts[1:]]
        return out[1:]

    def learn(self, new: list[str]) -> None:
        """Remember the ids of stretches: their pieces, merged together by length."""
        cut = [(s,) if s.isascii() and s.removeprefix(" ").isalpha() else tuple(self.pieces.findall(s)) for s in new]
        ids: dict[str, list[int]] = {}
        by_size: dict[int, list[str]] = {}
        for p in set(chain.from_iterable(cut)):
            raw = p.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                ids[p] = [whole]
            elif len(raw) > 128:
                ids[p] = merge_piece(raw, self.ranks)
            else:
                by_size.setdefault((len(raw) - 1).bit_length(), []).append(p)
        for group in by_size.values():
            for at in range(0, len(group), 1 << 14):
                part = group[at : at + (1 << 14)]
                ids.update(zip(part, merge_many([p.encode() for p in part], self.pairs)))
        self.known.update(zip(new, (tuple(chain.from_iterable(map(ids.__getitem__, c))) for c in cut)))

    def encode_batch(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of each text. The table may outgrow its bound by what one batch holds."""
        cut = [self.stretches(t) for t in texts]
        if len(self.known) > self.most:
            self.known.clear()
        get = self.known.__getitem__
        self.learn([s for s in set(chain.from_iterable(cut)) if s not in self.known])
        for stretches in cut:
            yield list(chain.from_iterable(map(get, stretches)))

    def encode(self, text: str) -> list[int]:
        return next(self.encode_batch([text]))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder per worker process and rank file."""
    return Encoder(load_ranks(path), pattern)


def text_list(batch: pa.RecordBatch) -> list[str]:
    return [x or "" for x in batch.column("text").to_pylist()]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids: the ids of each whole text. ``path`` must exist on every executor."""

    def run(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        e = encoder(path, pattern)
        ids = pa.array(list(e.encode_batch(text_list(batch))), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), ids], ["doc_id", "ids"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, bytes: the text of each list of ids."""

    def run(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        e = encoder(path, pattern)
        out = pa.array([e.decode(ids or ()) for ids in batch.column("ids").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), out], ["doc_id", "bytes"])

    return map_arrow(rows.select("doc_id", "ids"), run, "doc_id long, bytes binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encoding each text and decoding its ids."""

    def run(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        e = encoder(path, pattern)
        n, ids_sha, text_sha = [], [], []
        for ids in e.encode_batch(text_list(batch)):
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(" ".join(map(e.decimal.__getitem__, ids)).encode()).hexdigest())
            text_sha.append(hashlib.sha256(e.decode(ids)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def counts(texts: Iterable[str], path: str, pattern: str) -> list[int]:
    """Numbers of ids, for other operators."""
    e = encoder(path, pattern)
    return [len(ids) for ids in e.encode_batch(list(texts))]


