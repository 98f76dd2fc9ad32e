"""A set of 64-bit hashes as a bitmap of fixed size: members are always found, others are found by mistake at times.

The size is a parameter, so what is collected and broadcast has a bound that does not depend on the input:
``1 << log_bits`` bits, 8 MB by default. A bitmap that holds too many members finds everything; who uses it
must then do more work, never other work.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

LOG_BITS = 26
#: Odd factors; each gives one position per hash.
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def slots(hashes: np.ndarray, words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word and bit of each hash, once per factor."""
    shift = np.uint64(64 - 6 - (words.bit_length() - 1))
    for factor in FACTORS:
        at = (hashes ^ (hashes >> np.uint64(31))) * factor >> shift
        yield at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63))


def holds(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each hash, whether it may be a member."""
    found = np.ones(len(hashes), bool)
    for word, bit in slots(hashes, len(bits)):
        found &= bits[word] & bit != 0
    return found


def packed(bits: np.ndarray) -> bytes:
    """For the broadcast: a bitmap that is mostly empty takes little room on the executors' disks."""
    return pa.compress(bits.tobytes(), codec="zstd", asbytes=True)


@lru_cache(maxsize=3)
def unpacked(data: bytes, words: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, words * 8, codec="zstd", asbytes=True), np.uint64)


def bitmap(hashes: DataFrame, log_bits: int = LOG_BITS) -> np.ndarray:
    """The bitmap of ``hashes``: h (long). Bits meet in the tasks, then by word; the driver gets each word once."""
    words = 1 << (log_bits - 6)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = np.zeros(words, np.uint64)
        h = batch.column(0).to_numpy().view(np.uint64)
        for word, bit in slots(h, words):
            np.bitwise_or.at(own, word, bit)
        used = np.flatnonzero(own)
        yield pa.record_batch([pa.array(used), pa.array(own[used].view(np.int64))], names=["word", "bits"])

    found = map_arrow(hashes.select("h"), run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(words, np.uint64)
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return bits
