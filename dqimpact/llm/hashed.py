"""Hashes of words inside tasks, and counts of hashes over a whole table in a fixed number of buckets."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

RANGES = 64
# Words whose hash a task remembers; beyond it the memory starts anew.
REMEMBERED = 500_000
# Odd multipliers, one for each place in a run of words.
_SEED = 0x9E3779B97F4A7C15


class WordHashes(dict):
    """The 64-bit hash of a word given as bytes, computed at the first request."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of `width` consecutive word hashes."""
    places = len(hashes) - width + 1
    if places <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(places, np.uint64)
    for i in range(width):
        total += hashes[i : i + places] * np.uint64((_SEED * (2 * i + 1) + 2 * i) & 0xFFFFFFFFFFFFFFFF | 1)
    return mixed(total)


def hashed_counts(
    df: DataFrame,
    batch_hashes: Callable[[pa.RecordBatch], Iterable[np.ndarray]],
    bits: int,
    finish: Callable[[np.ndarray], np.ndarray],
) -> np.ndarray:
    """Count the hashes of every row of `df` in 2**bits buckets, the top bits of a hash.

    Each task sums up its own rows and sends on what it has, packed, in 64 ranges of buckets; the
    ranges are summed in a stream, a batch at a time.  `finish` turns the counts of a range into what
    the driver is to have: the result has 2**bits values, whatever the size of the table.
    """
    width = (1 << bits) // RANGES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = None
        for batch in batches:
            for hashes in batch_hashes(batch):
                if counts is None:
                    counts = np.zeros(1 << bits, np.uint32)
                np.add.at(counts, (hashes >> np.uint64(64 - bits)).astype(np.int64), 1)
        if counts is None:
            return
        for k in range(RANGES):
            part = counts[k * width : (k + 1) * width]
            top = int(part.max())
            if top:
                small = part.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32)
                packed = zlib.compress(small.tobytes(), 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int32()), pa.array([small.itemsize], pa.int32()), pa.array([packed], pa.binary())],
                    names=["part", "item", "packed"],
                )

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, item, packed in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                part = np.frombuffer(zlib.decompress(packed), f"<u{item}")
                if k in sums:
                    sums[k] += part
                else:
                    sums[k] = part.astype(np.uint64)
        for k, part in sums.items():
            done = zlib.compress(finish(part).tobytes(), 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k], pa.int32()), pa.array([done], pa.binary())], names=["part", "packed"]
            )

    rows = (
        df.mapInArrow(count, "part int, item int, packed binary")
        .repartition(RANGES, "part")
        .mapInArrow(total, "part int, packed binary")
        .collect()
    )
    empty = finish(np.zeros(width, np.uint64))
    whole = np.tile(empty, RANGES)
    for row in rows:
        whole[row["part"] * width : (row["part"] + 1) * width] = np.frombuffer(zlib.decompress(row["packed"]), empty.dtype)
    return whole
