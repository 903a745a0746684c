"""Texts inside Arrow tasks: bytes of a column, words, and hashes of word windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Arrow batches are cut at this many bytes, so that a run of very long texts stays small in memory.
BATCH_BYTES = 16 << 20
#: Words of a text that are hashed together.
BLOCK_WORDS = 50_000
#: A longer word stands as its digest before windows are hashed; equal words stay equal.
LONG_WORD = 256

_MASK = (1 << 64) - 1
_MULT = 0x9E3779B97F4A7C15
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def byte_bounded(df: DataFrame) -> DataFrame:
    """Have Spark cut the Arrow batches of this session by bytes as well as by rows."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def utf8(column: pa.Array) -> list[bytes]:
    """The bytes of each text; null is the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def words_of(raw: bytes) -> list[bytes]:
    """Runs of bytes other than space and 0x09 to 0x0D."""
    return raw.split()


class Joined:
    """Words joined by one space, with the place of each word in the bytes."""

    def __init__(self, words: list[bytes]):
        self.bytes = b" ".join(words)
        gaps = np.flatnonzero(np.frombuffer(self.bytes, np.uint8) == 32)
        self.starts = np.concatenate(([0], gaps + 1))
        self.ends = np.concatenate((gaps, [len(self.bytes)]))

    def slices(self, length: int, at: np.ndarray | None = None) -> Iterator[bytes]:
        """The bytes of each window of ``length`` words, or of those that start at ``at``."""
        whole = self.bytes
        starts, ends = self.starts[: len(self.starts) - length + 1], self.ends[length - 1 :]
        if at is not None:
            starts, ends = starts[at], ends[at]
        return (whole[a:b] for a, b in zip(starts.tolist(), ends.tolist()))

    def hashes(self, length: int) -> np.ndarray:
        """A 64-bit polynomial hash of each window: good for filters, not for proof of equality."""
        up, down = powers(len(self.bytes) + 1)
        sums = np.zeros(len(self.bytes) + 1, np.uint64)
        np.cumsum((np.frombuffer(self.bytes, np.uint8).astype(np.uint64) + np.uint64(1)) * up[: len(self.bytes)], out=sums[1:])
        starts, ends = self.starts[: len(self.starts) - length + 1], self.ends[length - 1 :]
        return mixed((sums[ends] - sums[starts]) * down[starts])


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, modulo 2^64."""
    global _powers
    if len(_powers[0]) < n:
        made = []
        for base in (_MULT, pow(_MULT, -1, 1 << 64)):
            steps = np.full(max(n, 1 << 16), base, np.uint64)
            steps[0] = 1
            made.append(np.cumprod(steps, dtype=np.uint64))
        _powers = (made[0], made[1])
    return _powers


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def blocks(words: list[bytes], overlap: int) -> Iterator[tuple[int, Joined]]:
    """Consecutive blocks of a text's words with the place of each block's first word.

    Neighbours share ``overlap`` words, so that every window of ``overlap + 1`` words lies in one block.
    """
    if words and len(max(words, key=len)) > LONG_WORD:
        words = [w if len(w) <= LONG_WORD else hashlib.sha256(w).hexdigest().encode() for w in words]
    step = max(BLOCK_WORDS, 4 * overlap)
    for first in range(0, max(1, len(words) - overlap), step):
        yield first, Joined(words[first : first + step + overlap])
