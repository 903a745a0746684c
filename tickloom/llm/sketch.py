"""Bit tables over 64-bit hashes: a filter of bounded size for any number of hashes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a filter: a hash in sixteen bits, from 2^16 to 2^28. A fuller filter lets more pass, and never holds back what it was made of.
FILTER_BITS = (16, 28)


class Filter:
    """A set of hashes by some of their bits; others may pass too."""

    def __init__(self, bits: int, cells: np.ndarray):
        self.shift, self.cells = np.uint64(64 - bits), cells

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> self.shift
        return (self.cells[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def filter_of(hashes: DataFrame) -> Filter:
    """The filter of the column ``hash``: bits are set in tasks and joined by words of 64; at most 2^28 bits come to the driver."""
    n = hashes.count()
    bits = min(max(FILTER_BITS[0], int(np.ceil(np.log2(16 * n + 1)))), FILTER_BITS[1])
    at = F.shiftrightunsigned("hash", 64 - bits)
    cells = hashes.select(F.shiftright(at, 6).alias("cell"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - bits}) & 63 AS int))").alias("bit"))
    found = cells.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return Filter(bits, out.astype("<i8").view(np.uint8))
