"""SimHash near-duplicates: fingerprints, and a self-join over binary tries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.components import components
from tickloom.llm.text import Joined, byte_bounded, utf8, words_of
from tickloom.session import scratch_table

#: Word shingles of a text.
SHINGLE = 4
#: Bits in which linked fingerprints may differ.
BUDGET = 4
#: Node pairs of at most so many leaf pairs are compared leaf by leaf.
LEAF_PAIRS = 64
#: Node pairs that are expanded together.
FRONTIER = 1 << 18
#: Fingerprints below one root that a task takes; a larger root is dealt as pairs of its slots.
ROOT_ROWS = 100_000
#: Fingerprints that a task gathers before it walks their tries.
GATHER = 100_000

_LANES = np.arange(8) * 256
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """64 bits of one text; a bit is 1 if over half of the shingles' XXH64 (seed 42) have it. No words: 0."""
    words = words_of(raw.lower())
    if not words:
        return 0
    joined = Joined(words)
    length = min(shingle, len(words))
    n = len(words) - length + 1
    counts = np.zeros((8, 256), np.int64)
    digest = xxhash.xxh64_digest
    for first in range(0, n, 1 << 16):
        at = np.arange(first, min(n, first + (1 << 16)))
        hashed = b"".join([digest(x, 42) for x in joined.slices(length, at)])
        lanes = np.frombuffer(hashed, np.uint8).reshape(-1, 8) + _LANES
        counts += np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256)
    return int.from_bytes(np.packbits((counts @ _BITS).ravel() * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(id_col, fp)`` for each row; fp is the fingerprint as a signed long. A null text has no words."""

    def run(batches):
        for batch in batches:
            prints = [fingerprint(raw, shingle) for raw in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(prints, np.uint64).view(np.int64))], names=["id", "fp"])

    rows = byte_bounded(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long").withColumnRenamed("id", id_col)


def trie_links(prints: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Links ``(u, v)`` that connect all distinct ``fp`` of at most ``budget`` differing bits.

    The 64 bits are cut into ``budget + 1`` blocks. Fingerprints within the budget agree in one block at least, so
    for each block there is one forest of binary tries whose roots are the values of that block and whose further
    levels are the remaining bits. A task walks the tries of its roots: node pairs go down together, gather the bits in
    which they differ, and are dropped beyond the budget. Of the links below a root only a spanning forest is
    returned, at most one link a fingerprint and root. A root with more than ``ROOT_ROWS`` fingerprints is cut into
    slots, and every pair of slots is a task of its own.
    """
    widths = [64 // (budget + 1) + (i < 64 % (budget + 1)) for i in range(budget + 1)]
    shifts = [sum(widths[:i]) for i in range(budget + 1)]
    rotated = [
        F.struct(
            F.lit(i).alias("block"),
            F.shiftrightunsigned(turned := _rotate_left(F.col("fp"), shift), 64 - width).alias("root"),
            turned.alias("key"),
        )
        for i, (width, shift) in enumerate(zip(widths, shifts))
    ]
    rows = prints.select("fp").where("fp IS NOT NULL").distinct().select(F.explode(F.array(*rotated)).alias("x")).select("x.*")
    heavy = rows.groupBy("block", "root").count().where(F.col("count") > ROOT_ROWS)
    heavy = heavy.select("block", "root", F.ceil(F.col("count") / ROOT_ROWS).cast("int").alias("slots"))
    rows = rows.join(heavy, ["block", "root"], "left").withColumn("slots", F.coalesce("slots", F.lit(1)))
    rows = rows.withColumn("slot", F.pmod(F.xxhash64("key"), F.col("slots")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
    rows = rows.select("block", "root", F.least("slot", "other").alias("a"), F.greatest("slot", "other").alias("b"), "key")
    by = ["block", "root", "a", "b"]

    def run(batches):
        for cells in _whole_cells(batches):
            order, keys = _walk_cells(cells, budget, widths, shifts)
            yield pa.RecordBatch.from_arrays([pa.array(order.view(np.int64)), pa.array(keys.view(np.int64))], names=["u", "v"])

    return rows.repartition(*by).sortWithinPartitions(*by, "key").mapInArrow(run, "u long, v long")


def _rotate_left(col, n: int):
    return col if n == 0 else F.shiftleft(col, n).bitwiseOR(F.shiftrightunsigned(col, 64 - n))


def _whole_cells(batches) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows in sets of whole cells: block of each row, key of each row, where cells begin."""
    held: list[tuple[np.ndarray, ...]] = []
    rows = 0
    for batch in batches:
        held.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)))
        rows += batch.num_rows
        if rows >= GATHER:
            columns = [np.concatenate(x) for x in zip(*held)]
            begins = _begins(columns)
            last = begins[-1]
            if last:
                yield columns[0][:last], columns[4][:last].view(np.uint64), begins[:-1]
            held, rows = [tuple(x[last:] for x in columns)], len(columns[0]) - last
    if rows:
        columns = [np.concatenate(x) for x in zip(*held)]
        yield columns[0], columns[4].view(np.uint64), _begins(columns)


def _begins(columns) -> np.ndarray:
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for x in columns[:4]:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _walk_cells(cells, budget: int, widths: list[int], shifts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the cells' tries, as fingerprints."""
    block, keys, begins = cells
    # the sort is by signed key; within a root of width bits all keys share their sign
    roots = trie_components(keys, begins, budget, min(widths))
    at = np.flatnonzero(roots != np.arange(len(keys)))
    back = np.array(shifts, np.uint64)[block[at]]
    turn = lambda x: np.where(back == 0, x, (x >> back) | (x << ((np.uint64(64) - back) & np.uint64(63))))
    return turn(keys[at]), turn(keys[roots[at]])


def trie_components(keys: np.ndarray, begins: np.ndarray, budget: int, depth: int) -> np.ndarray:
    """For each key the first place of its component; keys below each root are sorted, and agree in ``depth`` bits.

    The budget is raised from 1 to its full value, and node pairs whose leaves are of one component already are
    dropped: a dense heap of near copies is joined at a small budget and costs nothing at the larger ones.
    """
    n = len(keys)
    parent = np.arange(n)
    ends = np.append(begins[1:], n)
    ones: dict[int, np.ndarray] = {}
    for limit in range(1, budget + 1):
        changes = np.concatenate(([0], np.cumsum(parent[1:] != parent[:-1])))
        many = ends - begins > 1
        lo, hi = begins[many], ends[many]
        stack = [(depth, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
        while stack:
            level, a0, a1, b0, b1, err = stack.pop()
            # all leaves of both nodes in one component
            open_ = (changes[a0] != changes[a1 - 1]) | (changes[b0] != changes[b1 - 1]) | (parent[a0] != parent[b0])
            a0, a1, b0, b1, err = (x[open_] for x in (a0, a1, b0, b1, err))
            small = ((a1 - a0) * (b1 - b0) <= LEAF_PAIRS) | (level == 64)
            if small.any():
                _compare_leaves(keys, parent, *(x[small] for x in (a0, a1, b0, b1)), limit)
                a0, a1, b0, b1, err = (x[~small] for x in (a0, a1, b0, b1, err))
            if not len(a0):
                continue
            if level not in ones:
                bit = (keys >> np.uint64(63 - level)) & np.uint64(1)
                ones[level] = np.concatenate(([0], np.cumsum(bit.astype(np.int32))))
            sums = ones[level]
            am, bm = a1 - (sums[a1] - sums[a0]), b1 - (sums[b1] - sums[b0])
            same = (a0 == b0) & (a1 == b1)
            moves = [(a0, am, b0, bm, 0, None), (am, a1, bm, b1, 0, None), (a0, am, bm, b1, 1, None), (am, a1, b0, bm, 1, ~same)]
            parts = []
            for p0, p1, q0, q1, differ, only in moves:
                keep = (p1 > p0) & (q1 > q0) & (err + differ <= limit)
                if only is not None:
                    keep &= only
                parts.append((p0[keep], p1[keep], q0[keep], q1[keep], (err + np.int8(differ))[keep]))
            joined = [np.concatenate(x) for x in zip(*parts)]
            for first in range(0, len(joined[0]), FRONTIER):
                stack.append((level + 1, *(x[first : first + FRONTIER] for x in joined)))
    return parent


def _compare_leaves(keys, parent, a0, a1, b0, b1, limit: int) -> None:
    """Compare all leaves of each node pair and unite those within the limit; ``parent`` is changed."""
    sizes = (a1 - a0) * (b1 - b0)
    bounds = np.append(0, np.cumsum(sizes))
    first = 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + (1 << 20), "right")) - 1)
        size = sizes[first:last]
        pair = np.repeat(np.arange(first, last), size)
        inner = np.arange(len(pair)) - np.repeat(bounds[first:last] - bounds[first], size)
        width = (b1 - b0)[pair]
        i, j = a0[pair] + inner // width, b0[pair] + inner % width
        near = (i < j) & (np.bitwise_count(keys[i] ^ keys[j]) <= limit)
        _unite(parent, i[near], j[near])
        first = last


def _unite(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Unite components; each place points to the first place of its component before and after."""
    while len(i):
        p, q = parent[i], parent[j]
        apart = p != q
        if not apart.any():
            return
        i, j, p, q = i[apart], j[apart], p[apart], q[apart]
        np.minimum.at(parent, np.maximum(p, q), np.minimum(p, q))
        while not np.array_equal(up := parent[parent], parent):
            parent[:] = up


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """``(id_col, fingerprint, component_id)`` for each row of ``docs``.

    ``component_id`` is the smallest id that can be reached over links of at most ``budget`` differing bits.
    Null and empty texts have fingerprint zero and are linked like any other; a text of fewer words than a shingle is
    one shingle; equal fingerprints are one component. Rows that repeat stay rows. A null id takes part and is never
    the smallest, unless the component has no other. An empty table gives an empty result; further columns, whatever
    their names, are not read.
    """
    prints = scratch_table(fingerprints(docs, id_col, text_col, shingle).withColumnRenamed(id_col, "id"))
    roots = components(trie_links(prints, budget)).withColumnRenamed("id", "fp")
    least = prints.groupBy("fp").agg(F.min("id").alias("least"))
    least = least.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = scratch_table(least)
    named = least.groupBy("root").agg(F.min("least").alias("component_id"))
    named = least.join(named, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
