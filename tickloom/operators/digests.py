"""Quantile digests: centroids that tasks build, that merge, and that are stored in place of the values.

A digest is an array of ``(mean, weight)`` in order of the means. A centroid may hold the more weight the nearer it is
to the median: with ``compression`` c its share of all weight at the quantile q is at most ``pi / c * sqrt(q (1 - q))``, so a digest has about c centroids and the
rank of what it answers is off by about half a centroid. Fewer values than that are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Centroids of a digest, at about.
COMPRESSION = 200
#: Values or centroids that a task reduces together, rows that it takes up at once, and partial digests of a key that are merged at first in so many slots.
BLOCK_ROWS, SLICE_ROWS, SLOTS = 1 << 18, 1 << 10, 32

DIGEST = "array<struct<mean: double, weight: double>>"
_DIGEST = pa.list_(pa.struct([("mean", pa.float64()), ("weight", pa.float64())]))


def compressed(group: np.ndarray, value: np.ndarray, weight: np.ndarray, compression: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(group, mean, weight)`` of the centroids of each group, in order."""
    order = np.lexsort((value, group))
    group, value, weight = group[order], value[order], weight[order]
    begins = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(begins, len(group)))
    total = np.repeat(np.add.reduceat(weight, begins), sizes) if len(group) else weight
    ahead = np.cumsum(weight)
    ahead = ahead - np.repeat((ahead - weight)[begins], sizes) - weight / 2
    q = np.clip(ahead / total, 0.0, 1.0)
    cell = np.floor(compression * (np.arcsin(2 * q - 1) / np.pi + 0.5))
    few = np.repeat(sizes <= compression, sizes)
    new = np.append(True, (group[1:] != group[:-1]) | (cell[1:] != cell[:-1]) | few[1:]) if len(group) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    if not len(at):
        return group, value, weight
    sums = np.add.reduceat(weight, at)
    return group[at], np.add.reduceat(weight * value, at) / sums, sums


def _arrow(schema, names: Sequence[str]) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(schema[n].dataType) for n in names]


def _size(table: pa.Table | pa.RecordBatch) -> int:
    """Values of a table: its rows, or the centroids of its digests."""
    return pc.sum(pc.list_value_length(table.column("digest"))).as_py() or 0 if "digest" in table.schema.names else table.num_rows


def _tables(batches, keys: int, whole: bool) -> Iterator[pa.Table]:
    """Rows in blocks of ``BLOCK_ROWS`` values; with ``whole`` the rows are in order of the first ``keys`` columns, and no key is cut."""
    held, size = [], 0
    for batch in (b.slice(i, SLICE_ROWS) for b in batches for i in range(0, b.num_rows, SLICE_ROWS)):
        held.append(batch)
        size += _size(batch)
        if size < BLOCK_ROWS:
            continue
        table = pa.Table.from_batches(held)
        cut = table.num_rows
        if whole:
            last = table.slice(table.num_rows - 1).select(range(keys)).to_pylist()[0]
            while cut and table.slice(cut - 1, 1).select(range(keys)).to_pylist()[0] == last:
                cut -= 1
            if not cut:
                continue
        yield table.slice(0, cut)
        held = table.slice(cut).to_batches()
        size = sum(map(_size, held))
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def _grouped(table: pa.Table, keys: Sequence[str]) -> tuple[np.ndarray, pa.Table]:
    """A number for each row's key, and the keys by number."""
    numbered = table.select(keys).append_column("_row", pa.array(np.arange(table.num_rows)))
    first = numbered.group_by(list(keys)).aggregate([("_row", "min")])
    spread = numbered.join(first.append_column("_group", pa.array(np.arange(first.num_rows))).drop(["_row_min"]), list(keys))
    group = np.empty(table.num_rows, np.int64)
    group[spread["_row"].to_numpy()] = spread["_group"].to_numpy()
    return group, first.select(keys)


def _digest_batch(table: pa.Table, keys: Sequence[str], types: list[pa.DataType], group, value, weight, compression: int) -> pa.RecordBatch:
    number, mean, size = compressed(group, value, weight, compression)
    begins = np.append(np.flatnonzero(np.append(True, number[1:] != number[:-1])), len(number)).astype(np.int32)
    columns = [table[k].combine_chunks().take(pa.array(number[begins[:-1]])).cast(t) for k, t in zip(keys, types)]
    cells = pa.StructArray.from_arrays([pa.array(mean), pa.array(size)], names=["mean", "weight"])
    return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(begins), cells)], names=[*keys, "digest"])


def partial_digests(values: DataFrame, keys: Sequence[str], value: str = "value", weight: str = "weight", compression: int = COMPRESSION) -> DataFrame:
    """``(keys, digest)`` of the rows that a task reads together; a key has many. Nothing is shuffled.

    Null values and weights that are not above zero take no part. Keys must not be null.
    """
    rows = values.where(F.col(value).isNotNull() & (F.col(weight) > 0)).select(*keys, F.col(value).cast("double").alias("value"), F.col(weight).cast("double").alias("weight"))
    types = _arrow(rows.schema, keys)

    def run(batches):
        for table in _tables(batches, len(keys), False):
            group, known = _grouped(table, keys)
            yield _digest_batch(known, keys, types, group, table["value"].to_numpy(), table["weight"].to_numpy(), compression)

    return rows.mapInArrow(run, ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys) + f", digest {DIGEST}")


def merged_digests(partials: DataFrame, keys: Sequence[str], compression: int = COMPRESSION) -> DataFrame:
    """One digest for each key: partial ones are merged in slots first, then the slots, so a key with very many is no single task's."""
    slotted = partials.select(*keys, F.pmod(F.xxhash64("digest"), F.lit(SLOTS)).cast("int").alias("_slot"), "digest")
    return _merge(_merge(slotted, [*keys, "_slot"], compression).drop("_slot"), keys, compression)


def _merge(partials: DataFrame, keys: Sequence[str], compression: int) -> DataFrame:
    types = _arrow(partials.schema, keys)

    def run(batches):
        for table in _tables(batches, len(keys), True):
            digests = table["digest"].combine_chunks()
            group, known = _grouped(table, keys)
            cells = digests.flatten()
            group = np.repeat(group, digests.value_lengths().to_numpy())
            yield _digest_batch(known, keys, types, group, cells.field("mean").to_numpy(), cells.field("weight").to_numpy(), compression)

    schema = ", ".join(f"{k} {partials.schema[k].dataType.simpleString()}" for k in keys) + f", digest {DIGEST}"
    return partials.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def quantile_digests(values: DataFrame, keys: Sequence[str], value: str = "value", weight: str = "weight", compression: int = COMPRESSION) -> DataFrame:
    """``(keys, digest)`` for each key of a table of weighted values."""
    return merged_digests(partial_digests(values, keys, value, weight, compression), keys, compression)


def total_weight(digest: Column) -> Column:
    return F.aggregate(digest, F.lit(0.0), lambda a, c: a + c["weight"])


def digest_quantile(digest: Column, fraction: float) -> Column:
    """The value of which a share ``fraction`` of all weight is below. Null for no digest.

    Between centroids along the line from middle to middle; a centroid of more than a hundredth of all weight is one value, and answers for all of it but half a hundredth at its ends.
    """
    all_ = total_weight(digest)
    wanted = F.lit(fraction) * all_
    start = F.struct(F.lit(0.0).alias("before"), F.lit(None).cast("double").alias("knot"), F.lit(None).cast("double").alias("mean"), F.lit(None).cast("double").alias("found"))

    def step(a: Column, c: Column) -> Column:
        end = F.least(c["weight"], 0.01 * all_) / 2
        first, last = a["before"] + end, a["before"] + c["weight"] - end
        share = (wanted - a["knot"]) / (first - a["knot"])
        here = F.when(last >= wanted, F.when(wanted < first, F.coalesce(a["mean"] + share * (c["mean"] - a["mean"]), c["mean"])).otherwise(c["mean"]))
        return F.struct((a["before"] + c["weight"]).alias("before"), last.alias("knot"), c["mean"].alias("mean"), F.coalesce(a["found"], here).alias("found"))

    return F.aggregate(digest, start, step, lambda a: F.coalesce(a["found"], a["mean"]))
