"""Ordered prefix computations that never put a whole key into one task.

A window over a key sorts all of that key's rows in one task, which fails when one
market holds a large share of the data.  Here a key's rows are cut into chunks by a
deterministic expression that grows with the order.  Each chunk is summarised by a
partial aggregate, the few chunk summaries of a key are scanned, and every row then
combines its chunk's starting value with a window inside its own chunk.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.session import scratch_table

CHUNK = "_chunk"

#: Rows of a key that one task takes in order.
ROWS_PER_KEY = 1_000_000
#: Hashes of keys by which rows are counted first.
KEY_CELLS = 1 << 14


def large_keys(df: DataFrame, keys: Sequence[str], rows: int = ROWS_PER_KEY) -> tuple[DataFrame | None, int]:
    """Keys of more than ``rows`` rows, as a written table (None where there are none), and the tasks that all rows make of about so many. Null keys are never large.

    Rows are counted by hashes of their keys, which tasks add up to ``KEY_CELLS`` numbers each; keys themselves are counted only where a hash has more than ``rows`` rows.
    """
    seen = Observation()
    cell = F.pmod(F.xxhash64(*keys), F.lit(KEY_CELLS))
    cells = df.groupBy(cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_n")).observe(seen, F.sum("_n").alias("n"))
    full = [r[0] for r in cells.filter(F.col("_n") > rows).select("_cell").collect()]
    tasks = -(-(seen.get["n"] or 0) // rows)
    if not full:
        return None, tasks
    counts = df.select(*keys).filter(cell.isin(full)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    many = scratch_table(counts.filter(F.col("_n") > rows).select(*keys).dropna())
    return None if many.isEmpty() else many, tasks


def dealt(df: DataFrame, tasks: int, *columns: str) -> DataFrame:
    """Rows by hash of ``columns``, to ``tasks`` tasks where these are more than the session's own number, so that what a task sorts stays in memory."""
    own = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, *columns) if tasks > own else df.repartition(*columns)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    *,
    sums: Mapping[str, Column] | None = None,
    maxes: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    totals: bool = False,
    inclusive: bool = False,
    one_chunk: bool = False,
) -> DataFrame:
    """Add running columns over ``keys`` in ``order``.

    ``sums`` and ``maxes`` are running sums and maxima, ``lasts`` the newest non-null
    value.  They cover the rows strictly before the current one, or include it when
    ``inclusive``.  With ``totals`` each sum also gets ``<name>_total`` over its key.
    ``chunk`` must not decrease along ``order``; keys must not be null.  ``one_chunk`` is for
    callers that know every key to be small: then a plain window is enough.
    """
    sums, maxes, lasts = dict(sums or {}), dict(maxes or {}), dict(lasts or {})
    frame = (Window.unboundedPreceding, 0 if inclusive else -1)
    if one_chunk:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*frame)
        return df.select(
            "*",
            *(F.coalesce(F.sum(e).over(w), F.lit(0)).alias(n) for n, e in sums.items()),
            *(F.max(e).over(w).alias(n) for n, e in maxes.items()),
            *(F.last(e, ignorenulls=True).over(w).alias(n) for n, e in lasts.items()),
            *((F.sum(e).over(Window.partitionBy(*keys)).alias(f"{n}_total") for n, e in sums.items()) if totals else ()),
        )
    value = {n: f"_v_{n}" for n in (*sums, *maxes, *lasts)}
    part = [*keys, CHUNK]
    rows = df.withColumns({CHUNK: chunk, **{value[n]: e for n, e in {**sums, **maxes, **lasts}.items()}})
    position = F.col(order[0]) if len(order) == 1 else F.struct(*order)

    summary = rows.groupBy(*part).agg(
        F.count(F.lit(1)).alias("_n"),
        *(F.sum(value[n]).alias(f"_t_{n}") for n in sums),
        *(F.max(value[n]).alias(f"_t_{n}") for n in maxes),
        *(F.max_by(F.col(value[n]), F.when(F.col(value[n]).isNotNull(), position)).alias(f"_t_{n}") for n in lasts),
    )
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    starts = summary.select(
        *part,
        *(F.sum(f"_t_{n}").over(earlier).alias(f"_s_{n}") for n in sums),
        *(F.max(f"_t_{n}").over(earlier).alias(f"_s_{n}") for n in maxes),
        *(F.last(f"_t_{n}", ignorenulls=True).over(earlier).alias(f"_s_{n}") for n in lasts),
        *((F.sum(f"_t_{n}").over(whole).alias(f"{n}_total") for n in sums) if totals else ()),
    )

    inside = Window.partitionBy(*part).orderBy(*order).rowsBetween(*frame)

    def combine(name: str) -> Column:
        start, local = F.col(f"_s_{name}"), F.col(value[name])
        if name in sums:
            zero = F.lit(0)
            return F.coalesce(start, zero) + F.coalesce(F.sum(local).over(inside), zero)
        if name in maxes:
            return F.greatest(start, F.max(local).over(inside))
        return F.coalesce(F.last(local, ignorenulls=True).over(inside), start)

    keep = [*df.columns, *((f"{n}_total" for n in sums) if totals else ())]
    return rows.join(starts, part, "left").select(*keep, *(combine(n).alias(n) for n in value))


def time_chunk(time_ms: str | Column, chunk_ms: int) -> Column:
    """Chunk expression for time-ordered rows: fixed slices of time."""
    t = F.col(time_ms) if isinstance(time_ms, str) else time_ms
    return F.floor(t / F.lit(chunk_ms)).cast("bigint")


def each_step(df: DataFrame, first: Column, last: Column, step: int, name: str, spread: bool = False, per_row: int = 4096) -> DataFrame:
    """One row per step of ``step`` from ``first`` to ``last`` as ``name``; none where ``first`` is above ``last``.

    Steps are made in blocks of ``per_row``, so that a long span isn't one array of one row.
    ``spread`` deals the blocks to all tasks first, for inputs of few rows with long spans.
    """
    by = F.lit(step).cast("bigint")
    block = by * per_row
    spans = df.withColumns({"_first": first, "_last": last}).filter("_first <= _last")
    blocks = spans.withColumn("_block", F.explode(F.sequence("_first", "_last", block)))
    blocks = blocks.repartition("_block", *df.columns) if spread else blocks
    end = F.least(F.col("_block") + block - by, F.col("_last"))
    return blocks.withColumn(name, F.explode(F.sequence("_block", end, by))).drop("_first", "_last", "_block")
