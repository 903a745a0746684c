"""Latest-value state in batch, change detection, and top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.operators.prefix import running, time_chunk

DAY_MS = 86_400_000


def _latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the greatest by ``order``, then by all columns, so that a re-run agrees.

    A single partial aggregate: a hot key is reduced before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    picked = F.max(F.struct(*(o.alias(f"_o{i}") for i, o in enumerate(order)), *rest)).alias("_r")
    return df.groupBy(*keys).agg(picked).select(*(F.col(c) if c in keys else F.col("_r")[c].alias(c) for c in df.columns))


def latest_by(
    df: DataFrame, keys: Sequence[str], ts: str = "ts", tie: str | None = None, keep: str = "last"
) -> DataFrame:
    """Newest record per key.

    At equal times the last arrival wins (``keep='last'``: a record replaces one of the
    same time) or the first (``keep='first'``: only a later time replaces).
    """
    order = [F.col(ts)]
    if tie is not None:
        order.append(F.col(tie) if keep == "last" else -F.col(tie))
    return _latest(df, keys, order)


def latest_funding(
    df: DataFrame, keys: Sequence[str] = ("inst_id",), ts: str = "ts", funding_time: str = "funding_time",
    tie: str | None = "arrival",
) -> DataFrame:
    """Newest funding record per key, where a record is only accepted when its time is later
    and its funding time not earlier than those of the accepted one.

    For records taken in time order that is the latest record among those with the
    greatest funding time.  (The streaming form keeps the arrival order.)
    """
    order = [F.col(funding_time), F.col(ts)] + ([-F.col(tie)] if tie else [])
    return _latest(df, keys, order)


def drop_unchanged(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], order: Sequence[str], chunk_ms: int = DAY_MS
) -> DataFrame:
    """Rows whose tracked columns differ from the row before (the first of each key always)."""
    tracked = F.struct(*(F.col(c).alias(c) for c in columns))
    seen = running(df, keys, list(order), time_chunk(order[0], chunk_ms), lasts={"_before": tracked})
    same = F.col("_before").isNotNull()
    for c in columns:
        same = same & F.col("_before")[c].eqNullSafe(F.col(c))
    return seen.filter(~same).drop("_before")


def content_hash(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "content_hash") -> DataFrame:
    """Digest of each key's rows for change detection.

    Row hashes are combined by count, XOR and sum, so no group is collected.  Rows carry
    their identity among ``columns``, hence two sets agree exactly when their sorted lists do.
    """
    h = F.xxhash64(*columns)
    return (
        df.withColumn("_h", h)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.bit_xor("_h").alias("_x"),
            F.sum(F.shiftright("_h", 32)).alias("_s"),
        )
        .select(*keys, F.xxhash64("_n", "_x", "_s").alias(name))
    )


def top_k_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None
) -> DataFrame:
    """The first ``k`` rows of each key in ``order``.

    Spark limits each task's rows per key before the shuffle (window group limit), so a hot
    key sends at most ``k`` rows per task.  End ``order`` with a unique column.
    """
    position = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    ranked = df.withColumn(rank or "_rank", position).filter(F.col(rank or "_rank") <= k)
    return ranked if rank else ranked.drop("_rank")


def latest_n(df: DataFrame, n: int, time_col: str = "time_ms", tie: Sequence[str] = ()) -> DataFrame:
    """The newest ``n`` rows."""
    return df.orderBy(F.col(time_col).desc(), *(F.col(c).desc() for c in tie)).limit(n)


def ordered(df: DataFrame, *columns: str, within_partitions: bool = False) -> DataFrame:
    """Rows sorted overall, or only inside each partition."""
    return df.sortWithinPartitions(*columns) if within_partitions else df.orderBy(*columns)


def new_rows(
    batch: DataFrame, stored: DataFrame, keys: Sequence[str] = ("market", "id"), time_col: str = "time_ms",
    lookback_ms: int | None = None,
) -> DataFrame:
    """Rows of a batch that are not stored yet, each id once.

    ``lookback_ms`` limits the stored rows looked at to the batch's time range, widened by
    that much, so that a large table is pruned; leave it out when ids may return at any time.
    """
    from tickloom.operators.bars import trade_dedupe

    known = stored
    if lookback_ms is not None:
        lo, hi = batch.agg(F.min(time_col), F.max(time_col)).first()
        if lo is not None:
            known = known.filter((F.col(time_col) >= lo - lookback_ms) & (F.col(time_col) <= hi + lookback_ms))
    return trade_dedupe(batch, keys).join(known.select(*keys), list(keys), "left_anti")


def merge_pages(newer: DataFrame, older: DataFrame, keys: Sequence[str] = ("market", "id")) -> DataFrame:
    """An older page put before a batch, each id once."""
    from tickloom.operators.bars import trade_dedupe

    return trade_dedupe(newer.unionByName(older), keys)


def sequence_gaps(updates: DataFrame, chunk_ids: int = 1_000_000, resets: DataFrame | None = None) -> DataFrame:
    """Updates of a symbol with ``resync``: where the book must be fetched again.

    Per update message (``symbol, first_id, final_id, prev_id, event_ms``) in id order: the
    book is empty (first message), the message does not continue the last id, or it names
    another predecessor.  The last id is the greatest seen.

    ``resets`` ``(symbol, at_id, last_id)`` start a book anew before the first update from ``at_id`` on: a snapshot with its last id, or a
    dropped or empty book with none. The greatest id is then that since the last reset: resets are numbered by a running sum, and the running maximum is taken in each
    number; both go by chunks of ids, so a symbol is spread over tasks.
    """
    order, chunk = ["final_id", "first_id", "event_ms"], F.floor(F.col("final_id") / chunk_ids)
    if resets is None:
        seen = running(updates, ["symbol"], order, chunk, maxes={"last_id": F.greatest("final_id", "first_id")})
    else:
        none = F.lit(None).cast("bigint")
        starts = resets.select(
            "symbol", F.lit(0).cast("bigint").alias("first_id"), F.col("at_id").alias("final_id"), none.alias("prev_id"), F.lit(0).cast("bigint").alias("event_ms"),
            F.lit(0).alias("_kind"), F.col("last_id").alias("_value"),
        )
        rows = updates.withColumns({"_kind": F.lit(1), "_value": F.greatest("final_id", "first_id")}).unionByName(starts, allowMissingColumns=True)
        order = ["final_id", "_kind", "first_id", "event_ms"]
        numbered = running(rows, ["symbol"], order, chunk, sums={"_book": 1 - F.col("_kind")}, inclusive=True)
        seen = running(numbered, ["symbol", "_book"], order, chunk, maxes={"last_id": F.col("_value")})
        seen = seen.filter("_kind = 1").drop("_kind", "_value", "_book")
    gap = (
        F.col("last_id").isNull()
        | (F.col("prev_id").isNull() & (F.col("first_id") - F.col("last_id") > 1))
        | (F.col("prev_id").isNotNull() & (F.col("prev_id") != F.col("last_id")))
    )
    return seen.withColumn("resync", F.coalesce(gap, F.lit(False)))


def close_candles(candles: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Candles without an unfinished last one, per key.

    The last candle goes when it is the only one and spans less than a minute, when it
    opens with the first one, or when its span is shorter than the first one's.
    """
    record = F.struct("open_time", "close_time")
    ends = candles.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min(record).alias("_first"), F.max(record).alias("_last")
    )
    length = lambda r: F.col(r)["close_time"] - F.col(r)["open_time"]
    unfinished = F.when(F.col("_n") == 1, length("_last") < 59_999).otherwise(
        (F.col("_first")["open_time"] == F.col("_last")["open_time"]) | (length("_first") > length("_last"))
    )
    ends = ends.select(*keys, F.when(unfinished, F.col("_last")).alias("_cut"))
    joined = candles.join(ends, list(keys))
    return joined.filter(F.col("_cut").isNull() | (record != F.col("_cut"))).drop("_cut")
