"""Streaming forms of the bar, dedupe, latest-value and ingest operators."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickloom.functions.scalars import bucket_start
from tickloom.operators.bars import flow_columns, ohlc_columns, series_bounds, trade_order
from tickloom.operators.filters import valid_trades
from tickloom.operators.latest import close_candles
from tickloom.session import scratch_table

log = logging.getLogger(__name__)

# Where collection starts without earlier data (2020-01-01 UTC), and how fresh is fresh enough.
START_MS = 1_577_836_800_000
FRESH_MS = 60_000


def with_event_time(df: DataFrame, delay: str, time_col: str = "time_ms") -> DataFrame:
    """Event time and watermark from an epoch-millisecond column."""
    return df.withColumn("event_time", F.timestamp_millis(time_col)).withWatermark("event_time", delay)


def stream_dedupe(trades: DataFrame, delay: str = "1 hour", keys: Sequence[str] = ("market", "id")) -> DataFrame:
    """Trades whose id was not seen before, within the watermark; state is dropped behind it."""
    return with_event_time(trades, delay).dropDuplicatesWithinWatermark(list(keys)).drop("event_time")


def stream_bars(
    trades: DataFrame, period_ms: int, offset_ms: int = 0, delay: str = "1 hour", dedupe: bool = True
) -> DataFrame:
    """Closed bars of a stream: open, high, low, close, volume, count, flow ratios, trade id.

    Tumbling windows with incremental state; the open bucket is not emitted before the
    watermark passes its end.  Columns that depend on the order inside a bucket come from
    :func:`bar_refresher`.
    """
    timed = with_event_time(valid_trades(trades), delay)
    if dedupe:
        timed = timed.dropDuplicatesWithinWatermark(["market", "id"])
    period, shift = f"{period_ms} milliseconds", f"{offset_ms} milliseconds"
    bucket = F.window("event_time", period, period, shift)
    columns = {**ohlc_columns(), **flow_columns()}
    bars = timed.withColumn("_ord", trade_order()).groupBy("market", bucket.alias("w")).agg(*(c.alias(n) for n, c in columns.items()))
    long = lambda x: F.lit(x).cast("bigint")
    return bars.select(
        "market", long(period_ms).alias("period_ms"), long(offset_ms).alias("offset_ms"),
        F.unix_millis(F.col("w")["start"]).alias("time_ms"), *columns,
    )


def bar_refresher(
    trade_path: str, bar_path: str, periods_ms: Sequence[int], offsets_ms: Sequence[int] | None = None,
    lookback_ms: int | None = None,
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: store a batch's new trades, then recompute every bar they made stale.

    Buckets from a batch's first trade of a market on are checked: all bars are recomputed from the first one on whose trades are not those of its bar, also
    where a trade came late into its middle; copies of known trades make nothing stale. Trades are read from the last good bar
    before that, and only the dates from there on. What is stale is noted beside the bars until they are written, so a batch that failed
    between two dates is made good when it is repeated; a repeated batch that was done changes nothing.
    """
    from tickloom.operators.bars import bucketed, changed_from, refresh_stale_bars
    from tickloom.sinks.tables import append_trades, day_of, read_bars, write_bars

    offsets = list(offsets_ms or [0] * len(periods_ms))
    keys = ["market", "period_ms", "offset_ms"]
    notes = f"{bar_path}-stale"

    def on_batch(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        append_trades(batch, trade_path, lookback_ms)
        bars = read_bars(spark, bar_path)

        def stored_trades(buckets: DataFrame) -> tuple[DataFrame, DataFrame] | None:
            """Stored trades and bars of each market from its first of these buckets on."""
            low = scratch_table(buckets.groupBy("market").agg(F.min("_bucket").alias("_low")))
            since = low.agg(F.min(day_of("_low"))).first()[0]
            if since is None:
                return None
            recent = lambda df: df.join(low, "market").filter(F.col("time_ms") >= F.col("_low")).drop("_low")
            return recent(spark.read.parquet(trade_path).filter(F.col("date") >= F.lit(since)).drop("date")), recent(bars)

        first = batch.groupBy("market").agg(F.min("time_ms").alias("_first"))
        series = F.explode(F.array(*(F.struct(F.lit(p).cast("bigint").alias("period_ms"), F.lit(o).cast("bigint").alias("offset_ms"), bucket_start("_first", p, o).alias("_bucket")) for p, o in zip(periods_ms, offsets))))
        first = scratch_table(first.select("market", series.alias("_s")).select("market", "_s.*"))
        touched = stored_trades(first)
        if touched is None:
            return
        rows = bucketed(valid_trades(touched[0]), periods_ms, offsets).join(first, keys).filter("bucket_ms >= _bucket")
        changed_from(touched[1], rows).write.parquet(f"{notes}/{uuid.uuid4().hex}")
        files = _Files(spark)
        noted = [f"{notes}/{x}" for x in files.names(notes)]
        noted_rows = spark.read.schema("market string, period_ms bigint, offset_ms bigint, stale_ms bigint").parquet(*noted)
        stale = noted_rows.groupBy(*keys).agg(F.min("stale_ms").alias("stale_ms"))
        before = bars.join(stale, keys).filter(F.col("time_ms") < F.col("stale_ms")).groupBy(*keys).agg(F.max("time_ms").alias("_bucket"))
        touched = stored_trades(stale.withColumnRenamed("stale_ms", "_bucket").unionByName(before))
        if touched is not None:
            write_bars(refresh_stale_bars(touched[1], touched[0], periods_ms, offsets_ms, dedupe=False, stale=stale), bar_path)
        for note in noted:
            files.remove(note)

    return on_batch


def latest_state(feed: DataFrame, keys: Sequence[str] = ("inst_id",), ts: str = "ts", tie: str = "arrival") -> DataFrame:
    """Newest record per key of a stream, tolerant of disorder (write in update mode).

    A record of the same time replaces the stored one.  The maximum is kept as
    incremental state and a hot key is reduced before the shuffle.
    """
    rest = [c for c in feed.columns if c not in keys]
    order = [F.col(ts).alias("_o0"), F.col(tie).alias("_o1")]
    picked = feed.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_r"))
    return picked.select(*(F.col(c) if c in keys else F.col("_r")[c].alias(c) for c in feed.columns))


def run_available(df: DataFrame, writer: Callable, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there with ``foreachBatch(writer)`` and stop."""
    query = (
        df.writeStream.foreachBatch(writer).outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def fan_out(handlers: Mapping[str, Callable[[DataFrame, int], None]], failures: list | None = None):
    """``foreachBatch`` function giving every batch to all handlers; one that fails does not stop the others."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            for name, handler in handlers.items():
                try:
                    handler(kept, batch_id)
                except Exception as error:  # noqa: BLE001  any handler error is reported, none is fatal
                    log.exception("handler %s failed on batch %s", name, batch_id)
                    if failures is not None:
                        failures.append((name, batch_id, error))
        finally:
            kept.unpersist()

    return on_batch


def catching_up(handlers: Mapping[str, Callable[[DataFrame, int], None]], folder: str):
    """``foreachBatch`` function giving every batch to all handlers, also to one that failed before: it gets what it missed, in order.

    A batch is written below ``folder`` first, and stays there until all handlers have done it; what a handler has done is a mark of its name and the
    batch's number. A handler that fails is left at that batch and tried again with the next one, or by calling
    :func:`catch_up`. A batch is given again if its mark was not set: a handler must write by the batch's number.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        files = _Files(batch.sparkSession)
        if not files.exists(f"{folder}/batches/{batch_id}/_SUCCESS"):
            batch.write.mode("overwrite").parquet(f"{folder}/batches/{batch_id}")
        catch_up(batch.sparkSession, handlers, folder)

    return on_batch


def catch_up(spark, handlers: Mapping[str, Callable[[DataFrame, int], None]], folder: str) -> dict[str, int]:
    """Give each handler the batches that it has not done; the numbers of those that are left, by handler."""
    files = _Files(spark)
    known = sorted(int(x) for x in files.names(f"{folder}/batches") if files.exists(f"{folder}/batches/{x}/_SUCCESS"))
    left = {}
    for name, handler in handlers.items():
        waiting = [i for i in known if not files.exists(f"{folder}/done/{name}/{i}")]
        while waiting:
            try:
                handler(spark.read.parquet(f"{folder}/batches/{waiting[0]}"), waiting[0])
            except Exception:  # noqa: BLE001  any handler error is reported, none is fatal
                log.exception("handler %s failed on batch %s", name, waiting[0])
                break
            files.touch(f"{folder}/done/{name}/{waiting.pop(0)}")
        left[name] = len(waiting)
    for i in known[:-1]:  # the newest stays, so that a repeated trigger finds it
        if all(files.exists(f"{folder}/done/{name}/{i}") for name in handlers):
            files.remove(f"{folder}/batches/{i}")
    return left


class _Files:
    """A few calls of the file system that Spark itself uses."""

    def __init__(self, spark):
        self.path, self.conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        made = self.path(path)
        return made.getFileSystem(self.conf), made

    def exists(self, path: str) -> bool:
        system, at = self._at(path)
        return system.exists(at)

    def names(self, path: str) -> list[str]:
        system, at = self._at(path)
        return [x.getPath().getName() for x in system.listStatus(at)] if system.exists(at) else []

    def touch(self, path: str) -> None:
        system, at = self._at(path)
        system.create(at, True).close()

    def remove(self, path: str) -> None:
        system, at = self._at(path)
        system.delete(at, True)


# --- incremental ingest -----------------------------------------------------------


def resume_point(
    target: DataFrame, keys: Sequence[str], time_col: str = "time_ms", now_ms: int | None = None, known: DataFrame | None = None
) -> DataFrame:
    """Last processed time per key, ``resume_ms``: from the stored rows, else the start of 2020.

    ``known`` lists keys that may have no rows yet.  With ``now_ms``, keys less than a minute
    old are left out: there is nothing to load.
    """
    last = series_bounds(target, keys, time_col).select(*keys, F.col("last_ms").alias("resume_ms"))
    if known is not None:
        last = known.select(*keys).distinct().join(last, list(keys), "left")
    # a minute and a millisecond earlier, so that the first candle of the start is included
    start = F.lit(START_MS - FRESH_MS - 1).cast("bigint")
    found = last.withColumn("resume_ms", F.when(F.col("resume_ms") >= START_MS, F.col("resume_ms")).otherwise(start))
    return found if now_ms is None else found.filter(F.abs(F.col("resume_ms") - now_ms) >= FRESH_MS)


def kline_increment(klines: DataFrame, resume: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Finished candles that close after each key's resume point."""
    page = close_candles(klines, keys).join(resume.select(*keys, "resume_ms"), list(keys))
    return page.filter(F.col("close_time") > F.col("resume_ms")).drop("resume_ms")


__all__ = [
    "bar_refresher", "fan_out", "kline_increment", "latest_state", "resume_point", "run_available",
    "stream_bars", "stream_dedupe", "with_event_time",
]
