"""Writing trades, bars, books and series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.scalars import pair_hash, sanitize_pair
from tickloom.operators.bars import BAR_COLUMNS
from tickloom.operators.books import book_to_wide
from tickloom.operators.filters import pair_filter
from tickloom.operators.latest import new_rows
from tickloom.session import scratch_table

# Trades in time chunks of 30 days, statistics in 32 days, over 8 hash partitions; levels of a table; size of a series file.
TRADE_CHUNK_DAYS = 30
STATS_CHUNK_DAYS = 32
HASH_PARTITIONS = 8
DAY_MS = 86_400_000
TABLE_LEVELS = 25
SERIES_FILE_BYTES = 16 << 20

BAR_SCHEMA = "market string, period_ms bigint, offset_ms bigint, " + ", ".join(
    f"{c} {'bigint' if c in ('time_ms', 'num_trades', 'trade_id') else 'double'}" for c in BAR_COLUMNS
)


def day_of(time_ms: str = "time_ms") -> Column:
    return F.to_date(F.timestamp_millis(time_ms))


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def append_trades(trades: DataFrame, path: str, lookback_ms: int | None = None) -> None:
    """Append trades whose ids are not stored yet, each once, partitioned by date.

    A copy of a trade has its time, so only the stored dates that the new trades cover are read.
    """
    spark = trades.sparkSession
    stored = trades.limit(0)
    if _exists(spark, path):
        first, last = trades.agg(F.min(day_of()), F.max(day_of())).first()
        stored = spark.read.parquet(path).filter(F.col("date").between(F.lit(first), F.lit(last))).drop("date")
    fresh = new_rows(trades, stored, lookback_ms=lookback_ms).withColumn("date", day_of())
    # files by date, a busy date in several
    fresh.hint("rebalance", "date").write.mode("append").partitionBy("date").parquet(path)


def read_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Stored rows of :func:`put_rows`, or none."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema + ", date date").parquet(path).drop("date")


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """Stored bars, or none."""
    return read_rows(spark, path, BAR_SCHEMA)


def put_rows(rows: DataFrame, path: str, keys: Sequence[str], time_col: str = "time_ms") -> None:
    """Put rows in the place of the stored ones of the same keys, by date; ``keys`` include the time.

    Only the dates that have new rows are rewritten; the new content is complete before
    any file is replaced.
    """
    spark = rows.sparkSession
    fresh = scratch_table(rows.withColumn("date", day_of(time_col)))
    merged = fresh
    if _exists(spark, path):
        first, last = fresh.agg(F.min("date"), F.max("date")).first()
        stored = spark.read.schema(fresh.schema).parquet(path).filter(F.col("date").between(F.lit(first), F.lit(last)))
        others = stored.join(fresh.select("date").distinct(), "date", "left_semi").join(fresh.select(*keys), list(keys), "left_anti")
        merged = scratch_table(others.select(fresh.columns).unionByName(fresh))
    merged.hint("rebalance", "date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def write_bars(bars: DataFrame, path: str) -> None:
    """Put bars in the place of the stored ones of the same bucket."""
    put_rows(bars.select("market", "period_ms", "offset_ms", *BAR_COLUMNS), path, ["market", "period_ms", "offset_ms", "time_ms"])


def write_book_nested(books: DataFrame, path: str, compression: str = "snappy") -> None:
    """Books with level arrays, by market and grouping inside each file."""
    books.sortWithinPartitions(*[c for c in ("market", "grouping") if c in books.columns]).write.mode("append").option(
        "compression", compression
    ).parquet(path)


def of_depth(books: DataFrame, levels: int) -> tuple[DataFrame, DataFrame]:
    """Books with exactly ``levels`` levels on each side, and the others."""
    full = F.coalesce((F.size("bids") == levels) & (F.size("asks") == levels), F.lit(False))
    return books.filter(full), books.filter(~full)


def wide_books(books: DataFrame, levels: int, with_count: bool = False) -> DataFrame:
    """Wide form with the market as its hash, of the books of that depth."""
    wide = book_to_wide(of_depth(books, levels)[0], levels, with_count)
    return wide.withColumn("market_hash", pair_hash("market")).drop("market")


def write_book_wide(books: DataFrame, path: str, levels: int, with_count: bool = False, compression: str = "snappy") -> DataFrame:
    """Append the books of that depth in the wide form; returned are the books of another depth, which are not written."""
    wide_books(books, levels, with_count).write.mode("append").option("compression", compression).parquet(path)
    return of_depth(books, levels)[1]


def table_books(books: DataFrame) -> DataFrame:
    """Wide rows of the books that have exactly 25 levels on each side."""
    return book_to_wide(of_depth(books, TABLE_LEVELS)[0], TABLE_LEVELS, with_count=True)


def write_book_table(books: DataFrame, table: str, path: str | None = None) -> None:
    """Append to a table, which is made in the warehouse or, the first time, at ``path``."""
    writer = table_books(books).write.mode("append")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def numbered_stats(stats: DataFrame, max_id: int = 0) -> DataFrame:
    """Statistics with running ids above ``max_id``, by mark price.

    Ids are given per range partition and offset by the sizes of the partitions before
    it, so numbering does not pass through one task.
    """
    ranged = scratch_table(stats.repartitionByRange("mark", "market_hash", "time_ms").withColumn("_p", F.spark_partition_id()))
    from pyspark.sql.window import Window

    order = Window.partitionBy("_p").orderBy("mark", "market_hash", "time_ms")
    sizes = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition of the write, not per record
    starts = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    numbered = ranged.withColumn("_i", F.row_number().over(order)).join(starts, "_p")
    return numbered.withColumn("id", (F.col("_i") + F.col("_start") + max_id).cast("bigint")).drop("_p", "_i", "_start")


def write_futures_stats(stats: DataFrame, path: str) -> None:
    """Append statistics; their ids continue above the stored ones."""
    spark = stats.sparkSession
    top = spark.read.parquet(path).agg(F.max("id")).first()[0] if _exists(spark, path) else 0
    numbered_stats(stats, top or 0).write.mode("append").parquet(path)


def write_series(df: DataFrame, path: str, exchange: str, kind: str, symbol: str = "symbol", time_col: str = "time_ms",
                 max_bytes: int = SERIES_FILE_BYTES) -> None:
    """Series in folders of exchange, kind, file-safe symbol (``series``) and date.

    A file covers at most a day and holds at most ``max_bytes`` of values, counted as eight bytes a value.
    """
    per_file = max(1, max_bytes // (8 * len(df.columns)))
    out = df.withColumns({"exchange": F.lit(exchange), "kind": F.lit(kind), "series": sanitize_pair(symbol), "date": day_of(time_col)})
    out.hint("rebalance", "series", "date").write.mode("append").option("maxRecordsPerFile", per_file).partitionBy(
        "exchange", "kind", "series", "date"
    ).parquet(path)


# File name patterns of the rolling grains.
GRAINS = {"hour": "yyyy_MM_dd_HH", "day": "yyyy_MM_dd"}


def rolling(df: DataFrame, grain: str = "hour", time_col: str = "time_ms") -> DataFrame:
    return df.withColumn("slot", F.date_format(F.timestamp_millis(time_col), GRAINS[grain]))


def write_rolling(df: DataFrame, path: str, grain: str = "hour", time_col: str = "time_ms") -> None:
    """One folder per hour."""
    rolling(df, grain, time_col).hint("rebalance", "slot").write.mode("append").partitionBy("slot").parquet(path)


def layout_time_hash(df: DataFrame, days: int = TRADE_CHUNK_DAYS, buckets: int = HASH_PARTITIONS, market: str = "market",
                     time_col: str = "time_ms") -> DataFrame:
    """Adds ``chunk_id`` (time chunk) and ``hash_part`` (hash partition of the market)."""
    hashed = F.col("market_hash") if "market_hash" in df.columns else pair_hash(market)
    return df.withColumns(
        {"chunk_id": F.floor(F.col(time_col) / F.lit(days * DAY_MS)).cast("bigint"), "hash_part": F.pmod(hashed, F.lit(buckets)).cast("int")}
    )


def write_time_hash(df: DataFrame, path: str, days: int = TRADE_CHUNK_DAYS, buckets: int = HASH_PARTITIONS, slices: int = 16) -> None:
    """Write in that layout, rows of a market together and in time order.

    A chunk is written by ``slices`` spans of time, so that files can be skipped by time; a span
    that is too large for a task is split further by its size.
    """
    width = F.lit(days * DAY_MS // slices)
    laid = layout_time_hash(df, days, buckets).withColumn("_slice", F.floor(F.col("time_ms") / width))
    dealt = laid.hint("rebalance", "chunk_id", "hash_part", "_slice").drop("_slice")
    dealt.sortWithinPartitions("chunk_id", "hash_part", "market", "time_ms").write.mode("append").partitionBy("chunk_id", "hash_part").parquet(path)


def write_bucketed(df: DataFrame, table: str, path: str, buckets: int = HASH_PARTITIONS, days: int = TRADE_CHUNK_DAYS, market: str = "market", time_col: str = "time_ms") -> None:
    """Append to a table whose rows lie in ``buckets`` by the hash of market and time chunk, in each by market and time.

    Two such tables, of trades and of their bars for example, are joined on ``market_hash``, ``chunk_id`` and any further columns where they lie, and aggregates by
    these keys need no shuffle either. The chunk is part of the key, so that a large market is spread over the buckets.
    """
    laid = layout_time_hash(df, days, buckets, market, time_col).drop("hash_part")
    laid = laid if "market_hash" in laid.columns else laid.withColumn("market_hash", pair_hash(market))
    dealt = laid.repartition(buckets, "market_hash", "chunk_id")
    dealt.write.mode("append").option("path", path).bucketBy(buckets, "market_hash", "chunk_id").sortBy("market_hash", "chunk_id", time_col).saveAsTable(table)


def export_rows(df: DataFrame, market_filter: str = "", limit: int = 0, columns: Sequence[str] = (), kind: str = "trades") -> DataFrame:
    """Rows of an export: trades by (time, id); bars and books by time, or the newest ``limit``."""
    out = df.filter(pair_filter(market_filter))
    out = out.select(*columns) if columns else out
    if kind == "trades":
        return out.orderBy("time_ms", "id")
    return out.orderBy(F.col("time_ms").desc(), "market").limit(limit) if limit > 0 else out.orderBy("time_ms", "market")


def export_csv(df: DataFrame, path: str, market_filter: str = "", limit: int = 0, kind: str = "trades") -> None:
    export_rows(df, market_filter, limit, kind=kind).write.mode("overwrite").option("header", True).csv(path)
