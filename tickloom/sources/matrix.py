"""Numeric matrix files: rows of numbers in a ``.mm`` file, times in a ``.mm.time`` file beside it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.sources.raw import KLINE_FIELDS

TIME_BYTES = 8


@dataclass(frozen=True)
class MatrixLayout:
    """What one entry of a matrix file holds: ``rows`` of ``columns``, as 32- or 64-bit floats."""

    name: str
    columns: tuple[str, ...]
    rows: int = 1
    item: str = "float32"
    timed: bool = True

    @property
    def entry_bytes(self) -> int:
        return self.rows * len(self.columns) * np.dtype(self.item).itemsize


# The layouts in use. Books hold the bids first, then the asks.
DETAILED_COLUMNS = ("price", "size", "raw_size", "mean_price", "change_counter", "total_change_counter", "size_std", "aggregate_count")
DETAILED_BOOK = MatrixLayout("detailed", DETAILED_COLUMNS, 128 * 2)
SIMPLE_BOOK = MatrixLayout("simple", ("price", "size", "count"), 25 * 2)
DEEP_BOOK = MatrixLayout("deep", ("price", "size", "count"), 250 * 2)
SWAP_ROWS = MatrixLayout(
    "swap",
    tuple(
        "timestamp next_funding_time funding_rate next_funding_rate open_interest open_interest_in_currency spread_percent"
        " spread_to_mark_percent ask_size bid_size change_24h_percent change_today_percent change_today_china_percent"
        " volume_24h price_ratio_24h last_price".split()
    ),
    item="float64", timed=False,
)
OPTION_ROWS = MatrixLayout(
    "option",
    tuple(
        "timestamp_ms expiry_in_ms delta gamma vega theta delta_bs gamma_bs vega_bs theta_bs lever mark_vol bid_vol ask_vol"
        " forward_price open_interest spread_percent spread_to_mark_percent change_24h_percent change_today_percent"
        " change_today_china_percent volume_24h price_ratio_24h last_price price".split()
    ),
    item="float64", timed=False,
)
SENTIMENT_ROWS = MatrixLayout(
    "sentiment",
    tuple(
        "timestamp_ms sell_taker_volume_spot buy_taker_volume_spot sell_taker_volume_contracts buy_taker_volume_contracts"
        " margin_lending_ratio long_short_ratio open_interest volume".split()
    ),
    item="float64", timed=False,
)
KLINE_ROWS = MatrixLayout("kline", tuple(KLINE_FIELDS), item="float64", timed=False)

#: Bytes of a matrix file that are read and decoded together.
RANGE_BYTES = 8 << 20
#: Rows that a task hands on together at least, where ranges are smaller.
TABLE_ROWS = 1 << 16


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    return reader.load(path).withColumn("stem", F.regexp_replace("path", r"\.mm(\.time)?$", ""))


def open_store(path: str):
    """File system and path within it, as pyarrow knows them, of a path that Spark names."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    path = re.sub("^s3[an]://", "s3://", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def read_matrix_files(spark: SparkSession, path: str, layout: MatrixLayout, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Entries of all matrix files below a path: ``stem, entry, time_ms, position`` and the columns.

    A pair of files gives as many entries as both hold, and a file without its other half none.  Spark lists and pairs the files by
    their lengths and deals ranges of about ``range_bytes``; each task reads its own ranges, so files may be of any size.
    """
    sizes = _files(spark, path, "*.mm").select("stem", "path", F.floor(F.col("length") / layout.entry_bytes).alias("entries"))
    if layout.timed:
        times = _files(spark, path, "*.mm.time").select("stem", F.floor(F.col("length") / TIME_BYTES).alias("stamps"))
        sizes = sizes.join(times, "stem").withColumn("entries", F.least("entries", "stamps"))
    step = max(1, range_bytes // layout.entry_bytes)
    ranges = sizes.where("entries > 0").withColumn("first", F.explode(F.sequence(F.lit(0), F.col("entries") - 1, F.lit(step))))
    ranges = ranges.select("stem", "path", "first", F.least(F.lit(step), F.col("entries") - F.col("first")).alias("n"))
    # small ranges of one stretch of a file are one task's, which opens the file once for them
    stretch = F.floor(F.col("first") / max(step, RANGE_BYTES // layout.entry_bytes))
    # with a number, as few bytes stand for much work
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = ranges.repartition(tasks, "stem", stretch).sortWithinPartitions("stem", "first")
    schema = "stem string, entry bigint, time_ms bigint, position int, " + ", ".join(f"`{c}` double" for c in layout.columns)
    rows, size, names, timed = layout.rows, layout.entry_bytes, list(layout.columns), layout.timed
    item = np.dtype(layout.item).newbyteorder("<")

    def table(held: list[tuple[str, int, np.ndarray, np.ndarray | None]]) -> pd.DataFrame:
        counts = [len(values) // rows for _, _, values, _ in held]
        out = pd.DataFrame(np.concatenate([values for _, _, values, _ in held]).astype("float64"), columns=names)
        entry = np.repeat(np.concatenate([np.arange(first, first + n) for n, (_, first, _, _) in zip(counts, held)]), rows)
        stamps = np.repeat(np.concatenate([stamps for *_, stamps in held]), rows) if timed else out[names[0]].astype("int64")
        out.insert(0, "position", np.tile(np.arange(rows, dtype="int32"), sum(counts)))
        out.insert(0, "time_ms", stamps)
        out.insert(0, "entry", entry)
        out.insert(0, "stem", np.repeat(np.array([stem for stem, *_ in held], object), np.array(counts) * rows))
        return out

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, files, held, n_held = None, [], [], 0

        def opened(name: str) -> list:
            store, inner = open_store(name)
            return [store.open_input_file(inner), *([store.open_input_file(f"{inner}.time")] if timed else [])]

        try:
            for batch in batches:
                for stem, name, first, n in batch.itertuples(index=False):
                    if name != at:
                        for file in files:
                            file.close()
                        at, files = name, opened(name)
                    values = np.frombuffer(files[0].read_at(n * size, first * size), dtype=item).reshape(-1, len(names))
                    stamps = np.frombuffer(files[1].read_at(n * TIME_BYTES, first * TIME_BYTES), dtype="<i8") if timed else None
                    held.append((stem, first, values, stamps))
                    n_held += len(values)
                    if n_held >= TABLE_ROWS:
                        yield table(held)
                        held, n_held = [], 0
        finally:
            for file in files:
                file.close()
        if held:
            yield table(held)

    return ranges.mapInPandas(decode, schema)


def file_alignment_audit(spark: SparkSession, path: str, layout: MatrixLayout, now_ms: int | None = None, older_than_days: int = 0) -> DataFrame:
    """Per pair of files: entries of each, bytes beyond the last whole entry, usable entries.

    File contents are not read.  ``old`` tells files not modified for ``older_than_days``.
    """
    sizes = lambda pattern, name: _files(spark, path, pattern).select("stem", F.col("length").alias(name), F.col("modificationTime").alias(f"{name}_at"))
    pairs = sizes("*.mm", "matrix_bytes").join(sizes("*.mm.time", "time_bytes"), "stem", "full")
    m, t = F.coalesce("matrix_bytes", F.lit(0)), F.coalesce("time_bytes", F.lit(0))
    whole = lambda x, n: F.floor(x / n).cast("bigint")
    now = F.lit(now_ms) if now_ms is not None else F.unix_millis(F.current_timestamp())
    touched = F.unix_millis(F.coalesce("time_bytes_at", "matrix_bytes_at"))
    return pairs.select(
        "stem", m.alias("matrix_bytes"), t.alias("time_bytes"),
        whole(m, layout.entry_bytes).alias("matrix_entries"), whole(t, TIME_BYTES).alias("time_entries"),
        (m % layout.entry_bytes).alias("matrix_excess"), (t % TIME_BYTES).alias("time_excess"),
        F.least(whole(m, layout.entry_bytes), whole(t, TIME_BYTES)).alias("usable"),
        (touched < now - older_than_days * 86_400_000).alias("old"),
    )
