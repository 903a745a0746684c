"""Queries on matrix files: tasks write the files from a table, the readers take them apart."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tickloom.plans.registry import query
from tickloom.plans.views import view, with_views
from tickloom.session import shared_dir
from tickloom.sources import matrix as M

#: Entries of two rows of three numbers.
PAIRS = M.MatrixLayout("pairs", ("price", "size", "count"), 2, item="float64")
DAY_MS = 86_400_000

# A pair of files for each market and day. Every second file lacks its last time, every third has three bytes too many.
_FILES = f"""SELECT market, time_ms // {DAY_MS} AS day, count(*) AS n FROM trades GROUP BY ALL"""


def _write(spark, sf_dir) -> str:
    """Write the trades of each market and day in the order of time and id; a retried task writes the same files again."""
    folder = f"{shared_dir(spark)}/tickloom-matrix/{uuid.uuid4().hex}"

    def close(files, n: int, stamp: int) -> None:
        matrix, times = files
        if n % 2:
            times.write(np.array([stamp], "<i8").tobytes())
        if n % 3 == 0:
            matrix.write(b"???")
        matrix.close(), times.close()

    def write(batches):
        store, root = M.open_store(folder)
        at, files, n, stamp, done = None, None, 0, 0, 0
        for batch in batches:
            for key, rows in batch.groupby(["market", "day"], sort=False):
                if key != at:
                    if files:
                        close(files, n, stamp)
                    store.create_dir(f"{root}/{key[0]}")
                    at, n = key, 0
                    files = [store.open_output_stream(f"{root}/{key[0]}/{key[1]}{end}", compression=None) for end in (".mm", ".mm.time")]
                p, v = rows["price"].to_numpy(), rows["volume"].to_numpy()
                files[0].write(np.stack([p, v, v + 1, p * 2, v * 2, v + 2], axis=1).astype("<f8").tobytes())
                stamps = rows["time_ms"].to_numpy().astype("<i8")
                # one time is held back, for the end of the file
                files[1].write(np.concatenate(([stamp] if n else [], stamps[:-1])).astype("<i8").tobytes())
                n, stamp, done = n + len(rows), int(stamps[-1]), done + len(rows)
        if files:
            close(files, n, stamp)
        yield pd.DataFrame({"n": [done]})

    day = F.floor(F.col("time_ms") / DAY_MS).alias("day")
    rows = view(spark, sf_dir, "trades").select("market", day, "time_ms", "id", "price", "volume")
    rows = rows.repartition("market", "day").sortWithinPartitions("market", "day", "time_ms", "id")
    rows.mapInPandas(write, "n bigint").agg(F.sum("n")).first()
    return folder


def _keys():
    part = lambda k: F.substring_index(F.substring_index("stem", "/", -k), "/", 1)
    return part(2).alias("market"), part(1).cast("bigint").alias("day")


@query(
    "read_matrix_files",
    with_views("trades", f"""WITH files AS ({_FILES}), placed AS (
      SELECT market, time_ms // {DAY_MS} AS day, time_ms, price, volume, row_number() OVER (PARTITION BY market, time_ms // {DAY_MS} ORDER BY time_ms, id) - 1 AS entry
      FROM trades), usable AS (SELECT placed.* FROM placed JOIN files USING (market, day) WHERE entry < n - CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END)
      SELECT market, day, entry, time_ms, 0 AS position, price, volume AS size, volume + 1 AS count FROM usable
      UNION ALL SELECT market, day, entry, time_ms, 1, price * 2, volume * 2, volume + 2 FROM usable"""),
    "price size count",
)
def read_matrix_files(spark, sf_dir):
    rows = M.read_matrix_files(spark, _write(spark, sf_dir), PAIRS, range_bytes=10 * PAIRS.entry_bytes)
    return rows.select(*_keys(), "entry", "time_ms", "position", "price", "size", "count")


@query(
    "file_alignment_audit",
    with_views("trades", f"""WITH files AS ({_FILES}) SELECT market, day, n * 48 + CASE WHEN n % 3 = 0 THEN 3 ELSE 0 END AS matrix_bytes,
      8 * (n - CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END) AS time_bytes, n AS matrix_entries, n - CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END AS time_entries,
      CAST(CASE WHEN n % 3 = 0 THEN 3 ELSE 0 END AS BIGINT) AS matrix_excess, CAST(0 AS BIGINT) AS time_excess, n - CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END AS usable, FALSE AS old FROM files"""),
)
def file_alignment_audit(spark, sf_dir):
    audit = M.file_alignment_audit(spark, _write(spark, sf_dir), PAIRS, older_than_days=1)
    return audit.select(*_keys(), *audit.columns[1:])
