import os
import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tickloom.operators import books as K
from tickloom.operators.filters import validate_book
from tickloom.sinks import tables as T
from tickloom.sources import matrix as M
from tickloom.streaming import book_state as S
from tickloom.streaming import streams as Z


def levels(spark, n=400):
    return spark.range(n).select(
        F.lit("s").alias("symbol"), F.when(F.col("id") % 2 == 0, "bid").otherwise("ask").alias("side"),
        F.when(F.col("id") % 2 == 0, 1000.0 - F.col("id")).otherwise(1000.0 + F.col("id")).alias("price"),
        (F.col("id") * 7 % 23 + 1).cast("double").alias("qty"), (F.col("id") % 5 + 1).alias("change_count"),
        (F.col("id") % 5 + 1).alias("stat_count"), (F.col("id") % 9).cast("double").alias("qty_var"),
        (F.col("id") % 4).cast("double").alias("qty_std"), (F.col("id") * 7 % 23 + 1).cast("double").alias("qty_mean"),
    )


def test_condensing_keeps_size(spark):
    rows = levels(spark)
    kept = K.select_levels_detailed(rows, 20)
    assert {r["count"] for r in kept.groupBy("side").count().collect()} == {20}
    out = K.condense_detailed(rows, 20)
    members = K.segments(rows, kept)
    assert out.agg(F.sum("size")).first()[0] == members.agg(F.sum("qty")).first()[0]
    assert out.agg(F.sum("aggregate_count")).first()[0] == members.count()
    book = K.condensed_book(rows, 150).first()
    for side in (book.bids, book.asks):
        prices = [x.price for x in side]
        assert len(side) == 150 and prices == sorted(prices)


def test_regrouped_book_has_fixed_length(spark):
    rows = levels(spark).select("symbol", "side", "price", F.col("qty").alias("size"))
    book = K.regroup_book(rows, 25).first()
    assert len(book.bids) == len(book.asks) == 25
    total = rows.filter("side = 'ask'").agg(F.sum("size")).first()[0]
    assert sum(x["size"] for x in book.asks) == total
    few = rows.filter("price between 990 and 1011")
    short = K.regroup_book(few, 25).first()
    assert len(short.bids) == len(short.asks) == 25 and short.asks[-1]["size"] == 0.0


def test_validate_empty_book(spark):
    schema = "market string, time_ms bigint, grouping double, bids array<struct<price:double,size:double>>, asks array<struct<price:double,size:double>>"
    row = validate_book(spark.createDataFrame([("m", 1_300_000_000_000, 1.0, [], [])], schema), 1_400_000_000_000).first()
    assert row.valid and row.empty and row.failed == []


def _stream(spark, batches, schema, folder):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        yield i


def _run(spark, folder, build, schema, mode="append"):
    stream = build(spark.readStream.schema(schema).parquet(f"{folder}/in"))
    got = []
    Z.run_available(stream, lambda b, _: got.extend(b.collect()), f"{folder}/state", mode)
    return got


def _keep(spark, folder, schema, **choices):
    stream = S.update_messages(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"))
    books = {}
    keeper = S.book_keeper(f"{folder}/books", lambda df, i: books.update({i: df.collect()}), **choices)
    Z.run_available(stream, keeper, f"{folder}/state")
    return books


def test_book_state_removal_and_statistics(spark):
    schema = "symbol string, side string, price double, qty double, final_id bigint, event_ms bigint"
    folder = tempfile.mkdtemp(prefix="tickloom-")
    batches = [
        [("s", "bid", 100.0, 1.0, 1, 10), ("s", "bid", 100.0, 3.0, 2, 11), ("s", "bid", 100.0, 9.0, 1, 9), ("s", "ask", 101.0, 5.0, 1, 10)],
        [("s", "bid", 100.0, 0.0, 3, 12)],
        [("s", "bid", 100.0, 4.0, 4, 5000)],
    ]
    seen = {}
    for _ in _stream(spark, batches, schema, folder):
        seen.update(_keep(spark, folder, schema, expiry_ms=1000))
    first = {r.side: r for r in seen[0]}
    # the update that came late is older than the level and does not apply
    assert (first["bid"].qty, first["bid"].last_id, first["ask"].change_count) == (3.0, 2, 1)
    # unchanged since the emission and emptied: removed; the untouched ask is in the book, with its counts reset
    assert [(r.side, r.qty, r.change_count, r.stat_count) for r in seen[1]] == [("ask", 5.0, 0, 0)]
    # the ask, untouched, expires by the clock
    assert [(r.side, r.qty) for r in seen[2]] == [("bid", 4.0)]


def test_snapshot_replaces_older_levels(spark):
    snap = "symbol string, last_id bigint, time_ms bigint, bids array<struct<price:double,qty:double>>, asks array<struct<price:double,qty:double>>"
    one = spark.createDataFrame([("s", 5, 10, [(100.0, 1.0)], [(101.0, 2.0)])], snap)
    messages = S.snapshot_messages(one, full_cleanup=False).toPandas()
    marks = messages[messages.kind == "clear"]
    assert set(marks.side) == {"bid", "ask"} and (messages.kind == "level").sum() == 2
    bids = marks[marks.side == "bid"]
    assert np.isinf(bids.high_key).all() and np.isfinite(bids.low_key).all()


def test_funding_in_arrival_order(spark):
    schema = "inst_id string, funding_rate double, funding_time bigint, ts bigint, arrival bigint"
    folder = tempfile.mkdtemp(prefix="tickloom-")
    rows = [("a", 0.1, 10, 1, 1), ("a", 0.2, 20, 2, 2), ("a", 0.3, 10, 3, 3), ("a", 0.4, 20, 2, 4), ("a", 0.5, 20, 5, 5)]
    for _ in _stream(spark, [rows], schema, folder):
        got = _run(spark, folder, S.latest_funding_state, schema, "update")
    assert [r.funding_rate for r in got] == [0.5]


def test_bars_are_replaced_by_date(spark):
    from tickloom.operators.bars import trade_bars

    path = tempfile.mkdtemp(prefix="tickloom-") + "/bars"
    schema = "id bigint, time_ms bigint, market string, price double, volume double, flag smallint"
    day = 86_400_000
    a = spark.createDataFrame([(1, day + 5, "m", 1.0, 1.0, 1), (2, 2 * day + 5, "m", 2.0, 1.0, 1)], schema)
    T.write_bars(trade_bars(a, [3_600_000]), path)
    b = spark.createDataFrame([(3, 2 * day + 6, "m", 7.0, 1.0, 1)], schema)
    T.write_bars(trade_bars(b, [3_600_000]), path)
    got = {r.time_ms: r.close for r in T.read_bars(spark, path).collect()}
    assert got == {day: 1.0, 2 * day: 7.0}


def test_matrix_files(spark):
    folder = tempfile.mkdtemp(prefix="tickloom-")
    values = np.arange(3 * 50 * 3, dtype="<f4")
    (values.tofile(f"{folder}/0001.mm"), np.array([7, 8], dtype="<i8").tofile(f"{folder}/0001.mm.time"))
    rows = M.read_matrix_files(spark, folder, M.SIMPLE_BOOK).toPandas()
    parts = M.read_matrix_files(spark, folder, M.SIMPLE_BOOK, range_bytes=1).toPandas()
    assert rows.sort_values(["entry", "position"], ignore_index=True).equals(parts.sort_values(["entry", "position"], ignore_index=True))
    assert len(rows) == 2 * 50 and set(rows.time_ms) == {7, 8}
    assert rows[(rows.entry == 1) & (rows.position == 0)].price.item() == 150.0
    audit = M.file_alignment_audit(spark, folder, M.SIMPLE_BOOK).first()
    assert (audit.matrix_entries, audit.time_entries, audit.usable, audit.matrix_excess) == (3, 2, 2, 0)
    swaps = tempfile.mkdtemp(prefix="tickloom-")
    np.arange(32, dtype="<f8").tofile(f"{swaps}/0000.mm")
    assert pd.Series(M.read_matrix_files(spark, swaps, M.SWAP_ROWS).toPandas().last_price).tolist() == [15.0, 31.0]
    assert [len(x.columns) for x in (M.OPTION_ROWS, M.SENTIMENT_ROWS, M.KLINE_ROWS)] == [25, 9, 11]


def test_small_ranges_of_a_file_share_its_handles(spark, monkeypatch):
    """Files are opened once by the task that reads their ranges, and rows are handed on together."""
    folder = tempfile.mkdtemp(prefix="tickloom-")
    n = 500
    for k in range(3):
        np.arange(n * 150, dtype="<f4").tofile(f"{folder}/{k}.mm")
        (np.arange(n, dtype="<i8") + k).tofile(f"{folder}/{k}.mm.time")
    notes = tempfile.mkdtemp(prefix="tickloom-")
    plain = M.open_store

    def noted(path):
        import uuid

        open(f"{notes}/{uuid.uuid4().hex}", "w").close()
        return plain(path)

    monkeypatch.setattr(M, "open_store", noted)
    rows = M.read_matrix_files(spark, folder, M.SIMPLE_BOOK, range_bytes=M.SIMPLE_BOOK.entry_bytes).toPandas()
    assert len(rows) == 3 * n * 50 and (rows.groupby("stem").entry.nunique() == n).all()
    assert (rows.price == (rows.entry * 50 + rows.position) * 3).all()
    assert (rows.time_ms - rows.entry == rows.stem.str[-1].astype(int)).all()
    assert len(os.listdir(notes)) <= 6


def test_bucketed_tables_are_joined_where_they_lie(spark):
    from tickloom.plans import streams as P

    names = P.bucketed_tables(spark, "/root/testdata/sf0.001")
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    need_all = spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", False)
        joined = P.position_in_bars(spark, *names)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan and "Bucketed: true" in plan
        assert joined.agg({"n": "sum"}).first()[0] == spark.table(names[0]).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", need_all)
