"""Plans in which arrays and messages are worked out once, not again in filters below."""

import json

from pyspark.sql import functions as F

from tickloom.operators import books as K
from tickloom.plans.books import _flat
from tickloom.sources import raw as R


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_levels_of_wide_books_are_not_made_again_to_filter(spark):
    entry = lambda i: F.struct((F.col("id") + i).cast("double").alias("price"), i.cast("double").alias("size"))
    made = F.transform(F.sequence(F.lit(1), F.col("id").cast("int")), entry)
    books = spark.range(1, 4).select(F.col("id").alias("book"), made.alias("bids"), F.filter(made, lambda x: x["size"] > 2).alias("asks"))
    wide = K.wide_to_book(K.book_to_wide(books, 5), 5)
    rows = _flat(wide, "bids")
    assert _plan(rows).count("transform(") == 1
    assert sorted(map(tuple, rows.collect())) == [(b, i, b + i + 1.0, i + 1.0) for b in (1, 2, 3) for i in range(b)]
    assert [tuple(r) for r in _flat(wide, "asks").collect()] == [(3, 0, 6.0, 3.0)]


def test_array_books_are_read_once(spark):
    levels = [[100.0 + i, 3.0, 1.5] for i in range(50)]
    messages = [json.dumps([7, levels[:2], 1, 5]), json.dumps([7, levels, 2, 5]), json.dumps([8, levels[:2], 3, 5]), json.dumps([7, levels[:3], 4, 5]), "no message", None]
    raw = spark.createDataFrame([(m,) for m in messages], "value string")
    books = R.read_book_array(raw, spark.createDataFrame([(7, "t7"), (8, " ")], "channel long, symbol string"))
    assert _plan(books).count("from_json(") == 2
    got = {r.seq: r for r in books.collect()}
    assert sorted(got) == [1, 2] and [len(got[k].levels) for k in (1, 2)] == [2, 50]
    assert tuple(got[1].levels[1]) == (101.0, 3, 1.5) and got[1].symbol == "t7" and got[1].time_ms == 5


def test_plain_array_books_need_no_parser(spark):
    """Plain messages are cut by Arrow, with the values that JSON gives; others, even by one space, are parsed."""
    from pyspark.sql.types import StructType

    numbers = ["1", "-0.0", "0.1", "173665.47", "1.0E7", "2.5e-3", "-12.75", "999999999999999999", "0.30000000000000004", "1E22"]
    level = lambda k: f"[{numbers[k % 10]},{k}.0,{numbers[k % 7]}]"
    plain = [f"[{c},[{','.join(level(k + c) for k in range(n))}],{c * 10**14},-{c + 1}]" for c in range(3) for n in (1, 2, 50, 200, 500)]
    odd = ["[1,[[1,2,3],[1,2]],7,5]", "[1,[[1,2,3],[1,2,3,4]],8,5]", '[1,[[1,"2",3],["a",null,3]],9,5]', "[1,[[1,2.9,3],[01,2,3]],10,5]", "[1,[[1,2,3],[1,2,3]],11]", "[1,[],12,5]", "[1,[[1,-2.9,3],[1,2,3]],13,5]\n"]
    odd += ["[1,[[1,2,3],[NaN,2,3]],14,5]", "[x,[[1,2,3],[1,2,3]],15,5]", "[1,[[1,2,3],[1,2,3]],99999999999999999999,5]", "", None, "[1,[[-0,2,3],[1,2,-0]],16,5]"]
    rows = [(k, m) for k, m in enumerate(plain + odd)]
    channels = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "channel long, symbol string")
    raw = spark.createDataFrame(rows, "place int, value string")
    # a space in front makes any message one for the parser
    read = lambda r: sorted(map(repr, R.read_book_array(r.repartition(2), channels).collect()))
    assert read(raw) == read(raw.withColumn("value", F.concat(F.lit(" "), "value"))) and len(read(raw)) > 15
    cut = raw.coalesce(1).mapInArrow(R._plain_books(), StructType.fromDDL(f"place int, value string, {R._PLAIN_FIELDS}")).collect()
    assert [r.place for r in cut if r._levels is not None and r.value is None] == [*range(15)]
    assert R.read_book_array(raw.where("value IS NULL"), channels).count() == 0


def test_candles_are_read_once(spark):
    candle = json.dumps([str(i) for i in range(12)])
    messages = [candle, f" [ {candle} , {candle} ] ", "[]", "no message", None]
    read = R.read_klines(spark.createDataFrame([(i, m) for i, m in enumerate(messages)], "symbol int, value string"))
    # one for the message, one inside the page
    assert _plan(read).count("from_json(") == 2
    assert sorted((r.symbol, r.open_time, r.close, r.close_time) for r in read.collect()) == [(0, 0, 4.0, 6), (1, 0, 4.0, 6), (1, 0, 4.0, 6)]


def test_candle_messages_are_not_read_again_by_later_steps(spark, tmp_path):
    from datetime import datetime

    from tickloom.plans import load_all
    from tickloom.plans.registry import QUERIES

    load_all()
    line = [(i, i % 3, i % 2, 1 + i % 7, 10.0 * (i % 5), 5.0, 0.1, 0.1, datetime(2001, 1, 1 + i)) for i in range(9)]
    columns = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_shipdate timestamp"
    spark.createDataFrame(line, columns).write.parquet(f"{tmp_path}/lineitem.parquet")
    for name in ("kline_increment", "close_candles"):
        found = QUERIES[name](spark, str(tmp_path))
        assert "from_json(" not in _plan(found) and found.count() > 0
