"""Queries on raw messages: Spark builds the messages from the tables, the readers take them apart."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators.latest import close_candles
from tickloom.plans.registry import query
from tickloom.plans.views import view, with_views
from tickloom.session import prepare, scratch_table
from tickloom.sources import raw as R


def _table(spark, sf_dir, name):
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _json(**fields):
    return F.to_json(F.struct(*(c.alias(n) for n, c in fields.items()))).alias("value")


def _text(c) -> F.Column:
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


_TRADES = with_views("trades", """SELECT id, time_ms, price, volume, CAST(flag AS INTEGER) AS flag FROM trades WHERE id % 17 <> 0""")


def _trade_messages(spark, sf_dir):
    t = view(spark, sf_dir, "trades")
    side = F.when(F.col("id") % 17 == 0, "swap").when(F.col("flag") % 4 == 1, "buy").otherwise("sell")
    time = F.date_format(F.timestamp_millis("time_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    return t.select(_json(id=F.col("id"), price=F.col("price"), size=F.col("volume"), side=side, liquidation=F.col("flag") >= 4, time=time))


@query("read_trades", _TRADES, "price volume")
def read_trades(spark, sf_dir):
    good, _ = R.read_trades(_trade_messages(spark, sf_dir))
    return good.withColumn("flag", F.col("flag").cast("int"))


@query("rejected_trades", with_views("trades", "SELECT count(*) AS n FROM trades WHERE id % 17 = 0"))
def rejected_trades(spark, sf_dir):
    _, bad = R.read_trades(_trade_messages(spark, sf_dir))
    return bad.agg(F.count(F.lit(1)).alias("n"))


@query(
    "read_depth_updates",
    """SELECT l_returnflag AS symbol, l_orderkey AS first_id, l_orderkey + 3 AS final_id, CASE WHEN l_linenumber % 2 = 0 THEN nullif(l_orderkey - 1, 0) END AS prev_id,
       epoch_us(l_shipdate) // 1000 AS event_ms, 'bid' AS side, l_extendedprice AS price, l_quantity AS qty FROM lineitem
       UNION ALL SELECT l_returnflag, l_orderkey, l_orderkey + 3, CASE WHEN l_linenumber % 2 = 0 THEN nullif(l_orderkey - 1, 0) END, epoch_us(l_shipdate) // 1000, 'ask',
       l_extendedprice * 2, 0.0 FROM lineitem""",
    "price qty", digits=3,
)
def read_depth_updates(spark, sf_dir):
    pair = lambda p, q: F.array(F.array(p.cast("string"), q.cast("string")))
    line = _table(spark, sf_dir, "lineitem")
    data = F.to_json(
        F.struct(
            F.lit("depthUpdate").alias("k"), F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("t"), F.col("l_returnflag").alias("s"),
            F.when(F.col("l_linenumber") % 2 == 0, F.col("l_orderkey") - 1).otherwise(0).alias("pu"),
            pair(F.col("l_extendedprice"), F.col("l_quantity")).alias("b"), pair(F.col("l_extendedprice") * 2, F.lit(0.0)).alias("a"),
        )
    )
    ids = F.concat(F.lit('{"U":'), _text("l_orderkey"), F.lit(',"u":'), _text(F.col("l_orderkey") + 3), F.lit(',"e":"depthUpdate","E":'),
                   _text(F.unix_millis(F.col("l_shipdate").cast("timestamp"))), F.lit(","))
    message = F.concat(F.lit('{"stream":"x@depth","data":'), ids, F.regexp_replace(data, r"^\{", ""), F.lit("}"))
    return R.read_depth_updates(line.select(message.alias("value"))).drop("transaction_ms")


@query("read_book_snapshot_rest", """SELECT o_orderkey AS last_id, CAST(i AS INTEGER) AS level, o_totalprice - i AS bid, o_totalprice + i AS ask FROM orders, (VALUES (0), (1), (2)) v(i)""", "bid ask")
def read_book_snapshot_rest(spark, sf_dir):
    side = lambda sign: F.array(*(F.array(_text(F.col("o_totalprice") + sign * i), F.lit("1")) for i in range(3)))
    raw = _table(spark, sf_dir, "orders").select(_json(lastUpdateId=F.col("o_orderkey"), bids=side(-1), asks=side(1)))
    books = R.read_book_snapshot_rest(raw)
    return books.select("last_id", F.posexplode(F.arrays_zip("bids", "asks")).alias("level", "x")).select(
        "last_id", "level", F.col("x.bids.price").alias("bid"), F.col("x.asks.price").alias("ask")
    )


@query("read_book_snapshot_push", """SELECT concat('I', CAST(o_orderkey AS VARCHAR)) AS inst_id, epoch_us(o_orderdate) // 1000 AS time_ms, CAST(i AS INTEGER) AS level,
       o_totalprice + i AS price, 5.5 - i AS qty, CAST(least(o_custkey * 1000000, 2147483647) AS INTEGER) AS count FROM orders, (VALUES (0), (1)) v(i) WHERE o_orderstatus <> 'F'""", "price qty")
def read_book_snapshot_push(spark, sf_dir):
    entry = lambda i, extra: F.array(_text(F.col("o_totalprice") + i), F.lit(str(5.5 - i)), F.lit("0"), *extra, _text(F.col("o_custkey") * 1000000))
    side = F.array(entry(1, [F.lit("9")]), entry(0, [F.lit("9")]))
    data = F.array(F.struct(side.alias("asks"), F.array(entry(0, []), entry(1, [])).alias("bids"), _text(F.unix_millis(F.col("o_orderdate").cast("timestamp"))).alias("ts"), F.lit("1").alias("checksum")))
    arg = F.struct(F.lit("books").alias("channel"), F.concat(F.lit("I"), _text("o_orderkey")).alias("instId"))
    raw = _table(spark, sf_dir, "orders").select(_json(arg=arg, action=F.when(F.col("o_orderstatus") == "F", "update").otherwise("snapshot"), data=data))
    books = R.read_book_snapshot_push(raw)
    return books.select("inst_id", "time_ms", F.posexplode("asks").alias("level", "x")).select("inst_id", "time_ms", "level", "x.price", "x.qty", "x.count")


@query("read_book_array", """SELECT o_custkey AS channel, concat('t', CAST(o_custkey AS VARCHAR)) AS symbol, o_orderkey AS seq, epoch_us(o_orderdate) // 1000 AS time_ms,
       CAST(i AS INTEGER) AS level, o_totalprice + i AS price, CAST(3 AS BIGINT) AS count, CASE WHEN i = 0 THEN 1.5 ELSE -1.5 END AS size FROM orders, (VALUES (0), (1)) v(i)
       WHERE o_orderkey % 3 <> 0 AND o_custkey IN (SELECT c_custkey FROM customer)""", "price size")
def read_book_array(spark, sf_dir):
    entry = lambda i, size: F.array(F.col("o_totalprice") + i, F.lit(3.0), F.lit(size))
    pair, three = F.array(entry(0, 1.5), entry(1, -1.5)), F.array(entry(0, 1.5), entry(1, -1.5), entry(2, 1.0))
    levels = F.to_json(F.when(F.col("o_orderkey") % 3 == 0, three).otherwise(pair))
    time = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    raw = _table(spark, sf_dir, "orders").select(F.concat(F.lit("["), F.concat_ws(",", _text("o_custkey"), levels, _text("o_orderkey"), _text(time)), F.lit("]")).alias("value"))
    channels = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("channel"), F.concat(F.lit("t"), _text("c_custkey")).alias("symbol"))
    books = R.read_book_array(raw, channels)
    return books.select("channel", "symbol", "seq", "time_ms", F.posexplode("levels").alias("level", "x")).select(
        "channel", "symbol", "seq", "time_ms", "level", "x.price", "x.count", "x.size"
    )


def _candle_messages(spark, sf_dir):
    """Candle arrays from order lines, one symbol per part; the last of some parts is cut short."""
    line = _table(spark, sf_dir, "lineitem")
    open_ms = F.unix_millis(F.col("l_shipdate").cast("timestamp")) + F.col("l_orderkey") * 8 + F.col("l_linenumber")
    length = F.when(F.col("l_quantity") > 25, 59_999).otherwise(30_000)
    fields = [_text(open_ms), *(_text(F.col("l_extendedprice") + i) for i in range(4)), _text("l_quantity"), _text(open_ms + length),
              _text("l_extendedprice"), _text("l_linenumber"), _text("l_tax"), _text("l_discount"), F.lit("0")]
    return line.select(F.col("l_partkey").alias("symbol"), F.to_json(F.array(*fields)).alias("value"))


def _candles(spark, sf_dir):
    return R.read_klines(_candle_messages(spark, sf_dir))


def _candle_times(spark, sf_dir):
    """Symbol, open and close time of all candles, read from their messages once for steps that go through them several times."""
    return scratch_table(_candles(spark, sf_dir).select("symbol", "open_time", "close_time"))


_CANDLES = """k AS (SELECT l_partkey AS symbol, epoch_us(l_shipdate) // 1000 + l_orderkey * 8 + l_linenumber AS open_time, l_extendedprice AS open, l_extendedprice + 1 AS high,
   l_quantity AS volume, l_linenumber AS trades, l_discount AS taker_quote_volume, CASE WHEN l_quantity > 25 THEN 59999 ELSE 30000 END AS span FROM lineitem)"""


@query("read_klines", f"WITH {_CANDLES} SELECT symbol, open_time, open, high, volume, open_time + span AS close_time, trades, taker_quote_volume FROM k", "open high volume taker_quote_volume")
def read_klines(spark, sf_dir):
    return _candles(spark, sf_dir).select("symbol", "open_time", "open", "high", "volume", "close_time", "trades", "taker_quote_volume")


@query("read_kline_pages", f"WITH {_CANDLES} SELECT symbol, open_time, open, high, volume, open_time + span AS close_time, trades, taker_quote_volume FROM k", "open high volume taker_quote_volume")
def read_kline_pages(spark, sf_dir):
    """Pages of a day's candles, with blanks before, between and behind, and empty pages that give nothing."""
    one = _candle_messages(spark, sf_dir)
    day = F.floor(F.get(F.from_json("value", "array<string>"), F.lit(0)).cast("bigint") / 86_400_000)
    pages = one.groupBy("symbol", day).agg(F.concat(F.lit(" [ "), F.array_join(F.collect_list("value"), " ,\n "), F.lit(" ] ")).alias("value"))
    empty = one.select("symbol", F.lit(" [ ] ").alias("value")).distinct()
    pages = R.read_klines(pages.select("symbol", "value").unionByName(empty))
    return pages.select("symbol", "open_time", "open", "high", "volume", "close_time", "trades", "taker_quote_volume")


@query("close_candles", f"""WITH {_CANDLES}, n AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS c, row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC, span DESC) AS r,
       first(span) OVER (PARTITION BY symbol ORDER BY open_time, span) AS fs, min(open_time) OVER (PARTITION BY symbol) AS fo FROM k)
       SELECT symbol, open_time, open_time + span AS close_time FROM n WHERE NOT (r = 1 AND CASE WHEN c = 1 THEN span < 59999 ELSE open_time = fo OR fs > span END)""")
def closed_candles(spark, sf_dir):
    return close_candles(_candle_times(spark, sf_dir)).select("symbol", "open_time", "close_time")


def _envelopes(df, fields: dict):
    record = F.struct(F.lit("SWAP").alias("instType"), F.col("inst_id").alias("instId"), *(c.alias(n) for n, c in fields.items()))
    return df.select(_json(code=F.lit("0"), msg=F.lit(""), data=F.array(record)))


@query("read_open_interest", with_views("open_interest", "SELECT inst_id, CASE WHEN arrival % 5 = 0 THEN 0 ELSE oi END AS oi, oi_ccy, ts FROM open_interest"), "oi oi_ccy")
def read_open_interest(spark, sf_dir):
    oi = view(spark, sf_dir, "open_interest")
    text = F.when(F.col("arrival") % 5 == 0, "").otherwise(_text("oi"))
    return R.read_swap_feeds(_envelopes(oi, {"oi": text, "oiCcy": _text("oi_ccy"), "ts": _text("ts")}), "open_interest").drop("inst_type")


@query("read_ticker", with_views("ticker", "SELECT inst_id, last, ask_px, bid_px, vol24h, sod_utc8, ts, 0.0 AS last_sz FROM ticker"), "last ask_px bid_px vol24h sod_utc8 last_sz", digits=6)
def read_ticker(spark, sf_dir):
    names = {"last": "last", "askPx": "ask_px", "bidPx": "bid_px", "vol24h": "vol24h", "sodUtc8": "sod_utc8", "ts": "ts"}
    raw = _envelopes(view(spark, sf_dir, "ticker"), {n: _text(c) for n, c in names.items()})
    return R.read_swap_feeds(raw, "ticker").select("inst_id", "last", "ask_px", "bid_px", "vol24h", "sod_utc8", "ts", "last_sz")


@query("read_mark_price", with_views("mark_price", "SELECT inst_id, mark_px, ts FROM mark_price"), "mark_px")
def read_mark_price(spark, sf_dir):
    return R.read_swap_feeds(_envelopes(view(spark, sf_dir, "mark_price"), {"markPx": _text("mark_px"), "ts": _text("ts")}), "mark_price").drop("inst_type")


@query("read_funding_rate", with_views("funding", "SELECT inst_id, funding_rate, funding_time, method, sett_state, ts FROM funding"), "funding_rate", digits=8)
def read_funding_rate(spark, sf_dir):
    names = {"fundingRate": "funding_rate", "fundingTime": "funding_time", "method": "method", "settState": "sett_state", "ts": "ts"}
    raw = _envelopes(view(spark, sf_dir, "funding"), {n: _text(c) for n, c in names.items()})
    return R.read_swap_feeds(raw, "funding_rate").select("inst_id", "funding_rate", "funding_time", "method", "sett_state", "ts")


@query("read_instruments", with_views("instruments", "SELECT inst_id, inst_type, CASE WHEN ct_val > 40 THEN 1 ELSE ct_val END AS ct_val, state FROM instruments"), "ct_val")
def read_instruments(spark, sf_dir):
    value = F.when(F.col("ct_val") > 40, "n/a").otherwise(_text("ct_val"))
    raw = _envelopes(view(spark, sf_dir, "instruments"), {"ctVal": value, "state": F.col("state")})
    return R.read_swap_feeds(raw, "instrument").select("inst_id", "inst_type", "ct_val", "state")


@query("read_option_summary", with_views("option_chain", "SELECT inst_id, oi AS delta, vol24h AS fwd_px, 0.0 AS theta_bs, seq AS ts FROM option_chain"), "delta fwd_px theta_bs")
def read_option_summary(spark, sf_dir):
    raw = _envelopes(view(spark, sf_dir, "option_chain"), {"delta": _text("oi"), "fwdPx": _text("vol24h"), "ts": _text("seq")})
    return R.read_swap_feeds(raw, "option_summary").select("inst_id", "delta", "fwd_px", "theta_bs", "ts")


@query("read_sentiment", """SELECT l_returnflag AS coin, l_orderkey AS ts, l_quantity AS sell_volume, l_tax AS buy_volume FROM lineitem""", "sell_volume buy_volume")
def read_sentiment(spark, sf_dir):
    data = F.array(F.array(_text("l_orderkey"), _text("l_quantity"), _text("l_tax")))
    raw = _table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("coin"), _json(code=F.lit("0"), data=data))
    return R.read_sentiment(raw, "taker_volume")


@query(
    "read_sentiment_kinds",
    """SELECT kind, l_returnflag AS coin, l_orderkey AS ts, l_quantity AS a, CASE WHEN kind = 'open_interest_volume' THEN CASE WHEN l_linenumber = 1 THEN 0 ELSE l_tax END END AS b
       FROM lineitem, (VALUES ('margin_lending_ratio'), ('long_short_ratio'), ('open_interest_volume')) v(kind)""",
    "a b",
)
def read_sentiment_kinds(spark, sf_dir):
    """The other three kinds; a missing second value reads as 0."""
    line = _table(spark, sf_dir, "lineitem")

    def messages(*values):
        return line.select(F.col("l_returnflag").alias("coin"), _json(code=F.lit("0"), data=F.array(F.array(_text("l_orderkey"), *values))))

    one, two = messages(_text("l_quantity")), messages(_text("l_quantity"), F.when(F.col("l_linenumber") == 1, "").otherwise(_text("l_tax")))
    none = F.lit(None).cast("double")
    parts = [R.read_sentiment(one, k).select(F.lit(k).alias("kind"), "coin", "ts", F.col("ratio").alias("a"), none.alias("b")) for k in ("margin_lending_ratio", "long_short_ratio")]
    volumes = R.read_sentiment(two, "open_interest_volume")
    both = volumes.select(F.lit("open_interest_volume").alias("kind"), "coin", "ts", F.col("open_interest").alias("a"), F.col("volume").alias("b"))
    return parts[0].unionByName(parts[1]).unionByName(both)


@query(
    "read_book_array_sizes",
    """SELECT channel, seq, size, size::BIGINT AS levels, size * p + size * (size - 1) / 2.0 AS prices, p * size * (size - 1) / 2.0 + (size - 1) * size * (2 * size - 1) / 6.0 AS placed
       FROM (SELECT o_custkey AS channel, o_orderkey AS seq, [2, 50, 200, 500][CAST(o_orderkey // 4 % 4 + 1 AS INTEGER)]::INTEGER AS size,
       CAST(o_totalprice AS DOUBLE) AS p FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer))""",
    "prices placed", digits=2,
)
def read_book_array_sizes(spark, sf_dir):
    """Array books of all four sizes and all channels: levels, sum of prices, and of prices by their places."""
    size = F.element_at(F.array(*(F.lit(n) for n in (2, 50, 200, 500))), (F.floor(F.col("o_orderkey") / 4) % 4 + 1).cast("int"))
    prices = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.col("o_totalprice") + i).cast("array<string>")
    levels = F.concat(F.lit("[["), F.array_join(prices, ",3.0,1.5],[", "null"), F.lit(",3.0,1.5]]"))
    orders = _table(spark, sf_dir, "orders").repartition(4 * spark.sparkContext.defaultParallelism)  # a message is a hundred times its order
    raw = orders.select(
        F.concat(F.lit("["), F.concat_ws(",", _text("o_custkey"), levels, _text("o_orderkey"), F.lit("5")), F.lit("]")).alias("value")
    )
    listed = _table(spark, sf_dir, "customer")
    channels = listed.select(F.col("c_custkey").alias("channel"), F.concat(F.lit("t"), _text("c_custkey")).alias("symbol"))
    books = R.read_book_array(raw, channels).withColumn("size", F.size("levels"))
    # the plain explode filters by a copy of the array, messages read again and again for each mention
    levels = books.select("channel", "seq", "size", F.posexplode_outer("levels").alias("level", "x")).where("level IS NOT NULL")
    placed = F.sum(F.col("level") * F.col("x.price")).alias("placed")
    return levels.groupBy("channel", "seq", "size").agg(F.count(F.lit(1)).alias("levels"), F.sum("x.price").alias("prices"), placed)


@query("read_derivative_status", """SELECT concat('t', CAST(l_partkey AS VARCHAR)) AS key, l_orderkey AS time_ms, l_extendedprice AS mid_price, l_quantity AS mark_price,
       CASE WHEN l_linenumber = 1 THEN 0 ELSE l_tax END AS open_interest, l_discount AS clamp_max FROM lineitem""", "mid_price mark_price open_interest clamp_max")
def read_derivative_status(spark, sf_dir):
    null = F.lit("null")
    at = {0: F.concat(F.lit('"t'), _text("l_partkey"), F.lit('"')), 1: _text("l_orderkey"), 3: _text("l_extendedprice"), 4: F.lit("1.5"), 6: F.lit("2"), 8: F.lit("7"),
          9: F.lit("0.1"), 10: F.lit("3"), 12: F.lit("0.2"), 15: _text("l_quantity"), 18: F.when(F.col("l_linenumber") == 1, null).otherwise(_text("l_tax")), 22: F.lit("-0.1"), 23: _text("l_discount")}
    body = F.concat_ws(",", *(at.get(i, null) for i in range(24)))
    raw = _table(spark, sf_dir, "lineitem").select(F.concat(F.lit("["), body, F.lit("]")).alias("value"))
    return R.read_derivative_status(raw).select("key", "time_ms", "mid_price", "mark_price", "open_interest", "clamp_max")


def _result(df, **fields):
    return df.select(_json(success=F.lit(True), result=F.array(F.struct(*(c.alias(n) for n, c in fields.items())))))


@query("read_markets", "SELECT p_name AS name, p_size % 2 = 0 AS enabled, p_size % 3 = 0 AS post_only, p_retailprice AS ask, CASE WHEN p_size > 5 THEN p_retailprice END AS bid FROM part", "ask bid")
def read_markets(spark, sf_dir):
    size, price = F.col("p_size"), F.col("p_retailprice")
    raw = _result(_table(spark, sf_dir, "part"), name=F.col("p_name"), enabled=size % 2 == 0, postOnly=size % 3 == 0, ask=price, bid=F.when(size > 5, price))
    return R.read_markets(raw).select("name", "enabled", "post_only", "ask", "bid")


@query("read_funding_history", "SELECT concat('F', CAST(o_custkey AS VARCHAR)) AS future, o_totalprice AS rate, epoch_us(o_orderdate) // 1000 AS time_ms FROM orders", "rate")
def read_funding_history(spark, sf_dir):
    time = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ssXXX")
    return R.read_funding_history(_result(_table(spark, sf_dir, "orders"), future=F.concat(F.lit("F"), _text("o_custkey")), rate=F.col("o_totalprice"), time=time))


@query("read_futures", "SELECT o_orderkey, epoch_us(o_orderdate) // 1000 AS expiry_ms, o_totalprice AS mark, o_orderstatus = 'F' AS expired FROM orders", "mark")
def read_futures(spark, sf_dir):
    time = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ssXXX")
    raw = _result(_table(spark, sf_dir, "orders"), name=_text("o_orderkey"), expiry=time, mark=F.col("o_totalprice"), expired=F.col("o_orderstatus") == "F")
    return R.read_futures(raw).select(F.col("name").cast("bigint").alias("o_orderkey"), "expiry_ms", "mark", "expired")
