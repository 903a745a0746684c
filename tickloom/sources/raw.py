"""Landed raw messages (one JSON text per row in ``value``) as typed rows.

All readers work on batch and streaming DataFrames alike: files of JSON lines, or Kafka
values cast to string.  Schemas are fixed; nothing is inferred.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.scalars import FLAG_BUY, FLAG_LIQUIDATION, FLAG_SELL, safe_double, safe_long

INT_MAX = 2_147_483_647
# Level counts of an array book that are accepted.
ARRAY_BOOK_SIZES = [2, 50, 200, 500]


def read_lines(spark, path: str, streaming: bool = False, **options) -> DataFrame:
    """JSON lines as ``value``."""
    reader = (spark.readStream if streaming else spark.read).format("text")
    for k, v in options.items():
        reader = reader.option(k, v)
    return (reader.schema("value string") if streaming else reader).load(path)


def _rest(raw: DataFrame) -> list[str]:
    return [c for c in raw.columns if c != "value"]


def _exploded(df: DataFrame, array: Column, name: str, keep: list[str]) -> DataFrame:
    """One row per element.

    The outer form with a filter behind it: for the plain form the optimizer puts checks of
    the array in front, and the message would be parsed once for each.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def _parsed(raw: DataFrame, schema: str) -> DataFrame:
    return raw.withColumn("m", F.from_json("value", schema))


# --- trades ---------------------------------------------------------------------

TRADE_SCHEMA = "id bigint, price double, size double, side string, liquidation boolean, time string"


def read_trades(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trades, and the rejected messages: unreadable ones or those of an unknown side."""
    m = F.col("m")
    flag = (
        F.when(m["side"] == "buy", FLAG_BUY).when(m["side"] == "sell", FLAG_SELL)
        + F.when(F.coalesce(m["liquidation"], F.lit(False)), FLAG_LIQUIDATION).otherwise(0)
    )
    rows = _parsed(raw, TRADE_SCHEMA).select(
        *_rest(raw), "value", m["id"].alias("id"),
        F.unix_millis(m["time"].try_cast("timestamp")).alias("time_ms"),
        m["price"].alias("price"), m["size"].alias("volume"), flag.cast("smallint").alias("flag"),
    )
    good = F.col("id").isNotNull() & F.col("time_ms").isNotNull() & F.col("flag").isNotNull()
    good = good & F.col("price").isNotNull() & F.col("volume").isNotNull()
    return rows.filter(good).drop("value"), rows.filter(~good).select(*_rest(raw), "value")


# --- books ----------------------------------------------------------------------

def _pairs(levels: Column) -> Column:
    return F.transform(
        levels, lambda x: F.struct(F.get(x, F.lit(0)).try_cast("double").alias("price"), F.get(x, F.lit(1)).try_cast("double").alias("qty"))
    )


def read_depth_updates(raw: DataFrame) -> DataFrame:
    """Depth deltas exploded to one row per level; ids of 0 count as absent.

    The message's names differ only by case (``u``/``U``, ``e``/``E``), so its fields are read
    as a map: map keys keep their case.
    """
    field = lambda n: F.col("m")["data"][n]
    absent = lambda c: F.when(c != 0, c)
    sides = lambda n: _pairs(F.from_json(field(n), "array<array<string>>"))
    tagged = lambda n, side: F.transform(
        F.coalesce(sides(n), F.array()), lambda x: F.struct(F.lit(side).alias("side"), x["price"].alias("price"), x["qty"].alias("qty"))
    )
    rows = _parsed(raw, "stream string, data map<string, string>").select(
        *_rest(raw), field("s").alias("symbol"), field("U").try_cast("bigint").alias("first_id"), field("u").try_cast("bigint").alias("final_id"),
        absent(field("pu").try_cast("bigint")).alias("prev_id"), field("E").try_cast("bigint").alias("event_ms"),
        absent(field("T").try_cast("bigint")).alias("transaction_ms"), F.concat(tagged("b", "bid"), tagged("a", "ask")).alias("_levels"),
    )
    keep = [c for c in rows.columns if c != "_levels"]
    levels = _exploded(rows, F.col("_levels"), "_x", keep)
    return levels.select(*keep, "_x.side", "_x.price", "_x.qty")


def read_book_snapshot_rest(raw: DataFrame, date_ms: Column | None = None) -> DataFrame:
    """Fetched snapshot ``{lastUpdateId, bids, asks}`` as level arrays."""
    m = F.col("m")
    schema = "lastUpdateId bigint, bids array<array<string>>, asks array<array<string>>"
    when = [] if date_ms is None else [date_ms.alias("time_ms")]
    return _parsed(raw, schema).select(
        *_rest(raw), m["lastUpdateId"].alias("last_id"), *when, _pairs(m["bids"]).alias("bids"), _pairs(m["asks"]).alias("asks")
    )


PUSH_SCHEMA = (
    "arg struct<channel string, instId string>, action string,"
    " data array<struct<asks array<array<string>>, bids array<array<string>>, ts string, checksum string>>"
)


def read_book_snapshot_push(raw: DataFrame) -> DataFrame:
    """Pushed snapshots: levels of 4 or 5 texts (the last is the order count), in rising price."""
    m = F.col("m")
    levels = lambda c: F.array_sort(
        F.transform(
            c,
            lambda x: F.struct(
                F.get(x, F.lit(0)).try_cast("double").alias("price"), F.get(x, F.lit(1)).try_cast("double").alias("qty"),
                F.least(F.element_at(x, -1).try_cast("bigint"), F.lit(INT_MAX)).cast("int").alias("count"),
            ),
        )
    )
    first = F.get(m["data"], F.lit(0))
    return _parsed(raw, PUSH_SCHEMA).filter(m["action"] == "snapshot").select(
        *_rest(raw), m["arg"]["instId"].alias("inst_id"), safe_long(first["ts"]).alias("time_ms"),
        safe_long(first["checksum"]).alias("checksum"), levels(first["bids"]).alias("bids"), levels(first["asks"]).alias("asks"),
    )


_WHOLE = "(?:0|-?[1-9][0-9]{0,17})"  # -0 is 0 as a whole number
_DECIMAL = rf"(?:{_WHOLE}|-?(?:0|[1-9][0-9]{{0,17}})\.[0-9]{{1,20}})"
_NUMBER = rf"{_DECIMAL}(?:[eE][+-]?[0-9]{{1,2}})?"
_LEVEL = rf"\[{_NUMBER},{_DECIMAL},{_NUMBER}\]"
#: An array book without spaces, whose levels are three numbers each; what such a text says as JSON needs no JSON parser.
PLAIN_BOOK = rf"^\[{_WHOLE},\[{_LEVEL}(?:,{_LEVEL})*\],{_WHOLE},{_WHOLE}\]$"
#: Bytes of an Arrow batch of messages.
BATCH_BYTES = 8 << 20
_PLAIN_FIELDS = "_channel bigint, _seq bigint, _time bigint, _levels array<struct<price: double, count: bigint, size: double>>"


def _plain_books() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of Arrow batches that adds the fields of plain messages, whose ``value`` is null from then on; other messages stay as they are."""
    pattern, names, line_ends = PLAIN_BOOK, ["price", "count", "size"], bytes.maketrans(b"]", b"\n")

    def cut(batches):
        read = csv.ReadOptions(column_names=["", *names], use_threads=False, block_size=4 << 20)
        parse = csv.ParseOptions(quote_char=False)
        types = csv.ConvertOptions(column_types=dict.fromkeys(names, pa.float64()), include_columns=names, null_values=[], check_utf8=False)
        for batch in batches:
            at = batch.schema.get_field_index("value")
            value = batch.column(at)
            plain = pc.fill_null(pc.match_substring_regex(value, pattern), False)
            heads, tails, lines = [], [], []
            for message in value.filter(plain).cast(pa.binary()).to_pylist():
                head, _, rest = message.partition(b",[[")
                levels, _, tail = rest.rpartition(b"]],")
                heads.append(int(head[1:]))
                tails.append(tail[:-1].split(b","))
                # a line for each level, which begins with a comma
                lines.append(b"," + levels.translate(line_ends, b"[") + b"\n")
            columns = [np.zeros(0)] * 3
            if lines:
                found = csv.read_csv(pa.py_buffer(b"".join(lines)), read_options=read, parse_options=parse, convert_options=types)
                columns = [found.column(n).to_numpy() for n in names]
            sizes = np.zeros(len(value), np.int64)
            chosen = plain.to_numpy(zero_copy_only=False)
            sizes[chosen] = [x.count(b"\n") for x in lines]
            put = np.cumsum(chosen) - 1

            def whole(values, chosen=chosen, put=put):
                out = np.zeros(len(chosen), np.int64)
                out[chosen] = np.array(values, np.int64)[put[chosen]]
                return pa.array(out, mask=~chosen)

            ends = np.append(0, np.cumsum(sizes)).astype(np.int32)
            books = pa.StructArray.from_arrays([pa.array(columns[0]), pa.array(columns[1].astype(np.int64)), pa.array(columns[2])], names=names)
            fields = [whole(heads), whole([int(x) for x, _ in tails]), whole([int(x) for _, x in tails]), pa.ListArray.from_arrays(pa.array(ends), books, mask=pa.array(~chosen))]
            others = value.take(pa.array(np.arange(len(value)), mask=chosen))
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], others, *batch.columns[at + 1 :], *fields], names=[*batch.schema.names, "_channel", "_seq", "_time", "_levels"])

    return cut


def read_book_array(raw: DataFrame, channels: DataFrame) -> DataFrame:
    """Array books ``[channel, [[price, count, size] ...], seq, time]`` of a known channel.

    ``channels`` is ``(channel, symbol)``; books of unexpected length are left out. Plain messages are cut by Arrow, all others are parsed as JSON.
    """
    raw.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in raw.schema]
    cut = raw.mapInArrow(_plain_books(), ", ".join([*fields, _PLAIN_FIELDS]))
    item = F.from_json("value", "array<string>")
    long = lambda i, plain: F.coalesce(plain, F.get("_m", F.lit(i)).try_cast("bigint"))
    parsed = F.struct(
        long(0, "_channel").alias("channel"), F.from_json(F.get("_m", F.lit(1)), "array<array<double>>").alias("_l"),
        long(2, "_seq").alias("seq"), long(3, "_time").alias("time_ms"),
    )
    # from a generator, whose columns a filter can't be moved below of: moved, it would read each message a second time
    rows = cut.withColumn("_m", item).select(*_rest(raw), "_levels", F.inline_outer(F.array(parsed)))
    levels = F.transform(
        "_l",
        lambda x: F.struct(
            F.get(x, F.lit(0)).alias("price"), F.get(x, F.lit(1)).cast("bigint").alias("count"), F.get(x, F.lit(2)).alias("size")
        ),
    )
    size = F.when(F.col("_levels").isNotNull(), F.size("_levels")).otherwise(F.size("_l"))
    kept = rows.filter(size.isin(ARRAY_BOOK_SIZES)).withColumn("levels", F.coalesce("_levels", levels)).drop("_l", "_levels")
    return kept.join(channels.select("channel", "symbol").filter(F.length(F.trim("symbol")) > 0), "channel")


# --- candles and listings ---------------------------------------------------------

KLINE_FIELDS = {
    "open_time": "bigint", "open": "double", "high": "double", "low": "double", "close": "double", "volume": "double",
    "close_time": "bigint", "quote_volume": "double", "trades": "int", "taker_base_volume": "double", "taker_quote_volume": "double",
}


def read_klines(raw: DataFrame) -> DataFrame:
    """The 11 used fields of candle arrays; one candle or a page of candles per message.

    The first element tells a page from a candle, wherever the message has blanks; an empty page has no candles.
    """
    # behind a generator the optimizer does not put the parser in the place of each use of what it gives
    read = raw.select(*_rest(raw), F.explode_outer(F.array(F.from_json("value", "array<string>"))).alias("_parts"))
    parts = F.col("_parts")
    candles = F.transform(parts, lambda x: F.from_json(x, "array<string>"))
    page = F.when(F.size(parts) == 0, F.array().cast("array<array<string>>")).when(F.get(parts, F.lit(0)).startswith("["), candles).otherwise(F.array(parts))
    rows = _exploded(read, page, "k", _rest(raw))
    return rows.select(*_rest(raw), *(F.get("k", F.lit(i)).try_cast(t).alias(n) for i, (n, t) in enumerate(KLINE_FIELDS.items())))


# The fields of each feed with the value that replaces an unreadable number.
TEXT, LONG = "text", "long"
SWAP_FEEDS: dict[str, dict[str, tuple[str, object]]] = {
    "open_interest": {"oi": ("oi", 0.0), "oiCcy": ("oi_ccy", 0.0), "ts": ("ts", LONG)},
    "mark_price": {"markPx": ("mark_px", -0.0), "ts": ("ts", LONG)},
    "ticker": {
        "last": ("last", -0.0), "lastSz": ("last_sz", -0.0), "askPx": ("ask_px", -0.0), "askSz": ("ask_sz", -0.0),
        "bidPx": ("bid_px", -0.0), "bidSz": ("bid_sz", -0.0), "open24h": ("open24h", -0.0), "high24h": ("high24h", -0.0),
        "low24h": ("low24h", -0.0), "volCcy24h": ("vol_ccy24h", -0.0), "vol24h": ("vol24h", -0.0),
        "sodUtc0": ("sod_utc0", -0.0), "sodUtc8": ("sod_utc8", -0.0), "ts": ("ts", LONG),
    },
    "funding_rate": {
        "fundingRate": ("funding_rate", 0.0), "fundingTime": ("funding_time", LONG), "nextFundingRate": ("next_funding_rate", 0.0),
        "nextFundingTime": ("next_funding_time", LONG), "maxFundingRate": ("max_funding_rate", 0.0), "method": ("method", TEXT),
        "minFundingRate": ("min_funding_rate", 0.0), "premium": ("premium", 0.0), "settFundingRate": ("sett_funding_rate", 0.0),
        "settState": ("sett_state", TEXT), "ts": ("ts", LONG),
    },
    "instrument": {
        "instFamily": ("inst_family", TEXT), "uly": ("uly", TEXT), "category": ("category", TEXT), "baseCcy": ("base_ccy", TEXT),
        "quoteCcy": ("quote_ccy", TEXT), "settleCcy": ("settle_ccy", TEXT), "ctVal": ("ct_val", 1.0), "ctMult": ("ct_mult", 1.0),
        "ctValCcy": ("ct_val_ccy", TEXT), "optType": ("opt_type", TEXT), "stk": ("stk", -0.0), "listTime": ("list_time", LONG),
        "expTime": ("exp_time", -0.0), "lever": ("lever", 1.0), "tickSz": ("tick_sz", 1.0), "lotSz": ("lot_sz", 1.0),
        "minSz": ("min_sz", -0.0), "ctType": ("ct_type", TEXT), "alias": ("alias", TEXT), "state": ("state", TEXT),
        "maxLmtSz": ("max_lmt_sz", -0.0), "maxMktSz": ("max_mkt_sz", -0.0), "maxTwapSz": ("max_twap_sz", -0.0),
        "maxIcebergSz": ("max_iceberg_sz", -0.0), "maxTriggerSz": ("max_trigger_sz", -0.0), "maxStopSz": ("max_stop_sz", -0.0),
    },
    "option_summary": {
        "uly": ("uly", TEXT), "delta": ("delta", -0.0), "gamma": ("gamma", -0.0), "vega": ("vega", -0.0), "theta": ("theta", -0.0),
        "deltaBS": ("delta_bs", -0.0), "gammaBS": ("gamma_bs", -0.0), "vegaBS": ("vega_bs", -0.0), "thetaBS": ("theta_bs", -0.0),
        "lever": ("lever", -0.0), "markVol": ("mark_vol", -0.0), "bidVol": ("bid_vol", -0.0), "askVol": ("ask_vol", -0.0),
        "realVol": ("real_vol", -0.0), "fwdPx": ("fwd_px", -0.0), "ts": ("ts", LONG),
    },
}


def read_swap_feeds(raw: DataFrame, kind: str) -> DataFrame:
    """Records of an envelope ``{code, msg, data: [...]}``; numbers are texts with a default per field."""
    fields = SWAP_FEEDS[kind]
    schema = ", ".join(f"`{f}`: string" for f in ("instType", "instId", *fields))
    rows = _exploded(_parsed(raw, f"code string, msg string, data array<struct<{schema}>>"), F.col("m.data"), "d", _rest(raw))

    def value(name: str, default) -> Column:
        text = F.col("d")[name]
        if default == TEXT:
            return text
        return safe_long(text) if default == LONG else safe_double(text, default)

    return rows.select(
        *_rest(raw), F.col("d")["instType"].alias("inst_type"), F.col("d")["instId"].alias("inst_id"),
        *(value(f, default).alias(n) for f, (n, default) in fields.items()),
    )


# The positions of each sentiment feed after the time.
SENTIMENT_FEEDS = {
    "taker_volume": ["sell_volume", "buy_volume"],
    "margin_lending_ratio": ["ratio"],
    "long_short_ratio": ["ratio"],
    "open_interest_volume": ["open_interest", "volume"],
}


def read_sentiment(raw: DataFrame, kind: str) -> DataFrame:
    """Positional records ``[ts, a, b?]`` of an envelope; the coin comes along as a column of ``raw``."""
    rows = _exploded(_parsed(raw, "code string, data array<array<string>>"), F.col("m.data"), "d", _rest(raw))
    return rows.select(
        *_rest(raw), safe_long(F.get("d", F.lit(0))).alias("ts"),
        *(safe_double(F.get("d", F.lit(i + 1))).alias(n) for i, n in enumerate(SENTIMENT_FEEDS[kind])),
    )


# Where the fields of a derivative status stand in its array.
DERIVATIVE_FIELDS = {
    "key": (0, "string"), "time_ms": (1, "bigint"), "mid_price": (3, "double"), "spot_price": (4, "double"),
    "insurance_fund_balance": (6, "double"), "next_funding_ms": (8, "bigint"), "next_funding_accrued": (9, "double"),
    "next_funding_step": (10, "int"), "current_funding": (12, "double"), "mark_price": (15, "double"),
    "open_interest": (18, "double"), "clamp_min": (22, "double"), "clamp_max": (23, "double"),
}


def read_derivative_status(raw: DataFrame) -> DataFrame:
    """The 13 used positions of a derivative status; the last three default to 0."""
    rows = raw.withColumn("_m", F.from_json("value", "array<string>"))
    zero = ("open_interest", "clamp_min", "clamp_max")
    item = lambda n, i, t: F.get("_m", F.lit(i)).try_cast(t)
    return rows.select(
        *_rest(raw),
        *((F.coalesce(item(n, i, t), F.lit(0.0)) if n in zero else item(n, i, t)).alias(n) for n, (i, t) in DERIVATIVE_FIELDS.items()),
    )


# Listing fields (name in the message, our name, type).
MARKET_FIELDS = (
    "name name string, baseCurrency base_currency string, quoteCurrency quote_currency string, quoteVolume24h quote_volume24h double,"
    " change1h change1h double, change24h change24h double, changeBod change_bod double, highLeverageFeeExempt high_leverage_fee_exempt boolean,"
    " minProvideSize min_provide_size double, type type string, underlying underlying string, enabled enabled boolean, ask ask double,"
    " bid bid double, last last double, postOnly post_only boolean, price price double, priceIncrement price_increment double,"
    " sizeIncrement size_increment double, restricted restricted boolean, volumeUsd24h volume_usd24h double,"
    " largeOrderThreshold large_order_threshold double, isEtfMarket is_etf_market boolean"
)
FUNDING_FIELDS = "future future string, rate rate double, time time string"
FUTURE_FIELDS = (
    "name name string, underlying underlying string, description description string, type type string, expiry expiry string,"
    " perpetual perpetual boolean, expired expired boolean, enabled enabled boolean, postOnly post_only boolean,"
    " priceIncrement price_increment double, sizeIncrement size_increment double, last last double, bid bid double, ask ask double,"
    " index index double, mark mark double, imfFactor imf_factor double, lowerBound lower_bound double, upperBound upper_bound double,"
    " underlyingDescription underlying_description string, expiryDescription expiry_description string, moveStart move_start string,"
    " marginPrice margin_price double, positionLimitWeight position_limit_weight double, group group string, change1h change1h double,"
    " change24h change24h double, changeBod change_bod double, volumeUsd24h volume_usd24h double, volume volume double,"
    " openInterest open_interest double, openInterestUsd open_interest_usd double"
)


def _listing(raw: DataFrame, fields: str) -> DataFrame:
    parts = [f.split() for f in fields.split(",")]
    schema = ", ".join(f"`{a}`: {t}" for a, _, t in parts)
    rows = _exploded(_parsed(raw, f"success boolean, result array<struct<{schema}>>"), F.col("m.result"), "d", _rest(raw))
    return rows.select(*_rest(raw), *(F.col("d")[a].alias(n) for a, n, _ in parts))


def _time(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.withColumn(name, F.unix_millis(F.col(column).try_cast("timestamp"))).drop(column)


def read_markets(raw: DataFrame) -> DataFrame:
    return _listing(raw, MARKET_FIELDS)


def read_funding_history(raw: DataFrame) -> DataFrame:
    return _time(_listing(raw, FUNDING_FIELDS), "time", "time_ms")


def read_futures(raw: DataFrame) -> DataFrame:
    return _time(_listing(raw, FUTURE_FIELDS), "expiry", "expiry_ms")
