"""Feature rows of swaps, options and sentiment, and the joins that feed them.

A context has one row per instrument with each feed's latest record as a struct
(``oi``, ``fr``, ``ticker``, ``mark``, ...).  Sides of the joins are one row per instrument;
whether they are broadcast is left to Spark's size check.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.scalars import is_normal, parse_option_id
from tickloom.operators.latest import _latest, content_hash, latest_by, latest_funding, top_k_per_group
from tickloom.operators.prefix import ROWS_PER_KEY, dealt, each_step, large_keys, running, time_chunk
from tickloom.session import scratch_table

DAY_MS = 86_400_000

# Below this spread (in percent) the mid price replaces the last price.
SWAP_MID_SPREAD = 0.05
OPTION_MID_SPREAD = 0.1
# Coins with sentiment rows, and underlyings with option rows.
SENTIMENT_COINS = ["BTC", "ETH", "XRP", "LTC"]
OPTION_UNDERLYINGS = ["BTC-USD", "ETH-USD"]
OPTIONS_PER_UNDERLYING = 32


def packed(df: DataFrame, name: str, keys: Sequence[str] = ("inst_id",)) -> DataFrame:
    """All columns but the keys as one struct column."""
    return df.select(*keys, F.struct(*(c for c in df.columns if c not in keys)).alias(name))


# --- swap -----------------------------------------------------------------------


def latest_of(df: DataFrame, keys: Sequence[str] = ("inst_id",), keep: str = "last") -> DataFrame:
    return latest_by(df, keys, "ts", "arrival" if "arrival" in df.columns else None, keep)


def swap_context(oi: DataFrame, funding: DataFrame, ticker: DataFrame, mark: DataFrame) -> DataFrame:
    """Latest record of each feed, for instruments that have all four."""
    return (
        packed(latest_of(oi), "oi")
        .join(packed(latest_funding(funding, tie="arrival" if "arrival" in funding.columns else None), "fr"), "inst_id")
        .join(packed(latest_of(ticker), "ticker"), "inst_id")
        .join(packed(latest_of(mark), "mark"), "inst_id")
    )


def normalise_oi(oi, oi_ccy, ct_val, mark, last, strict: bool = False) -> Column:
    """Open interest in quote currency.

    Contracts times contract value; where that equals the amount in base currency (it is
    not above it by 0.1 % or more; with ``strict`` also not below), the amount in base
    currency times the mark price, or the last price without one.
    """
    oi, oi_ccy, ct_val, mark, last = (F.col(c) if isinstance(c, str) else c for c in (oi, oi_ccy, ct_val, mark, last))
    factor = F.when(ct_val > 0, ct_val).otherwise(1.0)
    contracts = oi * factor
    excess = F.try_divide(contracts, oi_ccy) - 1
    same = (F.abs(excess) if strict else excess) < 0.001
    price = F.coalesce(F.when(mark > 0, mark), last, F.lit(0.0))
    return F.when((oi_ccy > 0) & same & (price > 0), oi_ccy * price).otherwise(contracts)


def enrich_open_interest(
    oi: DataFrame, instruments: DataFrame, mark: DataFrame, ticker: DataFrame, strict: bool = False
) -> DataFrame:
    """Open interest records with ``oi`` normalised by left look-ups of contract value and price."""
    values = instruments.groupBy("inst_id").agg(F.max("ct_val").alias("_ct"))
    marks = latest_of(mark).select("inst_id", F.col("mark_px").alias("_mark"))
    lasts = latest_of(ticker).select("inst_id", F.col("last").alias("_last"))
    joined = oi.join(values, "inst_id", "left").join(marks, "inst_id", "left").join(lasts, "inst_id", "left")
    value = normalise_oi("oi", "oi_ccy", "_ct", "_mark", "_last", strict)
    return joined.withColumn("oi", value).select(*oi.columns)


def spread_pct(ask, bid) -> Column:
    return F.when((ask > 0) & (bid > 0), (F.try_divide(ask, bid) - 1) * 100).otherwise(0.0)


def ref_price(ticker: Column, limit: float) -> Column:
    """Mid price of a tight quote, else the last price."""
    ask, bid = ticker["ask_px"], ticker["bid_px"]
    tight = (ask > 0) & (bid > 0) & (spread_pct(ask, bid) < limit)
    return F.when(tight, (ask + bid) * 0.5).otherwise(ticker["last"])


def next_funding(fr: Column) -> Column:
    """The forecast, unless it is missing or not forecast; then the rate in settlement, or the current one."""
    forecast = F.coalesce(is_normal(fr["next_funding_rate"]), F.lit(False)) & ~F.coalesce(
        fr["method"] == "current_period", F.lit(False)
    )
    settling = (fr["sett_state"] == "processing") & is_normal(fr["sett_funding_rate"])
    return F.when(forecast, fr["next_funding_rate"]).when(settling, fr["sett_funding_rate"]).otherwise(fr["funding_rate"])


def change_pct(price: Column, base: Column) -> Column:
    return F.when(base > 0, (F.try_divide(price, base) - 1) * 100).otherwise(0.0)


def _price_columns(ticker: Column, price: Column) -> dict[str, Column]:
    low, high = ticker["low24h"], ticker["high24h"]
    return {
        "change_24h_percent": change_pct(price, ticker["open24h"]),
        "change_today_percent": change_pct(price, ticker["sod_utc0"]),
        "change_today_china_percent": change_pct(price, ticker["sod_utc8"]),
        "volume_24h": ticker["vol24h"],
        "price_ratio_24h": F.when((high > low) & (low > 0), F.try_divide(price - low, high - low)).otherwise(0.5),
        "last_price": price,
    }


def swap_row(context: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """The 16 swap features of each context row (plus ``extra`` columns such as a tick)."""
    oi, fr, ticker, mark = (F.col(c) for c in ("oi", "fr", "ticker", "mark"))
    ts = F.greatest(oi["ts"], fr["ts"])
    price = ref_price(ticker, SWAP_MID_SPREAD)
    to_mark = F.when((mark["mark_px"] > 0) & (price > 0), (F.try_divide(mark["mark_px"], price) - 1) * 100)
    columns = {
        "timestamp_ms": ts,
        "next_funding_in_ms": fr["next_funding_time"] - ts,
        "funding_rate": fr["funding_rate"],
        "next_funding_rate": next_funding(fr),
        "open_interest": oi["oi"],
        "open_interest_in_currency": oi["oi_ccy"],
        "spread_percent": spread_pct(ticker["ask_px"], ticker["bid_px"]),
        "spread_to_mark_percent": F.coalesce(to_mark, F.lit(0.0)),
        "ask_size": ticker["ask_sz"],
        "bid_size": ticker["bid_sz"],
        **_price_columns(ticker, price),
    }
    return context.select("inst_id", *extra, *(c.alias(n) for n, c in columns.items()))


def clock_ticks(feeds: Sequence[DataFrame], step_ms: int, end_ms: int | None = None) -> DataFrame:
    """Ticks ``(inst_id, tick_ms)`` of each instrument from its first record on.

    They end at ``end_ms``, or with the instrument's last record; each instrument generates
    its own, so nothing is cross joined. First and last ticks are written once, for all that reads the clock.
    """
    step = lambda x: F.col("ts") / step_ms if x is None else F.lit(x / step_ms)
    bounds = feeds[0].select("inst_id", "ts")
    for f in feeds[1:]:
        bounds = bounds.unionByName(f.select("inst_id", "ts"))
    # the last one only where it is asked for: tasks give these for nearly all their rows
    ends = {"_lo": F.min(F.ceil(step(None)).cast("bigint")), **({} if end_ms is not None else {"_hi": F.max(F.floor(step(None)).cast("bigint"))})}
    bounds = scratch_table(bounds.groupBy("inst_id").agg(*(c.alias(n) for n, c in ends.items())))
    last = F.floor(step(end_ms)).cast("bigint") if end_ms is not None else F.col("_hi")
    return each_step(bounds, F.col("_lo") * step_ms, last * step_ms, step_ms, "tick_ms", spread=True).select("inst_id", "tick_ms")


def context_asof(
    clock: DataFrame, feeds: dict[str, DataFrame], chunk_ms: int = DAY_MS * 30, keys: Sequence[str] = ("inst_id",),
    step_ms: int | None = None, rows_per_key: int = ROWS_PER_KEY,
) -> DataFrame:
    """At every tick the newest record of each feed at or before it, where all feeds have one.

    Ticks and records are put on one time line and the newest value carried forward; no range join is needed.
    Time lines of up to ``rows_per_key`` rows are moved once and are one window each; longer ones go in time chunks.
    Where all ticks are multiples of ``step_ms``, give it: then each feed of a long line is
    reduced to the newest record before each tick before it is sorted.
    """
    lines = clock.select(*keys)
    for f in feeds.values():
        lines = lines.unionByName(f.select(*keys))
    long, tasks = large_keys(lines, keys, rows_per_key)
    if long is None:
        return _asof_whole(clock, feeds, chunk_ms, keys, step_ms, tasks)
    some = lambda how: (clock.join(long, list(keys), how), {n: f.join(long, list(keys), how) for n, f in feeds.items()})
    short = _asof_whole(*some("left_anti"), chunk_ms, keys, step_ms, tasks)
    return short.unionByName(_asof_chunked(*some("left_semi"), chunk_ms, keys, step_ms))


def _line_of(clock: DataFrame, feeds: dict[str, DataFrame], at: Column, keys: Sequence[str], types: dict) -> DataFrame:
    """Ticks and records, ``ts`` and ``_tick`` telling which; ``at`` is the time of a record on the line."""
    line = clock.select(
        *keys, F.col("tick_ms").alias("ts"), F.lit(1).alias("_tick"), *(F.lit(None).cast(types[n]).alias(n) for n in types)
    )
    for name, f in feeds.items():
        record = F.struct(*types[name].names)
        line = line.unionByName(
            f.select(
                *keys, at.alias("ts"), F.lit(0).alias("_tick"),
                *((record if n == name else F.lit(None).cast(types[n])).alias(n) for n in types),
            )
        )
    return line


def _on_step(step_ms: int | None) -> Column:
    return F.col("ts") if step_ms is None else F.ceil(F.col("ts") / step_ms).cast("bigint") * step_ms


def _complete(carried: DataFrame, keys: Sequence[str], names) -> DataFrame:
    complete = F.col("_tick") == 1
    for n in names:
        complete = complete & F.col(f"_l_{n}").isNotNull()
    return carried.filter(complete).select(*keys, F.col("ts").alias("tick_ms"), *(F.col(f"_l_{n}").alias(n) for n in names))


def _asof_whole(
    clock: DataFrame, feeds: dict[str, DataFrame], chunk_ms: int, keys: Sequence[str], step_ms: int | None, tasks: int
) -> DataFrame:
    """A window for each key. Records of one time go by arrival, then by all columns; what has no key or no time is carried within its time chunk only."""
    types = {name: packed(f, name, keys).schema[name].dataType for name, f in feeds.items()}
    unknown = F.col("ts").isNull()
    for k in keys:
        unknown = unknown | F.col(k).isNull()
    apart = F.when(unknown, F.coalesce(time_chunk("ts", chunk_ms), F.lit(-1 << 63)))
    line = _line_of(clock, feeds, _on_step(step_ms), keys, types).withColumn("_apart", apart)
    ties = [x for n, t in types.items() for x in (F.col(n)["ts"], *([F.col(n)["arrival"]] if "arrival" in t.names else []), F.col(n))]
    line = dealt(line, tasks, *keys, "_apart")
    carried = running(line, [*keys, "_apart"], ["ts", "_tick", *ties], F.lit(0), lasts={f"_l_{n}": F.col(n) for n in types}, one_chunk=True)
    return _complete(carried, keys, types)


def _asof_chunked(clock: DataFrame, feeds: dict[str, DataFrame], chunk_ms: int, keys: Sequence[str], step_ms: int | None) -> DataFrame:
    types = {name: packed(f, name, keys).schema[name].dataType for name, f in feeds.items()}
    newest = {}
    for name, f in feeds.items():
        order = [F.col("ts"), *([F.col("arrival")] if "arrival" in f.columns else [])]
        newest[name] = _latest(f.withColumn("_at", _on_step(step_ms)), [*keys, "_at"], order)
    carried = running(
        _line_of(clock, newest, F.col("_at"), keys, types), keys, ["ts", "_tick"], time_chunk("ts", chunk_ms),
        lasts={f"_l_{n}": F.col(n) for n in types},
    )
    return _complete(carried, keys, types)


def swap_context_asof(
    clock: DataFrame, oi: DataFrame, funding: DataFrame, ticker: DataFrame, mark: DataFrame, chunk_ms: int = DAY_MS * 30,
    step_ms: int | None = None,
) -> DataFrame:
    """:func:`swap_context` at every tick of a clock ``(inst_id, tick_ms)``, as in :func:`context_asof`."""
    return context_asof(clock, {"oi": oi, "fr": funding, "ticker": ticker, "mark": mark}, chunk_ms, step_ms=step_ms)


# --- options --------------------------------------------------------------------


def pick_options(
    oi: DataFrame, ticker: DataFrame, as_of, k: int = OPTIONS_PER_UNDERLYING, prefer_volume: bool = False
) -> DataFrame:
    """The ``k`` most interesting options of each underlying, with rank.

    Options without open interest come last.  The others are ranked by open interest over
    the log of the days to expiry, and by the magnitude of the 24 h volume, before that
    with ``prefer_volume`` or else after it; then by strike, date and side.
    """
    joined = (
        packed(latest_of(oi, keep="first"), "oi")
        .withColumn("option", parse_option_id("inst_id"))
        .filter(F.col("option").isNotNull())
        .join(packed(latest_of(ticker, keep="first"), "ticker"), "inst_id")
    )
    option, amount = F.col("option"), F.col("oi")["oi"]
    days = F.greatest(F.datediff(option["expiry"], F.lit(as_of).cast("date")), F.lit(1))
    score = amount / (F.log2(days.cast("double")) + 1e-3)
    magnitude = F.floor(F.log10(F.greatest(F.col("ticker")["vol24h"], F.lit(1.0)))).cast("int")
    open_ = amount != 0
    keys = [F.when(open_, magnitude), F.when(open_, score)]
    if not prefer_volume:
        keys.reverse()
    identity = [
        option["strike"], option["year"], option["month"], option["day"],
        F.when(option["side"] == "P", 1).otherwise(2),
    ]
    order = [x.desc() for x in [open_, *keys, *identity]] + [F.col("inst_id")]
    ranked = joined.withColumn("underlying", option["underlying"])
    return top_k_per_group(ranked, ["underlying"], order, k, rank="rank")


def option_context(
    oi: DataFrame, ticker: DataFrame, summary: DataFrame, instruments: DataFrame, picked: DataFrame | None = None
) -> DataFrame:
    """Options that have all four feeds, one row each; ids that cannot be read are left out.

    ``picked`` (from :func:`pick_options`) takes the place of ``oi`` and ``ticker``.
    """
    if picked is None:
        picked = (
            packed(latest_of(oi, keep="first"), "oi")
            .withColumn("option", parse_option_id("inst_id"))
            .filter(F.col("option").isNotNull())
            .join(packed(latest_of(ticker, keep="first"), "ticker"), "inst_id")
            .withColumn("underlying", F.col("option")["underlying"])
        )
    one = lambda df: latest_of(df) if "ts" in df.columns else _latest(df, ["inst_id"], [])
    return picked.join(packed(one(summary), "summary"), "inst_id").join(packed(one(instruments), "instrument"), "inst_id")


def option_row(context: DataFrame) -> DataFrame:
    """The 25 option features of each context row."""
    oi, ticker, s, inst, option = (F.col(c) for c in ("oi", "ticker", "summary", "instrument", "option"))
    ts = F.greatest(oi["ts"], ticker["ts"], s["ts"])
    price = ref_price(ticker, OPTION_MID_SPREAD)
    greeks = "delta gamma vega theta delta_bs gamma_bs vega_bs theta_bs lever mark_vol bid_vol ask_vol".split()
    columns = {
        "timestamp_ms": ts,
        "expiry_in_ms": F.greatest(inst["exp_time"] - ts, F.lit(0)).cast("double"),
        **{g: s[g] for g in greeks},
        "forward_price": s["fwd_px"],
        "open_interest": oi["oi"],
        "spread_percent": spread_pct(ticker["ask_px"], ticker["bid_px"]),
        "spread_to_mark_percent": change_pct(s["fwd_px"], option["strike"]),
        **_price_columns(ticker, price),
        "price": option["strike"],
    }
    return context.select("inst_id", "underlying", *(c.alias(n) for n, c in columns.items()))


def option_book_hash(context: DataFrame) -> DataFrame:
    """Digest per underlying of the picked ids, their open interest and last price."""
    flat = context.select(
        "underlying", "inst_id", F.col("oi")["oi"].alias("oi"), F.col("ticker")["last"].alias("last")
    )
    return content_hash(flat, ["underlying"], ["inst_id", "oi", "last"], "book_hash")


# --- sentiment ------------------------------------------------------------------


def sentiment_context(
    taker_contracts: DataFrame, taker_spot: DataFrame, margin_lending: DataFrame, long_short: DataFrame,
    oi_volume: DataFrame, supported: DataFrame, coins: Sequence[str] = tuple(SENTIMENT_COINS),
) -> DataFrame:
    """Latest record of the five feeds per coin, for wanted coins the exchange lists."""
    feeds = {
        "taker_contracts": taker_contracts,
        "taker_spot": taker_spot,
        "margin_lending": margin_lending,
        "long_short": long_short,
        "oi_volume": oi_volume,
    }
    out = None
    for name, df in feeds.items():
        one = packed(latest_of(df.filter(F.col("coin").isin(list(coins))), ["coin"]), name, ["coin"])
        out = one if out is None else out.join(one, "coin")
    return out.join(supported.select("coin").distinct(), "coin", "left_semi")


def sentiment_row(context: DataFrame) -> DataFrame:
    """The 9 sentiment features; the row's time is the newest of its inputs'."""
    spot, contracts, margin, ratio, oi = (
        F.col(c) for c in ("taker_spot", "taker_contracts", "margin_lending", "long_short", "oi_volume")
    )
    return context.select(
        "coin",
        F.greatest(spot["ts"], contracts["ts"], margin["ts"], ratio["ts"], oi["ts"]).alias("timestamp_ms"),
        spot["sell_volume"].alias("sell_taker_volume_spot"),
        spot["buy_volume"].alias("buy_taker_volume_spot"),
        contracts["sell_volume"].alias("sell_taker_volume_contracts"),
        contracts["buy_volume"].alias("buy_taker_volume_contracts"),
        margin["ratio"].alias("margin_lending_ratio"),
        ratio["ratio"].alias("long_short_ratio"),
        oi["open_interest"].alias("open_interest"),
        oi["volume"].alias("volume"),
    )
