"""Queries on latest values, feature rows and ordered change detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import features as D
from tickloom.operators import latest as L
from tickloom.plans.registry import query
from tickloom.plans.views import view, with_views
from tickloom.session import prepare

DAY_MS = 86_400_000


def _table(spark, sf_dir, name):
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def newest_sql(source: str, name: str, keys: str = "inst_id", order: str = "ts DESC, arrival DESC", payload: str = "") -> str:
    """CTE: newest row per key, ties by payload."""
    tie = "".join(f", {c} DESC" for c in payload.split())
    return (
        f"{name} AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}{tie}) AS rn"
        f" FROM {source}) WHERE rn = 1)"
    )


# payload columns in view order, the way ties are told apart
OI_COLS = "oi oi_ccy"
FR_COLS = "funding_rate next_funding_rate funding_time next_funding_time ts method sett_state sett_funding_rate arrival"
TK_COLS = "last ask_px bid_px ask_sz bid_sz low24h high24h open24h sod_utc0 sod_utc8 vol24h"
NEWEST_OI = newest_sql("open_interest", "oi1", payload=OI_COLS)
NEWEST_FR = newest_sql("funding", "fr1", order="funding_time DESC, ts DESC, arrival ASC", payload=FR_COLS)
NEWEST_TK = newest_sql("ticker", "tk1", payload=TK_COLS)
FEEDS = "open_interest funding ticker mark_price"


def swap_row_sql(source: str, extra: str = "") -> str:
    """SELECT of the swap features from columns named ``oi_*``-free as in the views, with ``ots``/``fts`` for the two times."""
    price = "(CASE WHEN ask_px > 0 AND bid_px > 0 AND (ask_px / bid_px - 1) * 100 < 0.05E0 THEN (ask_px + bid_px) * 0.5E0 ELSE last END)"
    change = lambda base: f"CASE WHEN {base} > 0 THEN ({price} / {base} - 1) * 100 ELSE 0.0E0 END"
    return f"""SELECT inst_id, {extra} greatest(ots, fts) AS timestamp_ms, next_funding_time - greatest(ots, fts) AS next_funding_in_ms,
      funding_rate, CASE WHEN next_funding_rate <> 0 AND method <> 'current_period' THEN next_funding_rate
        WHEN sett_state = 'processing' AND sett_funding_rate <> 0 THEN sett_funding_rate ELSE funding_rate END AS next_funding_rate,
      oi AS open_interest, oi_ccy AS open_interest_in_currency,
      CASE WHEN ask_px > 0 AND bid_px > 0 THEN (ask_px / bid_px - 1) * 100 ELSE 0.0E0 END AS spread_percent,
      CASE WHEN mark_px > 0 AND {price} > 0 THEN (mark_px / {price} - 1) * 100 ELSE 0.0E0 END AS spread_to_mark_percent,
      ask_sz AS ask_size, bid_sz AS bid_size, {change('open24h')} AS change_24h_percent,
      {change('sod_utc0')} AS change_today_percent, {change('sod_utc8')} AS change_today_china_percent,
      vol24h AS volume_24h, CASE WHEN high24h > low24h AND low24h > 0 THEN ({price} - low24h) / (high24h - low24h)
        ELSE 0.5E0 END AS price_ratio_24h, {price} AS last_price FROM {source}"""


SWAP_DOUBLES = """funding_rate next_funding_rate open_interest open_interest_in_currency spread_percent spread_to_mark_percent
ask_size bid_size change_24h_percent change_today_percent change_today_china_percent volume_24h price_ratio_24h last_price"""

SWAP_JOIN = """ctx AS (SELECT inst_id, oi, oi_ccy, oi1.ts AS ots, funding_rate, next_funding_rate, next_funding_time, fr1.ts AS fts,
   method, sett_state, sett_funding_rate, tk1.* EXCLUDE (inst_id, ts, arrival), mark_px
   FROM oi1 JOIN fr1 USING (inst_id) JOIN tk1 USING (inst_id) JOIN mark_price USING (inst_id))"""


def _feeds(spark, sf_dir):
    return tuple(view(spark, sf_dir, n) for n in FEEDS.split())


@query("latest_by", with_views("ticker", f"WITH {NEWEST_TK} SELECT * FROM tk1"), TK_COLS)
def latest_by(spark, sf_dir):
    return L.latest_by(view(spark, sf_dir, "ticker"), ["inst_id"], "ts", "arrival")


@query("latest_by_first", with_views("ticker", f"WITH {newest_sql('ticker', 'tk1', order='ts DESC, arrival ASC', payload=TK_COLS)} SELECT * FROM tk1"), TK_COLS)
def latest_by_first(spark, sf_dir):
    return L.latest_by(view(spark, sf_dir, "ticker"), ["inst_id"], "ts", "arrival", keep="first")


@query("latest_funding", with_views("funding", f"WITH {NEWEST_FR} SELECT * FROM fr1"), "funding_rate next_funding_rate sett_funding_rate", digits=8)
def latest_funding(spark, sf_dir):
    return L.latest_funding(view(spark, sf_dir, "funding"))


@query(
    "swap_context",
    with_views(FEEDS, f"WITH {NEWEST_OI}, {NEWEST_FR}, {NEWEST_TK}, {SWAP_JOIN} SELECT inst_id, oi, ots AS oi_ts, funding_rate, fts AS fr_ts, last, mark_px FROM ctx"),
    "oi funding_rate last mark_px",
)
def swap_context(spark, sf_dir):
    c = D.swap_context(*_feeds(spark, sf_dir))
    return c.select(
        "inst_id", "oi.oi", F.col("oi.ts").alias("oi_ts"), "fr.funding_rate", F.col("fr.ts").alias("fr_ts"), "ticker.last", "mark.mark_px"
    )


@query("swap_row", with_views(FEEDS, f"WITH {NEWEST_OI}, {NEWEST_FR}, {NEWEST_TK}, {SWAP_JOIN} {swap_row_sql('ctx')}"), SWAP_DOUBLES, digits=6)
def swap_row(spark, sf_dir):
    return D.swap_row(D.swap_context(*_feeds(spark, sf_dir)))


_OI_VALUE = """CASE WHEN oi_ccy > 0 AND oi * f / oi_ccy - 1 < 0.001E0 AND p > 0 THEN oi_ccy * p ELSE oi * f END"""


@query(
    "enrich_open_interest",
    with_views("open_interest instruments mark_price ticker", f"""WITH {NEWEST_TK},
      j AS (SELECT o.inst_id, o.oi, oi_ccy, o.ts, o.arrival, CASE WHEN ct_val > 0 THEN ct_val ELSE 1 END AS f,
              coalesce(CASE WHEN mark_px > 0 THEN mark_px END, last, 0) AS p
            FROM open_interest o LEFT JOIN (SELECT * FROM instruments WHERE state = 'live') i ON o.inst_id = i.inst_id
            LEFT JOIN (SELECT * FROM mark_price WHERE mark_px < 1200) m ON o.inst_id = m.inst_id LEFT JOIN tk1 t ON o.inst_id = t.inst_id)
      SELECT inst_id, {_OI_VALUE} AS oi, oi_ccy, ts, arrival FROM j"""),
    "oi oi_ccy", digits=3,
)
def enrich_open_interest(spark, sf_dir):
    oi, _, ticker, mark = _feeds(spark, sf_dir)
    instruments = view(spark, sf_dir, "instruments").filter("state = 'live'")
    return D.enrich_open_interest(oi, instruments, mark.filter("mark_px < 1200"), ticker)


STEP_MS = 60 * DAY_MS

@query(
    "swap_context_asof",
    with_views(FEEDS, f"""WITH o1 AS (SELECT inst_id, ts, max((arrival, oi, oi_ccy)) AS p FROM open_interest GROUP BY ALL),
      f1 AS (SELECT inst_id, ts, max((arrival, funding_rate, next_funding_rate, funding_time, next_funding_time, method, sett_state, sett_funding_rate)) AS p FROM funding GROUP BY ALL),
      t1 AS (SELECT inst_id, ts, max((arrival, last, ask_px, bid_px, ask_sz, bid_sz, low24h, high24h, open24h, sod_utc0, sod_utc8, vol24h)) AS p FROM ticker GROUP BY ALL),
      b AS (SELECT inst_id, min(ts) AS lo FROM (SELECT inst_id, ts FROM open_interest UNION ALL SELECT inst_id, ts FROM ticker) GROUP BY inst_id),
      e AS (SELECT max(ts) AS hi FROM open_interest),
      ticks AS (SELECT inst_id, unnest(range(CAST(ceil(lo / {STEP_MS}.0E0) AS BIGINT) * {STEP_MS}, 999300000000 + 1, {STEP_MS})) AS tick_ms FROM b),
      a AS (SELECT inst_id, tick_ms, arg_max(o1.p, o1.ts) AS o FROM ticks JOIN o1 USING (inst_id) WHERE o1.ts <= tick_ms GROUP BY ALL),
      ots AS (SELECT inst_id, tick_ms, max(o1.ts) AS ots FROM ticks JOIN o1 USING (inst_id) WHERE o1.ts <= tick_ms GROUP BY ALL),
      c AS (SELECT inst_id, tick_ms, arg_max(f1.p, f1.ts) AS f, max(f1.ts) AS fts FROM ticks JOIN f1 USING (inst_id) WHERE f1.ts <= tick_ms GROUP BY ALL),
      d AS (SELECT inst_id, tick_ms, arg_max(t1.p, t1.ts) AS t FROM ticks JOIN t1 USING (inst_id) WHERE t1.ts <= tick_ms GROUP BY ALL),
      ctx AS (SELECT inst_id, tick_ms, o[2] AS oi, o[3] AS oi_ccy, ots, f[2] AS funding_rate, f[3] AS next_funding_rate, f[5] AS next_funding_time,
               f[6] AS method, f[7] AS sett_state, f[8] AS sett_funding_rate, fts, t[2] AS last, t[3] AS ask_px, t[4] AS bid_px, t[5] AS ask_sz,
               t[6] AS bid_sz, t[7] AS low24h, t[8] AS high24h, t[9] AS open24h, t[10] AS sod_utc0, t[11] AS sod_utc8, t[12] AS vol24h, mark_px
              FROM a JOIN ots USING (inst_id, tick_ms) JOIN c USING (inst_id, tick_ms) JOIN d USING (inst_id, tick_ms) JOIN mark_price m USING (inst_id))
      {swap_row_sql('ctx', 'tick_ms,')}"""),
    SWAP_DOUBLES, digits=6,
)
def swap_context_asof(spark, sf_dir):
    """Swap rows every 60 days up to a fixed end, from each instrument's first record."""
    oi, funding, ticker, mark = _feeds(spark, sf_dir)
    clock = D.clock_ticks([oi, ticker], STEP_MS, 999_300_000_000)
    return D.swap_row(D.swap_context_asof(clock, oi, funding, ticker, mark, chunk_ms=365 * DAY_MS, step_ms=STEP_MS), ["tick_ms"])


@query("spread_and_price", with_views("ticker", """SELECT arrival, (ask_px / bid_px - 1) * 100 AS spread_percent,
       CASE WHEN (ask_px / bid_px - 1) * 100 < 0.05E0 THEN (ask_px + bid_px) * 0.5E0 ELSE last END AS price FROM ticker"""), "spread_percent price")
def spread_and_price(spark, sf_dir):
    t = F.struct("ask_px", "bid_px", "last")
    return view(spark, sf_dir, "ticker").select(
        "arrival", D.spread_pct(F.col("ask_px"), F.col("bid_px")).alias("spread_percent"), D.ref_price(t, 0.05).alias("price")
    )


@query("next_funding", with_views("funding", """SELECT arrival, CASE WHEN next_funding_rate <> 0 AND method <> 'current_period' THEN next_funding_rate
        WHEN sett_state = 'processing' AND sett_funding_rate <> 0 THEN sett_funding_rate ELSE funding_rate END AS rate FROM funding"""), "rate", digits=8)
def next_funding(spark, sf_dir):
    f = view(spark, sf_dir, "funding")
    return f.select("arrival", D.next_funding(F.struct(*f.columns)).alias("rate"))


# --- options --------------------------------------------------------------------

_CHAIN = """chain AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY inst_id ORDER BY seq DESC) AS rn FROM option_chain) WHERE rn = 1),
  opt AS (SELECT inst_id, oi, vol24h, seq, regexp_extract(inst_id, '^([\\w-]+)-[0-9]{6}-[0-9]+-[PC]$', 1) AS underlying,
     CAST(regexp_extract(inst_id, '-([0-9]{2})[0-9]{4}-', 1) AS INTEGER) AS yy, CAST(regexp_extract(inst_id, '-[0-9]{2}([0-9]{2})[0-9]{2}-', 1) AS INTEGER) AS mm,
     CAST(regexp_extract(inst_id, '-[0-9]{4}([0-9]{2})-', 1) AS INTEGER) AS dd, CAST(regexp_extract(inst_id, '-([0-9]+)-[PC]$', 1) AS DOUBLE) AS strike,
     right(inst_id, 1) AS side FROM chain)"""
AS_OF = "2024-06-15"


def _ranked_sql(prefer: bool, k: int = 32) -> str:
    volume = "CASE WHEN oi <> 0 THEN floor(log10(greatest(vol24h, 1))) END DESC NULLS LAST"
    score = f"""CASE WHEN oi <> 0 THEN oi / (log2(greatest(date_diff('day', DATE '{AS_OF}', make_date(2000 + yy, mm, dd)), 1)) + 0.001E0) END DESC NULLS LAST"""
    keys = f"{volume}, {score}" if prefer else f"{score}, {volume}"
    return f"""{_CHAIN}, ranked AS (SELECT *, row_number() OVER (PARTITION BY underlying ORDER BY (oi <> 0) DESC, {keys},
       strike DESC, yy DESC, mm DESC, dd DESC, side DESC) AS rank FROM opt WHERE seq % 10 <> 3), picked AS (SELECT * FROM ranked WHERE rank <= {k})"""


def _options(spark, sf_dir):
    """Option feeds from the chain: one row per id."""
    chain = L.latest_by(view(spark, sf_dir, "option_chain"), ["inst_id"], "seq")
    i = F.col("seq").cast("bigint")
    oi = chain.select("inst_id", "oi", (i * 1000).alias("ts"))
    price = F.col("oi") / 100 + 1
    ticker = chain.filter("seq % 10 <> 3").select(
        "inst_id", price.alias("last"), (price * 1.001).alias("ask_px"), price.alias("bid_px"), (price * 0.8).alias("low24h"),
        (price * 1.5).alias("high24h"), (price * 0.97).alias("open24h"), (price * 0.99).alias("sod_utc0"), (price * 1.01).alias("sod_utc8"),
        "vol24h", (i * 1000 + 7).alias("ts"),
    )
    d = lambda x: F.try_divide(F.lit(float(x)), F.col("vol24h"))
    summary = chain.filter("seq % 7 <> 2").select(
        "inst_id", *(d(n + 1).alias(c) for n, c in enumerate(GREEKS)), (F.col("vol24h") * 2).alias("fwd_px"), (i * 1000 + i % 9).alias("ts")
    )
    instruments = chain.select("inst_id", (i * 1003).alias("exp_time"))
    return oi, ticker, summary, instruments


GREEKS = "delta gamma vega theta delta_bs gamma_bs vega_bs theta_bs lever mark_vol bid_vol ask_vol".split()


@query("pick_options", with_views("option_chain", f"WITH {_ranked_sql(False)} SELECT underlying, inst_id, CAST(rank AS INTEGER) AS rank, oi FROM picked"), "oi")
def pick_options(spark, sf_dir):
    oi, ticker, _, _ = _options(spark, sf_dir)
    return D.pick_options(oi, ticker, AS_OF).select("underlying", "inst_id", "rank", "oi.oi")


@query("pick_options_by_volume", with_views("option_chain", f"WITH {_ranked_sql(True, 50)} SELECT underlying, inst_id, CAST(rank AS INTEGER) AS rank, oi FROM picked"), "oi")
def pick_options_by_volume(spark, sf_dir):
    oi, ticker, _, _ = _options(spark, sf_dir)
    return D.pick_options(oi, ticker, AS_OF, k=50, prefer_volume=True).select("underlying", "inst_id", "rank", "oi.oi")


_OPT_PRICE = "(CASE WHEN (a / last - 1) * 100 < 0.1E0 THEN (a + last) * 0.5E0 ELSE last END)"


def _option_row_sql(source: str) -> str:
    change = lambda f: f"({_OPT_PRICE} / (last * {f}E0) - 1) * 100"
    greeks = ", ".join(f"{n + 1} / vol24h AS {g}" for n, g in enumerate(GREEKS))
    return f"""SELECT inst_id, underlying, greatest(ts1, ts2) AS timestamp_ms, CAST(greatest(seq * 1003 - greatest(ts1, ts2), 0) AS DOUBLE) AS expiry_in_ms,
      {greeks}, vol24h * 2 AS forward_price, oi AS open_interest, (a / last - 1) * 100 AS spread_percent,
      CASE WHEN strike > 0 THEN (vol24h * 2 / strike - 1) * 100 ELSE 0.0E0 END AS spread_to_mark_percent, {change(0.97)} AS change_24h_percent,
      {change(0.99)} AS change_today_percent, {change(1.01)} AS change_today_china_percent, vol24h AS volume_24h,
      ({_OPT_PRICE} - last * 0.8E0) / (last * 1.5E0 - last * 0.8E0) AS price_ratio_24h, {_OPT_PRICE} AS last_price, strike AS price
      FROM (SELECT *, oi / 100 + 1 AS last, (oi / 100 + 1) * 1.001E0 AS a, seq * 1000 + 7 AS ts1, seq * 1000 + seq % 9 AS ts2 FROM {source} WHERE seq % 7 <> 2)"""


OPTION_DOUBLES = f"""expiry_in_ms {' '.join(GREEKS)} forward_price open_interest spread_percent spread_to_mark_percent change_24h_percent
change_today_percent change_today_china_percent volume_24h price_ratio_24h last_price price"""


@query("option_context", with_views("option_chain", f"WITH {_CHAIN} SELECT inst_id, underlying, strike, oi, oi / 100 + 1 AS last, vol24h * 2 AS fwd_px,"
       " seq * 1003 AS exp_time FROM opt WHERE seq % 10 <> 3 AND seq % 7 <> 2"), "strike oi last fwd_px")
def option_context(spark, sf_dir):
    c = D.option_context(*_options(spark, sf_dir))
    return c.select("inst_id", "underlying", "option.strike", "oi.oi", "ticker.last", "summary.fwd_px", "instrument.exp_time")


@query("option_row", with_views("option_chain", f"WITH {_CHAIN} {_option_row_sql('(SELECT * FROM opt WHERE seq % 10 <> 3)')}"), OPTION_DOUBLES)
def option_row(spark, sf_dir):
    return D.option_row(D.option_context(*_options(spark, sf_dir)))


@query("picked_option_rows", with_views("option_chain", f"WITH {_ranked_sql(False)} {_option_row_sql('picked')}"), OPTION_DOUBLES)
def picked_option_rows(spark, sf_dir):
    oi, ticker, summary, instruments = _options(spark, sf_dir)
    picked = D.pick_options(oi, ticker, AS_OF)
    return D.option_row(D.option_context(oi, ticker, summary, instruments, picked))


@query("option_book_hash", with_views("option_chain", f"WITH {_CHAIN} SELECT underlying, bool_or(CAST(strike AS BIGINT) % 97 = 0 AND oi IS NOT NULL) AS changed FROM opt"
       " WHERE seq % 10 <> 3 AND seq % 7 <> 2 GROUP BY underlying"))
def option_book_hash(spark, sf_dir):
    """Whether an underlying's digest changes when the open interest of some strikes does, and when its rows come in another order."""
    context = D.option_context(*_options(spark, sf_dir))
    more = F.when(F.col("option.strike").cast("bigint") % 97 == 0, F.col("oi.oi") + 1).otherwise(F.col("oi.oi"))
    after = context.withColumn("oi", F.col("oi").withField("oi", more)).repartition(5, "inst_id")
    now = D.option_book_hash(after).withColumnRenamed("book_hash", "after")
    return D.option_book_hash(context).join(now, "underlying").select("underlying", (F.col("book_hash") != F.col("after")).alias("changed"))


# --- sentiment ------------------------------------------------------------------

_COIN = "CASE l_returnflag WHEN 'A' THEN 'BTC' WHEN 'N' THEN 'ETH' ELSE 'DOGE' END"
_SENTIMENT = f"""s AS (SELECT {_COIN} AS coin, (epoch_us(l_shipdate) // 1000) + l_linenumber AS ts, l_orderkey * 10 + l_linenumber AS arrival,
   l_quantity, l_extendedprice, l_discount, l_tax, l_linenumber FROM lineitem)"""


def _sentiment_sql(name: str, condition: str) -> str:
    return f"{name} AS (SELECT coin, max(ts) AS ts, max_by(l_quantity, (ts, arrival)) AS q, max_by(l_extendedprice, (ts, arrival)) AS p, max_by(l_tax, (ts, arrival)) AS t FROM s WHERE {condition} GROUP BY coin)"


def _sentiment_feeds(spark, sf_dir):
    line = _table(spark, sf_dir, "lineitem").selectExpr(
        f"{_COIN} AS coin", "unix_millis(CAST(l_shipdate AS TIMESTAMP)) + l_linenumber AS ts", "l_orderkey * 10 + l_linenumber AS arrival",
        "l_quantity", "l_extendedprice", "l_tax", "l_linenumber",
    )
    pair = ["coin", "ts", "arrival", F.col("l_quantity").alias("sell_volume"), F.col("l_extendedprice").alias("buy_volume")]
    ratio = ["coin", "ts", "arrival", F.col("l_tax").alias("ratio")]
    return (
        line.filter("l_linenumber <= 2").select(*pair),
        line.filter("l_linenumber = 3").select(*pair),
        line.filter("l_linenumber = 4").select(*ratio),
        line.filter("l_linenumber = 5").select(*ratio),
        line.filter("l_linenumber >= 6").select("coin", "ts", "arrival", F.col("l_quantity").alias("open_interest"), F.col("l_extendedprice").alias("volume")),
        line.select("coin"),
    )


@query(
    "sentiment_row",
    f"""WITH {_SENTIMENT}, {_sentiment_sql('c', 'l_linenumber <= 2')}, {_sentiment_sql('sp', 'l_linenumber = 3')}, {_sentiment_sql('m', 'l_linenumber = 4')},
        {_sentiment_sql('r', 'l_linenumber = 5')}, {_sentiment_sql('o', 'l_linenumber >= 6')}
        SELECT coin, greatest(c.ts, sp.ts, m.ts, r.ts, o.ts) AS timestamp_ms, sp.q AS sell_taker_volume_spot, sp.p AS buy_taker_volume_spot,
          c.q AS sell_taker_volume_contracts, c.p AS buy_taker_volume_contracts, m.t AS margin_lending_ratio, r.t AS long_short_ratio,
          o.q AS open_interest, o.p AS volume
        FROM c JOIN sp USING (coin) JOIN m USING (coin) JOIN r USING (coin) JOIN o USING (coin) WHERE coin IN ('BTC', 'ETH', 'XRP', 'LTC')""",
    "sell_taker_volume_spot buy_taker_volume_spot sell_taker_volume_contracts buy_taker_volume_contracts margin_lending_ratio long_short_ratio open_interest volume",
)
def sentiment_row(spark, sf_dir):
    return D.sentiment_row(D.sentiment_context(*_sentiment_feeds(spark, sf_dir)))


# --- ordered change detection, top-k, dedupe -------------------------------------


@query(
    "drop_unchanged",
    with_views("trades_big", """SELECT id, market, time_ms, volume FROM (SELECT *, lag(volume) OVER w AS before, lag(id) OVER w AS earlier FROM trades_big
       WINDOW w AS (PARTITION BY market ORDER BY time_ms, id)) WHERE earlier IS NULL OR volume IS DISTINCT FROM before"""),
    "volume",
)
def drop_unchanged(spark, sf_dir):
    trades = view(spark, sf_dir, "trades_big").select("id", "market", "time_ms", "volume")
    return L.drop_unchanged(trades, ["market"], ["volume"], ["time_ms", "id"], chunk_ms=200 * DAY_MS)


@query("top_k_per_group", with_views("trades_big", """SELECT market, id, volume, price FROM (SELECT *, row_number() OVER
       (PARTITION BY market ORDER BY volume DESC, price DESC, id) AS rn FROM trades_big) WHERE rn <= 10"""), "volume price")
def top_k_per_group(spark, sf_dir):
    order = [F.col("volume").desc(), F.col("price").desc(), F.col("id")]
    return L.top_k_per_group(view(spark, sf_dir, "trades_big").select("market", "id", "volume", "price"), ["market"], order, 10)


@query("latest_n", with_views("trades_big", "SELECT id, time_ms FROM trades_big ORDER BY time_ms DESC, id DESC LIMIT 64"))
def latest_n(spark, sf_dir):
    return L.latest_n(view(spark, sf_dir, "trades_big").select("id", "time_ms"), 64, tie=["id"])


@query("ordered_trades", with_views("trades", "SELECT time_ms, id, market, price FROM trades ORDER BY time_ms, id"), "price")
def ordered_trades(spark, sf_dir):
    return L.ordered(view(spark, sf_dir, "trades").select("time_ms", "id", "market", "price"), "time_ms", "id")


@query("new_rows", with_views("trades", "SELECT market, id, time_ms, price FROM trades WHERE id % 3 <> 0"), "price")
def new_rows(spark, sf_dir):
    trades = view(spark, sf_dir, "trades")
    batch = trades.unionByName(trades)
    # stored long before: an id is known whatever its time
    stored = trades.filter("id % 3 = 0").withColumn("time_ms", F.col("time_ms") - 900 * DAY_MS)
    return L.new_rows(batch, stored).select("market", "id", "time_ms", "price")


@query("merge_pages", with_views("trades", "SELECT market, id, time_ms, price FROM trades"), "price")
def merge_pages(spark, sf_dir):
    trades = view(spark, sf_dir, "trades")
    newer, older = trades.filter("time_ms > 1705000000000"), trades.filter("time_ms < 1705100000000")
    return L.merge_pages(newer, older).select("market", "id", "time_ms", "price")


@query(
    "sequence_gaps",
    """WITH u AS (SELECT o_orderstatus AS symbol, o_orderkey * 2 AS first_id, o_orderkey * 2 + CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE 1 END AS final_id,
         CASE WHEN o_custkey % 5 = 0 THEN o_orderkey * 2 - 1 WHEN o_custkey % 7 = 0 THEN o_orderkey * 2 - 3 END AS prev_id, epoch_us(o_orderdate) // 1000 AS event_ms FROM orders),
       l AS (SELECT *, max(greatest(final_id, first_id)) OVER (PARTITION BY symbol ORDER BY final_id, first_id, event_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_id FROM u)
       SELECT symbol, first_id, final_id, prev_id, event_ms, last_id, last_id IS NULL OR (prev_id IS NULL AND first_id - last_id > 1)
         OR coalesce(prev_id <> last_id, FALSE) AS resync FROM l""",
)
def sequence_gaps(spark, sf_dir):
    return L.sequence_gaps(_updates(spark, sf_dir), chunk_ids=5000)


def _updates(spark, sf_dir):
    return _table(spark, sf_dir, "orders").selectExpr(
        "o_orderstatus AS symbol", "o_orderkey * 2 AS first_id", "o_orderkey * 2 + CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE 1 END AS final_id",
        "CASE WHEN o_custkey % 5 = 0 THEN o_orderkey * 2 - 1 WHEN o_custkey % 7 = 0 THEN o_orderkey * 2 - 3 END AS prev_id",
        "unix_millis(CAST(o_orderdate AS TIMESTAMP)) AS event_ms",
    )


@query(
    "sequence_gaps_resets",
    """WITH u AS (SELECT o_orderstatus AS symbol, o_orderkey * 2 AS first_id, o_orderkey * 2 + CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE 1 END AS final_id,
         CASE WHEN o_custkey % 5 = 0 THEN o_orderkey * 2 - 1 WHEN o_custkey % 7 = 0 THEN o_orderkey * 2 - 3 END AS prev_id, epoch_us(o_orderdate) // 1000 AS event_ms FROM orders),
       e AS (SELECT *, 1 AS kind, greatest(final_id, first_id) AS v FROM u UNION ALL
         SELECT o_orderstatus, 0, o_orderkey * 2, NULL, 0, 0, CASE WHEN o_custkey % 2 = 0 THEN o_orderkey * 2 - 1 END FROM orders WHERE o_orderpriority = '1-URGENT'),
       b AS (SELECT *, sum(1 - kind) OVER (PARTITION BY symbol ORDER BY final_id, kind, first_id, event_ms ROWS UNBOUNDED PRECEDING) AS book FROM e),
       l AS (SELECT *, max(v) OVER (PARTITION BY symbol, book ORDER BY final_id, kind, first_id, event_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_id FROM b)
       SELECT symbol, first_id, final_id, prev_id, event_ms, last_id, last_id IS NULL OR (prev_id IS NULL AND first_id - last_id > 1)
         OR coalesce(prev_id <> last_id, FALSE) AS resync FROM l WHERE kind = 1""",
)
def sequence_gaps_resets(spark, sf_dir):
    """Snapshots and dropped books among the updates."""
    last = "CASE WHEN o_custkey % 2 = 0 THEN o_orderkey * 2 - 1 END AS last_id"
    resets = _table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").selectExpr("o_orderstatus AS symbol", "o_orderkey * 2 AS at_id", last)
    return L.sequence_gaps(_updates(spark, sf_dir), 5000, resets)
