"""Streaming and sink queries: run over the whole tables, results read back from the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tickloom.operators import bars as B
from tickloom.plans.bars import DOUBLES, bars_ctes
from tickloom.plans.books import BOOK_SQL, _books
from tickloom.plans.ingest import _CANDLES, _candle_times
from tickloom.plans.registry import ORACLES, query
from tickloom.plans.views import _MS, VIEWS, view, with_views
from tickloom.session import prepare, shared_dir
from tickloom.sinks import tables as T
from tickloom.streaming import streams as Z

HOUR_MS, DAY_MS = 3_600_000, 86_400_000


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/tickloom-run-{uuid.uuid4().hex}"


def _stream(spark, sf_dir: str, name: str):
    """A view as a stream of its table's files."""
    table, _ = VIEWS[name]
    prepare(spark)
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    # a stream source wants a folder or a pattern, also where the table is a single file
    source = spark.readStream.schema(schema).parquet(f"{sf_dir}/{table}.parque[t]")
    return source.selectExpr(
        *(f"{_MS.sub(r'unix_millis(CAST(\1 AS TIMESTAMP))', e)} AS `{a}`" for a, e in VIEWS[name][1].items())
    )


def _in_batches(spark, sf_dir: str, name: str, number: str, copies: str = "FALSE", count: int = 4):
    """A view as a stream of several triggers: ``number`` says which takes a row, rows of ``copies`` come again in the next."""
    folder = _folder(spark)
    rows = view(spark, sf_dir, name)
    low, high = (rows.agg(F.min("time_ms"), F.max("time_ms")).first() if "time_ms" in rows.columns else (0, 0))
    rows = rows.withColumn("_b", F.expr(number.format(low=low, span=high - low + 1, count=count)).cast("int"))
    rows = rows.unionByName(rows.filter(copies).withColumn("_b", F.col("_b") + 1))
    parts = [rows.filter(F.col("_b") == k).drop("_b") for k in range(count + 1)]
    return _fed(spark, folder, parts)


def _fed(spark, folder: str, parts: list):
    """A stream of files, and what feeds it: one call for the files of each trigger, as many as its tasks write."""
    feed = [lambda part=part: part.write.mode("append").parquet(f"{folder}/in") for part in parts]
    parts[0].limit(0).write.parquet(f"{folder}/in")  # a stream wants its folder to be there
    return spark.readStream.schema(parts[0].schema).parquet(f"{folder}/in"), feed


def _run(stream, feed: list, writer, checkpoint: str, mode: str = "append") -> None:
    """Feed a stream and run it, trigger by trigger, from one checkpoint."""
    for write in feed:
        write()
        Z.run_available(stream, writer, checkpoint, mode)


#: Quarters of the time span; late: some rows come a quarter later.
_QUARTER = "(time_ms - {low}) * {count} div {span}"
_LATE = f"least({_QUARTER} + IF(id % 11 = 0, 1, 0), {{count}} - 1)"


def _written(spark, stream, feed: list, mode: str = "append"):
    """All output of a stream, run to its end."""
    folder = _folder(spark)
    _run(stream, feed, lambda batch, i: batch.write.mode("append").parquet(f"{folder}/out"), f"{folder}/state", mode)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


_SIMPLE = "open high low close volume buy_ratio buy_volume_ratio liquidation_volume_ratio"


@query(
    "stream_bars",
    with_views("trades", f"WITH {bars_ctes('trades', [4 * HOUR_MS], [HOUR_MS]).strip()} SELECT market, period_ms, offset_ms, time_ms,"
               f" {_SIMPLE.replace(' ', ', ')}, num_trades, trade_id FROM bars WHERE time_ms + period_ms <= (SELECT max(time_ms) FROM trades) - 3600000"),
    _SIMPLE,
)
def stream_bars(spark, sf_dir):
    """Four triggers in the order of time: bars whose trades come in two of them are put together in state."""
    trades, feed = _in_batches(spark, sf_dir, "trades", _QUARTER)
    return _written(spark, Z.stream_bars(trades, 4 * HOUR_MS, HOUR_MS, "1 hour"), feed)


@query("stream_dedupe", with_views("trades", "SELECT market, id, time_ms, price FROM trades"), "price")
def stream_dedupe(spark, sf_dir):
    """Late trades, and copies that come a trigger after their trade."""
    rows, feed = _in_batches(spark, sf_dir, "trades", _LATE, "id % 3 = 0")
    return _written(spark, Z.stream_dedupe(rows.select("market", "id", "time_ms", "price"), "4000 days"), feed)


@query("latest_state", with_views("ticker", "SELECT inst_id, max(ts) AS ts, max_by(last, (ts, arrival, last, vol24h)) AS last FROM ticker GROUP BY inst_id"), "last")
def latest_state(spark, sf_dir):
    """Records out of order over four triggers; what the last report of each key says is the state."""
    records, feed = _in_batches(spark, sf_dir, "ticker", "(arrival * 7) % {count}", "arrival % 5 = 0")
    folder = _folder(spark)
    report = lambda batch, i: batch.withColumn("trigger", F.lit(i)).write.mode("append").parquet(f"{folder}/out")
    _run(Z.latest_state(records.select("inst_id", "last", "vol24h", "ts", "arrival")), feed, report, f"{folder}/state", "update")
    reports = spark.read.parquet(f"{folder}/out")
    last = reports.groupBy("inst_id").agg(F.max("trigger").alias("trigger"))
    return reports.join(last, ["inst_id", "trigger"]).select("inst_id", "ts", "last")


_PERIODS, _OFFSETS = [4 * HOUR_MS, DAY_MS], [0, 0]


@query("stream_bars_refreshed", with_views("trades", f"WITH {bars_ctes('trades', _PERIODS, _OFFSETS).strip()} SELECT * FROM bars"), DOUBLES)
def stream_bars_refreshed(spark, sf_dir):
    """All columns, kept current by recomputing stale bars after every trigger; trades come late and some twice."""
    folder = _folder(spark)
    refresher = Z.bar_refresher(f"{folder}/trades", f"{folder}/bars", _PERIODS, _OFFSETS)
    _run(*_in_batches(spark, sf_dir, "trades", _LATE, "id % 13 = 0"), refresher, f"{folder}/state")
    return T.read_bars(spark, f"{folder}/bars")


_EXACT = [c for c in B.BAR_COLUMNS if c not in B.BAR_QUANTILES]


@query("stream_bars_segments", with_views("trades", f"WITH {bars_ctes('trades', _PERIODS, _OFFSETS).strip()} SELECT market, period_ms, offset_ms, {', '.join(_EXACT)} FROM bars"), " ".join(c for c in _EXACT if c in DOUBLES.split()))
def stream_bars_segments(spark, sf_dir):
    """The columns that segments give exactly, kept current by renewing stale segments; trades come late and some twice."""
    from tickloom.operators.segments import segment_refresher

    folder = _folder(spark)
    refresher = segment_refresher(f"{folder}/trades", f"{folder}/segments", f"{folder}/bars", _PERIODS, _OFFSETS)
    _run(*_in_batches(spark, sf_dir, "trades", _LATE, "id % 13 = 0"), refresher, f"{folder}/state")
    return T.read_bars(spark, f"{folder}/bars").select("market", "period_ms", "offset_ms", *_EXACT)


@query(
    "refresh_stale_bars",
    with_views("trades", f"""WITH {bars_ctes('trades', _PERIODS, _OFFSETS).strip()},
      old AS (SELECT market, period_ms, time_ms - time_ms % period_ms AS b, arg_max(id, (time_ms, id)) AS last_id FROM trades,
        (VALUES ({_PERIODS[0]}), ({_PERIODS[1]})) p(period_ms) WHERE id % 7 <> 0 GROUP BY ALL),
      st AS (SELECT bars.market, bars.period_ms, min(time_ms) AS stale FROM bars LEFT JOIN old ON bars.market = old.market AND bars.period_ms = old.period_ms
        AND time_ms = b WHERE last_id IS NULL OR last_id <> trade_id GROUP BY ALL)
      SELECT bars.* FROM bars JOIN st ON bars.market = st.market AND bars.period_ms = st.period_ms WHERE time_ms >= stale"""),
    DOUBLES,
)
def refresh_stale_bars(spark, sf_dir):
    trades = view(spark, sf_dir, "trades")
    stored = B.trade_bars(trades.filter("id % 7 <> 0"), _PERIODS, _OFFSETS)
    return B.refresh_stale_bars(stored, trades, _PERIODS, _OFFSETS)


_RESUME = "s AS (SELECT l_partkey AS symbol, max(epoch_us(l_shipdate) // 1000) AS hi FROM lineitem GROUP BY ALL)"


@query("resume_point", f"""WITH {_RESUME} SELECT p_partkey AS symbol, CASE WHEN hi + 700000000000 >= 1577836800000 THEN hi + 700000000000 ELSE 1577836739999 END AS resume_ms
       FROM part LEFT JOIN s ON p_partkey = symbol""")
def resume_point(spark, sf_dir):
    stored = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_partkey").alias("symbol"), (F.unix_millis(F.col("l_shipdate").cast("timestamp")) + 700_000_000_000).alias("time_ms")
    )
    known = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("symbol"))
    return Z.resume_point(stored, ["symbol"], known=known)


@query("kline_increment", f"""WITH {_CANDLES}, n AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS c, row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC, span DESC) AS r,
       first(span) OVER (PARTITION BY symbol ORDER BY open_time, span) AS fs, min(open_time) OVER (PARTITION BY symbol) AS fo FROM k)
       SELECT symbol, open_time FROM n WHERE NOT (r = 1 AND CASE WHEN c = 1 THEN span < 59999 ELSE open_time = fo OR fs > span END) AND open_time + span > 880000000000""")
def kline_increment(spark, sf_dir):
    candles = _candle_times(spark, sf_dir)
    resume = candles.select("symbol").distinct().withColumn("resume_ms", F.lit(880_000_000_000))
    return Z.kline_increment(candles, resume).select("symbol", "open_time")


# --- sinks ------------------------------------------------------------------------


@query("append_trades", with_views("trades", "SELECT market, id, time_ms, price FROM trades"), "price")
def append_trades(spark, sf_dir):
    """A third stored first, then everything twice."""
    path, trades = f"{_folder(spark)}/trades", view(spark, sf_dir, "trades")
    T.append_trades(trades.filter("id % 3 = 0"), path)
    T.append_trades(trades.unionByName(trades), path)
    return spark.read.parquet(path).select("market", "id", "time_ms", "price")


@query("export_csv", with_views("trades", "SELECT id, time_ms, market, price FROM trades WHERE market = 'click'"), "price")
def export_csv(spark, sf_dir):
    path = f"{_folder(spark)}/csv"
    T.export_csv(view(spark, sf_dir, "trades"), path, "click")
    return spark.read.schema("id bigint, time_ms bigint, market string, price double, volume double, flag smallint").option("header", True).csv(path).select(
        "id", "time_ms", "market", "price"
    )


@query("export_csv_all", with_views("trades", "SELECT id, time_ms, market, price, volume, flag FROM trades"), "price volume")
def export_csv_all(spark, sf_dir):
    """All columns of all markets."""
    path = f"{_folder(spark)}/csv"
    T.export_csv(view(spark, sf_dir, "trades"), path)
    schema = "id bigint, time_ms bigint, market string, price double, volume double, flag smallint"
    return spark.read.schema(schema).option("header", True).csv(path)


_EXPORTED = "market time_ms open high low close volume num_trades"


@query(
    "export_csv_newest",
    with_views("trades", f"WITH {bars_ctes('trades', [HOUR_MS], [0]).strip()} SELECT {_EXPORTED.replace(' ', ', ')} FROM bars ORDER BY time_ms DESC, market LIMIT 100"),
    "open high low close volume",
)
def export_csv_newest(spark, sf_dir):
    """The newest hundred bars."""
    path = f"{_folder(spark)}/csv"
    bars = B.simple_bars(view(spark, sf_dir, "trades"), [HOUR_MS]).withColumnRenamed("bucket_ms", "time_ms").select(*_EXPORTED.split())
    T.export_csv(bars, path, limit=100, kind="bars")
    return spark.read.schema("market string, time_ms bigint, open double, high double, low double, close double, volume double, num_trades bigint").option("header", True).csv(path)


@query(
    "write_series_rows",
    with_views("trades", "SELECT market || '/usd' AS symbol, strftime(make_timestamp(time_ms * 1000), '%Y-%m-%d') AS date, time_ms, price, volume FROM trades"),
    "price volume",
)
def write_series_rows(spark, sf_dir):
    """Every value of the written series."""
    path = f"{_folder(spark)}/series"
    trades = view(spark, sf_dir, "trades").select(F.concat("market", F.lit("/usd")).alias("symbol"), "time_ms", "price", "volume")
    T.write_series(trades, path, "venue", "trades")
    return spark.read.parquet(path).select("symbol", F.col("date").cast("string").alias("date"), "time_ms", "price", "volume")


@query(
    "write_series",
    with_views("trades", """SELECT market || '/usd' AS symbol, strftime(make_timestamp(time_ms * 1000), '%Y-%m-%d') AS date, 1::BIGINT AS folders, count(*) AS n, sum(price) AS s
       FROM trades GROUP BY ALL"""),
    "s",
)
def write_series(spark, sf_dir):
    """Trades as one series per market and day; the names are not file-safe as they stand."""
    path = f"{_folder(spark)}/series"
    trades = view(spark, sf_dir, "trades").select(F.concat("market", F.lit("/usd")).alias("symbol"), "time_ms", "price", "volume")
    T.write_series(trades, path, "venue", "trades")
    written = spark.read.parquet(path).groupBy("symbol", F.col("date").cast("string").alias("date"))
    return written.agg(F.countDistinct("series").alias("folders"), F.count(F.lit(1)).alias("n"), F.sum("price").alias("s"))


@query("write_rolling", with_views("trades", "SELECT strftime(make_timestamp(time_ms * 1000), '%Y_%m_%d') AS slot, count(*) AS n, sum(price) AS s FROM trades GROUP BY ALL"), "s")
def write_rolling(spark, sf_dir):
    path = f"{_folder(spark)}/rolling"
    T.write_rolling(view(spark, sf_dir, "trades"), path, "day")
    return spark.read.parquet(path).groupBy("slot").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("s"))


@query("write_rolling_hour", with_views("trades", "SELECT strftime(make_timestamp(time_ms * 1000), '%Y_%m_%d_%H') AS slot, market, id, time_ms, price, volume, flag FROM trades"), "price volume")
def write_rolling_hour(spark, sf_dir):
    """The default grain, every column."""
    path = f"{_folder(spark)}/rolling"
    T.write_rolling(view(spark, sf_dir, "trades"), path)
    return spark.read.parquet(path).select("slot", "market", "id", "time_ms", "price", "volume", "flag")


@query("layout_time_hash", with_views("trades_big", "SELECT chunk_id, market, count(*) AS n FROM (SELECT *, time_ms // (30 * 86400000::BIGINT) AS chunk_id FROM trades_big) GROUP BY ALL"))
def layout_time_hash(spark, sf_dir):
    path = f"{_folder(spark)}/layout"
    T.write_time_hash(view(spark, sf_dir, "trades_big"), path)
    return spark.read.parquet(path).groupBy(F.col("chunk_id").cast("bigint").alias("chunk_id"), "market").agg(F.count(F.lit(1)).alias("n"))


def bucketed_tables(spark, sf_dir):
    """Names of a table of trades and of one of their daily bars, both in buckets of market and time chunk."""
    folder, name = _folder(spark), uuid.uuid4().hex
    trades = view(spark, sf_dir, "trades_big")
    bars = B.simple_bars(trades, [DAY_MS]).withColumnRenamed("bucket_ms", "time_ms").select("market", "time_ms", "high", "low", "num_trades")
    T.write_bucketed(trades, f"trades_{name}", f"{folder}/trades")
    T.write_bucketed(bars, f"bars_{name}", f"{folder}/bars")
    return f"trades_{name}", f"bars_{name}"


def position_in_bars(spark, trades: str, bars: str):
    """For each bar the trades in its upper half: a join and an aggregate of two bucketed tables where they lie."""
    day = F.col("time_ms") - F.pmod(F.col("time_ms"), F.lit(DAY_MS))
    own = spark.table(trades).select("market_hash", "chunk_id", day.alias("day_ms"), "price")
    keys = ["market_hash", "chunk_id", "day_ms"]
    joined = own.join(spark.table(bars).withColumnRenamed("time_ms", "day_ms"), keys)
    upper = F.count_if(2 * F.col("price") >= F.col("high") + F.col("low"))
    return joined.groupBy(*keys, "market").agg(F.count(F.lit(1)).alias("n"), upper.alias("upper"))


@query(
    "layout_bucketed",
    with_views("trades_big", f"""WITH t AS (SELECT market, price, time_ms - time_ms % {DAY_MS} AS day_ms, time_ms FROM trades_big WHERE price > 0 AND volume > 0),
      b AS (SELECT market, day_ms, max(price) AS high, min(price) AS low FROM t GROUP BY ALL)
      SELECT market, day_ms, count(*) AS n, count(*) FILTER (2 * price >= high + low) AS upper FROM t JOIN b USING (market, day_ms) GROUP BY ALL"""),
)
def layout_bucketed(spark, sf_dir):
    return position_in_bars(spark, *bucketed_tables(spark, sf_dir)).select("market", "day_ms", "n", "upper")


@query("write_futures_stats", """SELECT l_orderkey * 10 + l_linenumber AS time_ms, row_number() OVER (ORDER BY l_extendedprice, l_partkey, l_orderkey * 10 + l_linenumber) AS id FROM lineitem""")
def write_futures_stats(spark, sf_dir):
    path = f"{_folder(spark)}/stats"
    stats = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(
        "l_partkey AS market_hash", "l_orderkey * 10 + l_linenumber AS time_ms", "l_quantity AS open_interest",
        "l_extendedprice AS open_interest_usd", "l_tax AS next_funding_rate", "l_discount AS spread", "l_extendedprice AS mark",
    )
    T.write_futures_stats(stats, path)
    return spark.read.parquet(path).select("time_ms", "id")


@query(
    "book_state",
    with_views("depth_updates", """SELECT symbol, side, price, qty, change_count, qty_var FROM (SELECT symbol, side, price, max_by(qty, (final_id, event_ms, qty)) AS qty,
      count(*) AS change_count, var_pop(qty) AS qty_var FROM depth_updates GROUP BY ALL) WHERE qty > 0"""),
    "price qty qty_var",
)
def book_state(spark, sf_dir):
    """Books from the whole stream of updates, in state that never expires."""
    from tickloom.streaming import book_state as S

    messages = S.update_messages(_stream(spark, sf_dir, "depth_updates"))
    return _emitted(spark, messages, [lambda: None], expiry_ms=0).select("symbol", "side", "price", "qty", "change_count", "qty_var")


def _emitted(spark, messages, feed: list, **choices):
    """All books that a stream of messages emits, with the number of the emission."""
    from tickloom.streaming import book_state as S

    folder = _folder(spark)
    emit = lambda books, i: books.write.mode("overwrite").parquet(f"{folder}/out/emission={i}")
    _run(messages, feed, S.book_keeper(folder, emit, **choices), f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out")


_BATCHES, _EXPIRY = 4, 120 * 86_400_000
_REPLAY = f"""msgs0 AS MATERIALIZED (SELECT symbol, side, price, qty, final_id AS id, event_ms, 2 AS rank,
     CAST((event_ms - lo) * {_BATCHES} // (hi - lo + 1) AS INTEGER) AS b FROM depth_updates, (SELECT min(event_ms) AS lo, max(event_ms) AS hi FROM depth_updates)),
   head AS (SELECT symbol, (min(id) + max(id)) // 2 AS id, max(event_ms) AS event_ms FROM msgs0 WHERE b = 2 GROUP BY symbol),
   snap AS (SELECT symbol, side, price, max(qty) + 1 AS qty FROM msgs0 WHERE b = 2 AND id % 5 = 0 GROUP BY ALL),
   clears AS MATERIALIZED (SELECT symbol, side, id, max(price) AS top FROM snap JOIN head USING (symbol) GROUP BY ALL),
   msgs AS MATERIALIZED (SELECT * FROM msgs0 UNION ALL SELECT symbol, side, price, qty, id, event_ms, 1, 2 FROM snap JOIN head USING (symbol)),
   s0 AS (SELECT symbol, side, price, qty, id AS last_id, event_ms AS last_ms FROM msgs WHERE FALSE)"""


def _replay_step(k: int) -> str:
    """One trigger: the state before is ``s<k>``, what it emits is ``t<k + 1>``. There is one snapshot of a symbol and side, in the third."""
    kept = lambda x, newer: f"""FROM {x} LEFT JOIN (SELECT symbol, side, id AS clear_id, top FROM clears WHERE {k} = 2) c USING (symbol, side)
        WHERE (clear_id IS NULL OR (side <> 'bid' AND price > top) OR {newer})"""  # noqa: E731
    return f"""o{k} AS MATERIALIZED (SELECT symbol, side, price, qty, last_id, last_ms {kept(f's{k}', 'last_id > clear_id')}),
      m{k} AS MATERIALIZED (SELECT symbol, side, price, qty, id, event_ms, rank {kept('msgs', 'id >= clear_id')} AND b = {k}),
      j{k} AS MATERIALIZED (SELECT m.*, o.last_id AS old, row_number() OVER (PARTITION BY m.symbol, m.side, m.price ORDER BY m.id, m.rank, m.event_ms, m.qty) AS rn
        FROM m{k} m LEFT JOIN o{k} o ON m.symbol = o.symbol AND m.side = o.side AND m.price = o.price WHERE o.last_id IS NULL OR m.id >= o.last_id),
      u{k} AS (SELECT *, rn = 1 AND old IS NOT NULL AND rank = 2 AND qty <= 0 AND id <> coalesce(old, id) AS gone FROM j{k}),
      a{k} AS MATERIALIZED (SELECT symbol, side, price, bool_or(gone) AS gone, count(*) FILTER (NOT gone) AS n, arg_max(qty, rn) FILTER (NOT gone) AS qty, arg_max(id, rn) FILTER (NOT gone) AS last_id,
        arg_max(event_ms, rn) FILTER (NOT gone) AS last_ms, var_pop(qty) FILTER (NOT gone) AS v FROM u{k} GROUP BY ALL),
      t{k + 1} AS MATERIALIZED (SELECT {k} AS emission, symbol, side, price, coalesce(n, 0) AS n, v, CASE WHEN n > 0 THEN a.qty ELSE o.qty END AS qty, CASE WHEN n > 0 THEN a.last_id ELSE o.last_id END AS last_id,
        CASE WHEN n > 0 THEN a.last_ms ELSE o.last_ms END AS last_ms FROM a{k} a FULL JOIN o{k} o USING (symbol, side, price) WHERE n > 0 OR (o.last_id IS NOT NULL AND NOT coalesce(gone, FALSE))),
      s{k + 1} AS MATERIALIZED (SELECT symbol, side, price, qty, last_id, last_ms FROM t{k + 1}, (SELECT max(event_ms) AS newest FROM msgs WHERE b <= {k}) WHERE last_ms >= newest - {_EXPIRY})"""


_EMITTED_SQL = " UNION ALL ".join(f"SELECT emission, symbol, side, price, qty, last_id, n AS change_count, v AS qty_var FROM t{k + 1} SEMI JOIN s{k + 1} USING (symbol, side, price) WHERE qty > 0" for k in range(_BATCHES))


@query("book_state_batches", with_views("depth_updates", f"WITH {_REPLAY}, {', '.join(map(_replay_step, range(_BATCHES)))} {_EMITTED_SQL}"), "price qty qty_var")
def book_state_batches(spark, sf_dir):
    """Whole books after each of four triggers, with removals, expiry and, in the third, a snapshot of every symbol.

    The bids are cleared whole, the asks up to the snapshot's highest.
    """
    books = _emitted(spark, *_batches_of_messages(spark, sf_dir), expiry_ms=_EXPIRY)
    return books.select("emission", "symbol", "side", "price", "qty", "last_id", "change_count", "qty_var")


def _batches_of_messages(spark, sf_dir):
    """Updates in four triggers, in the third of which every symbol has a snapshot."""
    from tickloom.streaming import book_state as S

    folder = _folder(spark)
    updates = view(spark, sf_dir, "depth_updates")
    low, high = updates.agg(F.min("event_ms"), F.max("event_ms")).first()
    updates = updates.withColumn("b", F.floor((F.col("event_ms") - low) * _BATCHES / (high - low + 1)))
    third = updates.filter("b = 2")
    head = third.groupBy("symbol").agg(F.expr("(min(final_id) + max(final_id)) div 2").alias("last_id"), F.max("event_ms").alias("time_ms"))
    levels = third.filter("final_id % 5 = 0").groupBy("symbol", "side", "price").agg((F.max("qty") + 1).alias("qty"))
    side = lambda s: F.collect_list(F.when(F.col("side") == s, F.struct("price", "qty"))).alias(f"{s}s")
    snapshots = head.join(levels.groupBy("symbol").agg(side("bid"), side("ask")), "symbol")
    bids = S.snapshot_messages(snapshots, True).filter("side = 'bid'")
    asks = S.snapshot_messages(snapshots, False).filter("side = 'ask'")
    parts = [S.update_messages(updates.filter(F.col("b") == k)) for k in range(_BATCHES)]
    parts[2] = parts[2].unionByName(bids).unionByName(asks)
    return _fed(spark, folder, parts)


@query("book_state_keyed", ORACLES["book_state_batches"], "")
def book_state_keyed(spark, sf_dir):
    """The same books from keyed state: changes of each trigger, timers for what expires."""
    from tickloom.streaming import keyed_books as K

    folder = _folder(spark)
    messages, feed = _batches_of_messages(spark, sf_dir)
    changes = K.book_changes(messages, expiry_ms=_EXPIRY)
    for step, write in enumerate(feed):  # a trigger and, where levels expire, the one without messages that follows it
        keep = lambda batch, i, step=step: batch.withColumn("step", F.lit(step)).write.mode("overwrite").parquet(f"{folder}/changes/{step}-{i}")
        _run(changes, [write], keep, f"{folder}/state", "update")
    books = K.books_after(spark.read.schema(f"{K.CHANGES}, step int").parquet(f"{folder}/changes/*"), len(feed) - 1)
    return books.select(F.col("step").cast("int").alias("emission"), "symbol", "side", "price", "qty", "last_id", "change_count", "qty_var")


_TICK = 60 * DAY_MS
_REPLAYED = f"""msgs0 AS (SELECT symbol, side, price, qty, event_ms * 1000 + final_id % 1000 AS id, event_ms, final_id, event_ms // {_TICK} AS b FROM depth_updates),
   head AS (SELECT symbol, b, (min(id) + max(id)) // 2 AS c, min(event_ms) AS event_ms FROM msgs0 WHERE b % 5 = 2 GROUP BY ALL),
   snap AS (SELECT symbol, side, b, price, max(qty) + 1 AS qty FROM msgs0 WHERE b % 5 = 2 AND final_id % 4 = 0 GROUP BY ALL),
   clears AS (SELECT symbol, side, b, c, max(price) AS top FROM snap JOIN head USING (symbol, b) GROUP BY ALL),
   msgs AS (SELECT symbol, side, price, qty, id, event_ms, b, 2 AS rank FROM msgs0 UNION ALL SELECT symbol, side, price, qty, c, event_ms, b, 1 FROM snap JOIN head USING (symbol, b)),
   kept AS (SELECT m.* FROM msgs m LEFT JOIN clears USING (symbol, side, b) WHERE c IS NULL OR (side = 'ask' AND price > top) OR id >= c),
   lives AS (SELECT *, lead(b) OVER (PARTITION BY symbol, side, price ORDER BY b) AS following FROM (SELECT symbol, side, price, b, max_by(qty, (id, rank, event_ms, qty)) AS qty, max(id) AS last_id FROM kept GROUP BY ALL)),
   cut AS (SELECT l.symbol, l.side, l.price, l.b, min(clears.b) AS cleared FROM lives l JOIN clears ON l.symbol = clears.symbol AND l.side = clears.side AND clears.b > l.b AND (l.side = 'bid' OR l.price <= top) GROUP BY ALL),
   ends AS (SELECT symbol, max(b) AS last FROM msgs0 GROUP BY ALL)"""


@query(
    "book_replay",
    with_views("depth_updates", f"""WITH {_REPLAYED} SELECT symbol, (t + 1) * {_TICK} AS tick_ms, side, price, qty, last_id
      FROM (SELECT *, unnest(range(b, least(coalesce(following - 1, last), coalesce(cleared - 1, last), last) + 1)) AS t FROM lives JOIN ends USING (symbol) LEFT JOIN cut USING (symbol, side, price, b) WHERE qty > 0)"""),
    "price qty",
)
def book_replay(spark, sf_dir):
    """All books every sixty days from stored updates and, at every fifth, a snapshot of each symbol.

    The bids are cleared whole, the asks up to the snapshot's highest.
    """
    from tickloom.functions.scalars import price_key
    from tickloom.operators.replay import replayed_books
    from tickloom.streaming.book_state import MESSAGE_COLUMNS, update_messages

    tick = F.floor(F.col("event_ms") / _TICK)
    raw = view(spark, sf_dir, "depth_updates").withColumns({"id": F.expr("event_ms * 1000 + final_id % 1000"), "b": tick})
    shot = raw.filter("b % 5 = 2")
    head = shot.groupBy("symbol", "b").agg(F.expr("(min(id) + max(id)) div 2").alias("id"), F.min("event_ms").alias("event_ms"))
    levels = shot.filter("final_id % 4 = 0").groupBy("symbol", "side", "b", "price").agg((F.max("qty") + 1).alias("qty"))
    none, inf = F.lit(None).cast("double"), F.lit(float("inf"))
    rows = levels.join(head, ["symbol", "b"]).withColumns({"kind": F.lit("level"), "level_key": price_key("price"), "low_key": none, "high_key": none})
    edges = levels.groupBy("symbol", "side", "b").agg(F.max("price").alias("top")).join(head, ["symbol", "b"])
    high = F.when(F.col("side") == "bid", inf).otherwise(price_key("top"))
    edges = edges.withColumns({"kind": F.lit("clear"), "level_key": none, "price": none, "qty": none, "low_key": -inf, "high_key": high})
    updates = update_messages(raw.drop("final_id").withColumnRenamed("id", "final_id"))
    messages = updates.unionByName(rows.select(MESSAGE_COLUMNS)).unionByName(edges.select(MESSAGE_COLUMNS))
    return replayed_books(messages, _TICK).select("symbol", "tick_ms", "side", "price", "qty", "last_id")


@query("fan_out", with_views("trades", "SELECT market, count(*) AS n FROM trades GROUP BY market"))
def fan_out(spark, sf_dir):
    """Two handlers, of which one fails on every batch."""
    folder = _folder(spark)

    def broken(batch, batch_id):
        raise RuntimeError("this handler always fails")

    def counts(batch, batch_id):
        batch.groupBy("market").agg(F.count(F.lit(1)).alias("n")).write.mode("append").parquet(f"{folder}/out")

    Z.run_available(_stream(spark, sf_dir, "trades"), Z.fan_out({"broken": broken, "counts": counts}, []), f"{folder}/state")
    return spark.read.parquet(f"{folder}/out").groupBy("market").agg(F.sum("n").alias("n"))


@query("fan_out_catches_up", with_views("trades", "SELECT handler, market, count(*) AS n FROM trades, (VALUES ('steady'), ('failing')) h(handler) GROUP BY ALL"))
def fan_out_catches_up(spark, sf_dir):
    """Four triggers, two handlers; one fails twice and then gets what it missed, each batch once."""
    folder = _folder(spark)
    trades, feed = _in_batches(spark, sf_dir, "trades", _QUARTER)
    calls = []

    def counts(name):
        def handler(batch, i):
            calls.append(name)
            if name == "failing" and calls.count(name) <= 2:
                raise RuntimeError("this handler fails twice")
            counted = batch.groupBy("market").agg(F.count(F.lit(1)).alias("n")).withColumn("handler", F.lit(name))
            counted.write.mode("overwrite").parquet(f"{folder}/out/{name}/batch={i}")

        return handler

    _run(trades, feed, Z.catching_up({n: counts(n) for n in ("steady", "failing")}, f"{folder}/ledger"), f"{folder}/state")
    out = spark.read.parquet(f"{folder}/out/steady").unionByName(spark.read.parquet(f"{folder}/out/failing"))
    return out.groupBy("handler", "market").agg(F.sum("n").alias("n"))


@query(
    "write_book_nested",
    f"WITH {BOOK_SQL} SELECT book, CAST(len(bids) AS INTEGER) AS bids, CAST(len(asks) AS INTEGER) AS asks, coalesce(asks[1].price, 0) AS first_ask FROM ob",
    "first_ask",
)
def write_book_nested(spark, sf_dir):
    path = f"{_folder(spark)}/nested"
    T.write_book_nested(_books(spark, sf_dir), path, "gzip")
    first = F.coalesce(F.get("asks", F.lit(0))["price"], F.lit(0.0)).alias("first_ask")
    return spark.read.parquet(path).select("book", F.size("bids").alias("bids"), F.size("asks").alias("asks"), first)


def _mirrored(spark, sf_dir):
    """Books whose asks are the bids, 1000 higher; every level counts one."""
    side = lambda up: F.transform("bids", lambda x: F.struct((x["price"] + up).alias("price"), F.lit(1).alias("count"), x["size"].alias("size")))
    return _books(spark, sf_dir).select("book", "market", "time_ms", side(0).alias("bids"), side(1000).alias("asks"))


def _wide_sql(n: int, count: bool) -> tuple[str, str]:
    """Query of all level columns of the mirrored books of one depth, and its double columns."""
    fields = lambda s, up, i: [f"bids[{i}].price + {up} AS {s}_price_{i}", *([f"1 AS {s}_count_{i}"] if count else []), f"bids[{i}].size AS {s}_size_{i}"]
    columns = [x for s, up in (("bid", 0), ("ask", 1000)) for i in range(1, n + 1) for x in fields(s, up, i)]
    doubles = [x.split(" AS ")[1] for x in columns if not x.startswith("1 AS")]
    return f"WITH {BOOK_SQL} SELECT book, {', '.join(columns)} FROM ob WHERE len(bids) = {n}", " ".join(doubles)


@query("write_book_wide", *_wide_sql(25, False))
def write_book_wide(spark, sf_dir):
    """All columns of the books of 25 levels."""
    path = f"{_folder(spark)}/wide"
    T.write_book_wide(_mirrored(spark, sf_dir), path, 25)
    return spark.read.parquet(path).drop("market_hash", "time_ms")


@query("write_book_wide_50", *_wide_sql(50, True))
def write_book_wide_50(spark, sf_dir):
    """All columns of the books of 50 levels, with counts."""
    path = f"{_folder(spark)}/wide"
    T.write_book_wide(_mirrored(spark, sf_dir), path, 50, with_count=True)
    return spark.read.parquet(path).drop("market_hash", "time_ms")


@query("write_book_wide_rejects", f"WITH {BOOK_SQL} SELECT book, CAST(len(bids) AS INTEGER) AS depth FROM ob WHERE len(bids) <> 25")
def write_book_wide_rejects(spark, sf_dir):
    """Books of another depth come back instead of being cut or filled up."""
    return T.write_book_wide(_mirrored(spark, sf_dir), f"{_folder(spark)}/wide", 25).select("book", F.size("asks").alias("depth"))


@query(
    "write_book_nested_levels",
    f"""WITH {BOOK_SQL} SELECT book, side, level, x.price AS price, x.size AS size FROM (
      SELECT book, 'bid' AS side, CAST(unnest(range(len(bids))) AS INTEGER) AS level, unnest(bids) AS x FROM ob
      UNION ALL SELECT book, 'ask' AS side, CAST(unnest(range(len(asks))) AS INTEGER) AS level, unnest(asks) AS x FROM ob)""",
    "price size",
)
def write_book_nested_levels(spark, sf_dir):
    """Every level of both sides, read back."""
    path = f"{_folder(spark)}/nested"
    T.write_book_nested(_books(spark, sf_dir), path)
    stored = spark.read.parquet(path)
    side = lambda s: stored.select("book", F.lit(s).alias("side"), F.posexplode(f"{s}s").alias("level", "x"))
    return side("bid").unionByName(side("ask")).select("book", "side", "level", "x.price", "x.size")


@query("write_book_table", *_wide_sql(25, True))
def write_book_table(spark, sf_dir):
    """All columns of the table of books of exactly 25 levels a side, read back."""
    folder = _folder(spark)
    table = f"books_{uuid.uuid4().hex}"
    T.write_book_table(_mirrored(spark, sf_dir), table, f"{folder}/table")
    return spark.table(table).drop("market", "time_ms")
