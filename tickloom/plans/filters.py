"""Queries on filters, names, checks and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import scalars as S
from tickloom.operators import filters as C
from tickloom.plans.registry import query
from tickloom.plans.views import view, with_views
from tickloom.session import prepare


def _table(spark, sf_dir, name):
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


FILTER = "# markets to keep\nA/F; n/o\n^R.*f$\n// no more"


@query(
    "pair_filter",
    with_views("trades_big", """SELECT id, market FROM trades_big
        WHERE lower(market) IN ('a/f', 'n/o', '^r.*f$') OR regexp_matches(market, '^R.*f$', 'i')"""),
)
def pair_filter(spark, sf_dir):
    return view(spark, sf_dir, "trades_big").filter(C.pair_filter(FILTER)).select("id", "market")


@query("valid_trades", with_views("trades", "SELECT id, price, volume FROM (SELECT id, price - 20 AS price, volume - 5 AS volume"
                                  " FROM trades) WHERE price > 0 AND volume > 0"), "price volume")
def valid_trades(spark, sf_dir):
    shifted = view(spark, sf_dir, "trades").select("id", (F.col("price") - 20).alias("price"), (F.col("volume") - 5).alias("volume"))
    return C.valid_trades(shifted)


@query(
    "check_trades",
    with_views("trades", """SELECT id, concat_ws(',', CASE WHEN NOT time_ms > 0 THEN 'time_positive' END,
        CASE WHEN NOT (price > 0 AND isfinite(price)) THEN 'price_positive' END,
        CASE WHEN NOT (volume >= 0 AND isfinite(volume)) THEN 'volume_positive' END,
        CASE WHEN NOT (flag >= 0 AND flag < 8) THEN 'valid_flag' END) AS failed
        FROM (SELECT id, CASE WHEN id % 9 = 0 THEN 0 ELSE time_ms END AS time_ms,
              CASE WHEN id % 7 = 0 THEN CAST('inf' AS DOUBLE) ELSE price - 1 END AS price, volume - 3 AS volume, flag + 1 AS flag FROM trades)"""),
)
def check_trades(spark, sf_dir):
    spoiled = view(spark, sf_dir, "trades").select(
        "id",
        F.when(F.col("id") % 9 == 0, 0).otherwise(F.col("time_ms")).alias("time_ms"),
        F.when(F.col("id") % 7 == 0, float("inf")).otherwise(F.col("price") - 1).alias("price"),
        (F.col("volume") - 3).alias("volume"),
        (F.col("flag") + 1).alias("flag"),
    )
    return C.check_trades(spoiled).select("id", F.array_join("failed", ",").alias("failed"))


@query(
    "check_futures_stats",
    """SELECT l_orderkey, l_linenumber, concat_ws(',',
         CASE WHEN NOT l_partkey - 5 > 0 THEN 'market_positive' END,
         CASE WHEN NOT l_suppkey - 2 > 0 THEN 'time_positive' END,
         CASE WHEN NOT l_quantity - 3 >= 0 THEN 'open_interest_positive' END,
         CASE WHEN l_linenumber = 3 THEN 'next_funding_rate_finite' END,
         CASE WHEN l_linenumber = 5 THEN 'spread_finite' END,
         CASE WHEN NOT l_discount - 0.01 >= 0 THEN 'mark_positive' END) AS failed FROM lineitem""",
)
def check_futures_stats(spark, sf_dir):
    n = F.col("l_linenumber")
    stats = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        (F.col("l_partkey") - 5).alias("market_hash"), (F.col("l_suppkey") - 2).alias("time_ms"),
        (F.col("l_quantity") - 3).alias("open_interest"), F.col("l_extendedprice").alias("open_interest_usd"),
        F.when(n == 3, float("nan")).otherwise(F.col("l_tax")).alias("next_funding_rate"),
        F.when(n == 5, float("-inf")).otherwise(F.col("l_tax")).alias("spread"),
        (F.col("l_discount") - 0.01).alias("mark"),
    )
    return C.check_futures_stats(stats).select("l_orderkey", "l_linenumber", F.array_join("failed", ",").alias("failed"))


@query("live_instruments", with_views("instruments", "SELECT inst_id, ct_val FROM instruments WHERE state = 'live'"), "ct_val")
def live_instruments(spark, sf_dir):
    return C.live_instruments(view(spark, sf_dir, "instruments")).select("inst_id", "ct_val")


@query("trading_symbols", """SELECT concat('S', CAST(o_orderkey AS VARCHAR)) AS symbol FROM orders WHERE o_orderstatus = 'F'""")
def trading_symbols(spark, sf_dir):
    symbols = _table(spark, sf_dir, "orders").select(
        F.concat(F.lit("S"), F.col("o_orderkey").cast("string")).alias("symbol"),
        F.when(F.col("o_orderstatus") == "F", "TRADING").otherwise("BREAK").alias("status"),
    )
    return C.live_instruments(symbols, "TRADING", "status").select("symbol")


@query(
    "tradable_markets",
    """WITH m AS (SELECT concat('M', CAST(l_partkey AS VARCHAR), '/USD') AS name, l_linenumber < 6 AS enabled,
          l_returnflag = 'R' AS post_only, l_extendedprice AS ask, l_extendedprice - 2000 AS bid FROM lineitem)
       SELECT name, min(struct_pack(enabled := enabled, post_only := post_only, ask := ask, bid := bid)).ask AS ask
       FROM m WHERE enabled AND NOT post_only AND ask > 0 AND bid > 0 AND regexp_matches(name, 'M.*[05]/USD$', 'i') GROUP BY name""",
    "ask",
)
def tradable_markets(spark, sf_dir):
    markets = _table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("M"), F.col("l_partkey").cast("string"), F.lit("/USD")).alias("name"),
        (F.col("l_linenumber") < 6).alias("enabled"), (F.col("l_returnflag") == "R").alias("post_only"),
        F.col("l_extendedprice").alias("ask"), (F.col("l_extendedprice") - 2000).alias("bid"),
    )
    return C.tradable_markets(markets, "M.*[05]/USD$").select("name", "ask")


@query("nan_to_num", """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber IN (2, 4, 6) THEN 0.0 ELSE l_discount END AS v,
       least(greatest(l_tax * 20, 0), 1) AS ratio FROM lineitem""", "v ratio")
def nan_to_num(spark, sf_dir):
    n = F.col("l_linenumber")
    odd = F.when(n == 2, float("nan")).when(n == 4, float("inf")).when(n == 6, None).otherwise(F.col("l_discount"))
    return _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", S.nan_to_num(odd).alias("v"), S.clamp(F.col("l_tax") * 20, 0.0, 1.0).alias("ratio")
    )


@query("restrict_to", with_views("trades_big", "SELECT id, market FROM trades_big WHERE market IN (SELECT concat(l_returnflag, '/F')"
                                 " FROM lineitem WHERE l_returnflag <> 'N')"))
def restrict_to(spark, sf_dir):
    wanted = _table(spark, sf_dir, "lineitem").filter("l_returnflag <> 'N'").select(F.concat("l_returnflag", F.lit("/F")).alias("market"))
    return C.restrict_to(view(spark, sf_dir, "trades_big"), wanted, "market").select("id", "market")


@query("missing_symbols", "SELECT DISTINCT p_partkey AS symbol FROM part WHERE p_partkey NOT IN"
                          " (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def missing_symbols(spark, sf_dir):
    received = _table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("symbol"))
    return C.missing_symbols(_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("symbol")), received)


@query("all_instruments", "SELECT l_partkey AS inst_id FROM lineitem UNION SELECT p_partkey FROM part UNION SELECT l_suppkey + 1000000 FROM lineitem")
def all_instruments(spark, sf_dir):
    line = _table(spark, sf_dir, "lineitem")
    return C.all_instruments(
        line.select(F.col("l_partkey").alias("inst_id")),
        _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("inst_id")),
        line.select((F.col("l_suppkey") + 1000000).alias("inst_id")),
    )


_SETS = "oi AS (SELECT l_partkey AS inst_id FROM lineitem WHERE l_quantity > 20), fr AS (SELECT l_partkey AS inst_id FROM lineitem WHERE l_tax > 0.04)"


def _key_sets(spark, sf_dir):
    line = _table(spark, sf_dir, "lineitem").withColumn("inst_id", F.col("l_partkey"))
    return line.filter("l_quantity > 20"), line.filter("l_tax > 0.04")


@query("common_keys", f"WITH {_SETS} SELECT inst_id FROM oi INTERSECT SELECT inst_id FROM fr INTERSECT SELECT p_partkey FROM part WHERE p_size < 30")
def common_keys(spark, sf_dir):
    part = _table(spark, sf_dir, "part").filter("p_size < 30").withColumn("inst_id", F.col("p_partkey"))
    return C.common_keys(*_key_sets(spark, sf_dir), part)


@query("except_keys", f"WITH {_SETS} SELECT p_partkey AS inst_id FROM part EXCEPT SELECT inst_id FROM fr")
def except_keys(spark, sf_dir):
    part = _table(spark, sf_dir, "part").withColumn("inst_id", F.col("p_partkey"))
    return C.except_keys(part, _key_sets(spark, sf_dir)[1])


@query(
    "trade_sides",
    with_views("trades", """SELECT id, flag & 1 <> 0 AS is_buy, flag & 2 <> 0 AS is_sell, flag & 4 <> 0 AS is_liquidation,
        CASE WHEN flag & 1 <> 0 THEN 'buy' WHEN flag & 2 <> 0 THEN 'sell' ELSE 'none' END AS side
        FROM (SELECT id, CAST(CASE WHEN id % 13 = 0 THEN 4 WHEN id % 17 = 0 THEN 3 ELSE flag END AS INTEGER) AS flag FROM trades)"""),
)
def trade_sides(spark, sf_dir):
    i = F.col("id")
    flag = F.when(i % 13 == 0, 4).when(i % 17 == 0, 3).otherwise(F.col("flag").cast("int"))
    return view(spark, sf_dir, "trades").select("id", flag.alias("flag")).select(
        "id", S.is_buy("flag").alias("is_buy"), S.is_sell("flag").alias("is_sell"),
        S.is_liquidation("flag").alias("is_liquidation"), S.side_of("flag").alias("side"),
    )


_HASH_WORDS = " ".join(
    f", CAST(concat('0x', substr(d, {1 + 16 * i}, 8)) AS BIGINT) AS h{i}, CAST(concat('0x', substr(d, {9 + 16 * i}, 8)) AS BIGINT) AS l{i}"
    for i in range(4)
)
_HASH = """((xor(xor(xor(xor(h0, h1), h2), h3), 4294967295) & 2147483647) * 4294967296
           + xor(xor(xor(xor(l0, l1), l2), l3), 4294967237))"""


@query("pair_hash", f"SELECT inst_id, CAST({_HASH} AS BIGINT) AS h FROM (SELECT inst_id {_HASH_WORDS} FROM (SELECT inst_id, sha256(inst_id) AS d"
                    " FROM (SELECT DISTINCT concat('P', CAST(l_partkey AS VARCHAR), '/', l_returnflag) AS inst_id FROM lineitem)))")
def pair_hash(spark, sf_dir):
    names = _table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("P"), F.col("l_partkey").cast("string"), F.lit("/"), "l_returnflag").alias("inst_id")
    ).distinct()
    return names.select("inst_id", S.pair_hash("inst_id").alias("h"))


@query("sanitize_pair", f"""SELECT p_partkey, CASE WHEN regexp_matches(trim(p_name), '[^A-Za-z0-9_-]')
         THEN concat(regexp_replace(trim(p_name), '[^A-Za-z0-9_-]', 'X', 'g'), printf('%08x', CAST({_HASH} AS BIGINT)))
         ELSE trim(p_name) END AS safe
       FROM (SELECT p_partkey, p_name {_HASH_WORDS} FROM (SELECT *, sha256(p_name) AS d FROM part))""")
def sanitize_pair(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", S.sanitize_pair("p_name").alias("safe"))


@query("escape_market", """SELECT p_partkey, lower(translate(p_name, '/- .', '____')) AS escaped,
       regexp_matches(lower(translate(p_name, '/- .', '____')), '^[A-Za-z][A-Za-z0-9_]{0,127}$') AS valid,
       regexp_matches(p_name, '^[A-Za-z][A-Za-z0-9_]{0,127}$') AS raw_valid FROM part""")
def escape_market(spark, sf_dir):
    return _table(spark, sf_dir, "part").select(
        "p_partkey", S.escape_market("p_name").alias("escaped"), S.is_valid_name(S.escape_market("p_name")).alias("valid"),
        S.is_valid_name("p_name").alias("raw_valid"),
    )


@query("standardize_name", """SELECT doc_id, md5(translate(strip_accents(text), './ :@$\\"', '________')) AS name FROM documents""")
def standardize_name(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(S.standardize_name("text")).alias("name"))


_OPTION_PARTS = """regexp_extract(inst_id, '^([\\w-]+)-([0-9]{6})-([0-9.]+)-([PC])$', %d)"""


@query(
    "parse_option_id",
    with_views("option_chain", f"""SELECT seq, {_OPTION_PARTS % 1} AS underlying,
        CAST(concat('20', substr({_OPTION_PARTS % 2}, 1, 2), '-', substr({_OPTION_PARTS % 2}, 3, 2), '-', substr({_OPTION_PARTS % 2}, 5, 2)) AS DATE) AS expiry,
        CAST({_OPTION_PARTS % 3} AS DOUBLE) AS strike, {_OPTION_PARTS % 4} AS side, inst_id AS formatted FROM option_chain"""),
    "strike",
)
def parse_option_id(spark, sf_dir):
    parsed = view(spark, sf_dir, "option_chain").select("seq", S.parse_option_id("inst_id").alias("o"))
    return parsed.select(
        "seq", "o.underlying", "o.expiry", "o.strike", "o.side", S.format_option_id("o").alias("formatted")
    )


@query("safe_double", """SELECT event_id, coalesce(TRY_CAST(CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 5 = 0 THEN 'x1'
       ELSE CAST(value AS VARCHAR) END AS DOUBLE), -1.0) AS v,
       coalesce(TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT), 7) AS k FROM events""", "v")
def safe_double(spark, sf_dir):
    i = F.col("event_id")
    text = F.when(i % 3 == 0, "").when(i % 5 == 0, "x1").otherwise(F.col("value").cast("string"))
    return _table(spark, sf_dir, "events").select(
        "event_id", S.safe_double(text, -1.0).alias("v"), S.safe_long(F.regexp_extract("props", "([0-9]+)", 1), 7).alias("k")
    )


_DIGITS = "greatest(ceil(-log10(2 * inc)), 0)"


@query("round_to_tick", f"""SELECT l_orderkey, l_linenumber, sign(x) * floor(abs(x) * pow(10, {_DIGITS}) + 0.5) / pow(10, {_DIGITS}) AS ticked
       FROM (SELECT *, ceil(l_extendedprice / inc) * inc AS x FROM (SELECT *, CASE l_linenumber WHEN 1 THEN 0.25 WHEN 2 THEN 0.03
             WHEN 3 THEN 5 ELSE l_quantity / 7 END AS inc FROM lineitem))""", "ticked", digits=3)
def round_to_tick(spark, sf_dir):
    n = F.col("l_linenumber")
    inc = F.when(n == 1, 0.25).when(n == 2, 0.03).when(n == 3, 5.0).otherwise(F.col("l_quantity") / 7)
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.round_to_tick("l_extendedprice", inc).alias("ticked"))


@query("book_grouping", with_views("ticker", f"""SELECT arrival, greatest(floor(x * pow(10, {_DIGITS}) + 0.5) / pow(10, {_DIGITS}), inc) AS grouping_step
       FROM (SELECT *, ceil((bid_px + ask_px) * 0.5 * 0.0005 / inc) * inc AS x FROM (SELECT *, 0.05E0 * (1 + arrival % 3) AS inc FROM ticker))"""),
       "grouping_step", digits=3)
def book_grouping(spark, sf_dir):
    inc = 0.05 * (1 + F.col("arrival") % 3)
    return view(spark, sf_dir, "ticker").select("arrival", S.book_grouping("bid_px", "ask_px", inc).alias("grouping_step"))


@query("price_key", """SELECT l_orderkey, l_linenumber, floor(log2(l_extendedprice) * 1e8) / 1e8 AS k,
       pow(2, floor(log2(l_extendedprice) * 1e8) / 1e8) / l_extendedprice AS back FROM lineitem""", "k back")
def price_key(spark, sf_dir):
    key = S.price_key("l_extendedprice")
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", key.alias("k"), (S.price_of_key(key) / F.col("l_extendedprice")).alias("back"))


@query(
    "sql_functions",
    with_views("trades_big", """SELECT id, time_ms - (time_ms - 60000) % 300000 AS bucket_ms, CASE WHEN flag & 1 <> 0 THEN 'buy' ELSE 'sell' END AS side,
       lower(translate(market, '/', '_')) AS escaped, floor(log2(price) * 1e8) / 1e8 AS k FROM trades_big"""),
    "k",
)
def sql_functions(spark, sf_dir):
    """The registered SQL functions called from SQL."""
    from tickloom.functions.registry import register_functions

    trades = view(spark, sf_dir, "trades_big")
    register_functions(spark)
    return spark.sql(
        "SELECT id, tl_bucket_start(time_ms, 300000, 60000) AS bucket_ms, tl_trade_side(flag) AS side, tl_escape_market(market) AS escaped,"
        " tl_price_key(price) AS k FROM {trades}", trades=trades,
    )
