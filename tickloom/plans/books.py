"""Order book queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import scalars as S
from tickloom.operators import books as K
from tickloom.operators import filters as C
from tickloom.plans.registry import query
from tickloom.plans.views import view, with_views
from tickloom.session import prepare, scratch_table

DAY_MS = 86_400_000


def _table(spark, sf_dir, name):
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


# prices of the updates view are whole numbers, so the price stands for the level key
LEVELS = """levels AS (SELECT symbol, side, price, max_by(qty, (final_id, event_ms, qty)) AS qty, max(final_id) AS last_id,
   max_by(event_ms, (final_id, event_ms, qty)) AS last_ms, count(*) AS change_count, count(*) AS stat_count, var_pop(qty) AS qty_var,
   stddev_samp(qty) AS qty_std, avg(qty) AS qty_mean FROM depth_updates GROUP BY symbol, side, price),
   shown AS (SELECT *, CASE WHEN side = 'ask' THEN -price ELSE price END AS near FROM levels WHERE qty > 0 AND price > 0)"""

LEVEL_DOUBLES = "price qty qty_var qty_std qty_mean"


def _levels(spark, sf_dir):
    return K.level_stats(view(spark, sf_dir, "depth_updates"))


def _written_levels(spark, sf_dir):
    return scratch_table(_levels(spark, sf_dir))


@query("level_stats", with_views("depth_updates", f"WITH {LEVELS} SELECT symbol, side, price, qty, last_id, last_ms, change_count, qty_var, qty_std, qty_mean FROM levels"), LEVEL_DOUBLES)
def level_stats(spark, sf_dir):
    return _levels(spark, sf_dir).drop("level_key", "stat_count")


@query("book_extremes", with_views("depth_updates", f"""WITH {LEVELS} SELECT symbol, min(price) FILTER (side = 'bid') AS min_bid, max(price) FILTER (side = 'ask') AS max_ask,
   count(*) FILTER (side = 'bid') AS bid_count, count(*) FILTER (side = 'ask') AS ask_count FROM shown GROUP BY symbol"""), "min_bid max_ask")
def book_extremes(spark, sf_dir):
    return K.book_extremes(K.book_view(_levels(spark, sf_dir)))


def _union_sql(name: str, k: int, source: str, criteria: list[tuple[str, str]]) -> str:
    """CTEs ``<name>``: kept levels of a source by top-k criteria, drawn down to ``k``."""
    tops = " UNION ".join(
        f"SELECT symbol, side, price FROM (SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY {order}, near DESC) AS rn FROM {source} WHERE {cond}) WHERE rn <= {k}"
        for order, cond in criteria
    )
    return f"""{name}_u AS ({tops}),
      {name}_n AS (SELECT symbol, side, count(*) AS n FROM {name}_u GROUP BY ALL),
      {name}_b AS (SELECT symbol, side, arg_max(price, near) AS price FROM shown GROUP BY ALL),
      {name}_c AS (SELECT symbol, side, price, max(b) AS b, n FROM (SELECT *, 0 AS b FROM {name}_u UNION ALL SELECT *, 1 FROM {name}_b) JOIN {name}_n USING (symbol, side)
          WHERE n > {k} OR b = 0 GROUP BY ALL),
      {name} AS (SELECT symbol, side, price FROM (SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY CASE WHEN n > {k} THEN b ELSE 1 END DESC,
          md5(concat_ws('|', symbol, side, CAST(price AS VARCHAR)))) AS rn FROM {name}_c) WHERE rn <= {k})"""


DETAILED = [("change_count DESC, qty DESC", "TRUE"), ("qty DESC", "TRUE"), ("qty_var DESC, qty_mean DESC", "stat_count >= 3")]
SIMPLE = [("change_count DESC, qty DESC", "TRUE"), ("qty DESC", "TRUE")]


@query("select_levels_detailed", with_views("depth_updates", f"WITH {LEVELS}, {_union_sql('sel', 128, 'shown', DETAILED)} SELECT * FROM sel"), "price")
def select_levels_detailed(spark, sf_dir):
    return K.select_levels_detailed(_written_levels(spark, sf_dir))


@query("select_levels_simple", with_views("depth_updates", f"WITH {LEVELS}, {_union_sql('sel', 25, 'shown', SIMPLE)} SELECT * FROM sel"), "price")
def select_levels_simple(spark, sf_dir):
    return K.select_levels_simple(_written_levels(spark, sf_dir).withColumn("count", F.col("change_count")))


def _segments_sql(sel: str) -> str:
    return f"""marked AS (SELECT s.*, {sel}.price IS NOT NULL AS head, row_number() OVER (PARTITION BY s.symbol, s.side ORDER BY near DESC) AS pos
        FROM shown s LEFT JOIN {sel} USING (symbol, side, price)),
      seg AS (SELECT *, max(CASE WHEN head THEN pos END) OVER (PARTITION BY symbol, side ORDER BY pos) AS seg,
        CASE WHEN NOT head AND stat_count > 2 THEN 1 ELSE 0 END AS counted, count(*) OVER (PARTITION BY symbol, side) AS total FROM marked),
      heads AS (SELECT symbol, side, seg, coalesce(lead(pos) OVER (PARTITION BY symbol, side ORDER BY pos), total) - pos AS gap FROM seg WHERE head),
      mem AS (SELECT *, CASE WHEN side = 'ask' THEN coalesce(sum(counted) OVER (PARTITION BY symbol, side, seg ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
          ELSE coalesce(sum(counted) OVER (PARTITION BY symbol, side, seg ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) END AS later
        FROM seg JOIN heads USING (symbol, side, seg) WHERE seg IS NOT NULL),
      dev AS (SELECT *, max(CASE WHEN counted = 1 AND qty_var > 0 THEN later END) OVER (PARTITION BY symbol, side, seg) AS seeded, 2.0E0 / (gap + 1) AS alpha FROM mem),
      agg AS (SELECT symbol, side, seg, max(CASE WHEN head THEN price END) AS price, sum(qty) AS size, max(CASE WHEN head THEN qty END) AS raw_size,
        sum(price * qty) / sum(qty) AS mean_price, max(CASE WHEN head THEN change_count END) AS change_count, CAST(sum(change_count) AS BIGINT) AS total_change_count,
        sum(CASE WHEN counted = 1 THEN sqrt(qty_var) * CASE WHEN later = 0 THEN 1 ELSE pow(1 - alpha, later) END * CASE WHEN later = seeded THEN 1 ELSE alpha END ELSE 0 END) AS ema,
        max(CASE WHEN head AND stat_count >= 2 THEN qty_std END) AS own, count(*) AS aggregate_count FROM dev GROUP BY ALL),
      condensed AS (SELECT symbol, side, price, size, raw_size, mean_price, change_count, total_change_count,
        CASE WHEN ema > 0 THEN CASE WHEN own > 0 THEN 0.8E0 * own + 0.2E0 * ema ELSE ema END ELSE coalesce(own, 0.0) END AS size_std, aggregate_count FROM agg)"""


@query(
    "condense_detailed",
    with_views("depth_updates", f"WITH {LEVELS}, {_union_sql('sel', 128, 'shown', DETAILED)}, {_segments_sql('sel')} SELECT * FROM condensed"),
    "price size raw_size mean_price size_std",
)
def condense_detailed(spark, sf_dir):
    return K.condense_detailed(_written_levels(spark, sf_dir)).drop("segment")


@query(
    "condense_simple",
    with_views("depth_updates", f"WITH {LEVELS}, {_union_sql('sel', 25, 'shown', SIMPLE)}, {_segments_sql('sel')} SELECT symbol, side, mean_price AS price, size, total_change_count AS count FROM condensed"),
    "price size",
)
def condense_simple(spark, sf_dir):
    levels = _written_levels(spark, sf_dir).withColumn("count", F.col("change_count"))
    return K.condense_simple(levels).drop("segment")


@query(
    "condensed_book",
    with_views("depth_updates", f"""WITH {LEVELS}, {_union_sql('sel', 128, 'shown', DETAILED)}, {_segments_sql('sel')},
      numbered AS (SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY CASE WHEN side = 'ask' THEN price ELSE -price END) AS i, count(*) OVER (PARTITION BY symbol, side) AS n FROM condensed),
      grid AS (SELECT symbol, side, unnest(range(1, 129)) AS i, n, price AS p, mean_price AS mp FROM numbered WHERE i = n),
      padded AS (SELECT symbol, side, g.i, coalesce(c.price, g.mp) AS price, coalesce(c.size, 0) AS size, coalesce(c.mean_price, g.mp) AS mean_price,
        coalesce(c.aggregate_count, 0) AS aggregate_count FROM grid g LEFT JOIN numbered c USING (symbol, side, i))
      SELECT symbol, side, CAST(CASE WHEN side = 'ask' THEN i - 1 ELSE 128 - i END AS INTEGER) AS level, price, size, mean_price, aggregate_count FROM padded"""),
    "price size mean_price",
)
def condensed_book(spark, sf_dir):
    """Books of 128 levels per side, flattened again for the comparison."""
    books = K.condensed_book(_written_levels(spark, sf_dir))
    side = lambda name: books.select("symbol", F.lit(name).alias("side"), F.posexplode(f"{name}s").alias("level", "x"))
    return side("bid").unionByName(side("ask")).select(
        "symbol", "side", "level", "x.price", "x.size", "x.mean_price", "x.aggregate_count"
    )


TICK_MS = 60 * DAY_MS
TICK_LEVELS = f"""stamped AS (SELECT *, (event_ms // {TICK_MS} + 1) * {TICK_MS} AS tick_ms FROM depth_updates),
   st AS (SELECT symbol, tick_ms, side, price, max_by(qty, (final_id, event_ms, qty)) AS qty, count(*) AS change_count, var_pop(qty) AS qty_var FROM stamped GROUP BY symbol, tick_ms, side, price),
   en AS (SELECT symbol, max(tick_ms) AS hi FROM stamped GROUP BY symbol),
   sp AS (SELECT st.*, least(coalesce(lead(tick_ms) OVER (PARTITION BY symbol, side, price ORDER BY tick_ms) - {TICK_MS}, hi), hi) AS last_tick FROM st JOIN en USING (symbol)),
   ticks AS (SELECT symbol, side, price, qty, tick_ms AS own, change_count, qty_var, unnest(range(tick_ms, last_tick + 1, {TICK_MS})) AS tick_ms FROM sp WHERE qty > 0)"""


@query("book_at_ticks", with_views("depth_updates", f"""WITH {TICK_LEVELS} SELECT symbol, tick_ms, side, price, qty,
    CASE WHEN tick_ms = own THEN change_count ELSE 0 END AS change_count, CASE WHEN tick_ms = own THEN qty_var END AS qty_var FROM ticks"""), "price qty qty_var")
def book_at_ticks(spark, sf_dir):
    """Full books every 60 days."""
    return K.book_at_ticks(view(spark, sf_dir, "depth_updates"), TICK_MS).select(
        "symbol", "tick_ms", "side", "price", "qty", "change_count", "qty_var"
    )


# --- regrouping -----------------------------------------------------------------


def _regroup_sql(n: int) -> str:
    geo = lambda lo, hi, step, i: f"pow(2, log2({lo}) + {i} * (log2({hi}) - log2({lo})) / ({step} - 1))"
    bid = f"""list_transform(range(0, {n + 1} + cut), lambda j: CASE WHEN j = {n} + cut THEN len - 1 WHEN j = 0 THEN 1
       ELSE CAST(round_even((len - 1) - ({geo(1, '(len - 1)', f'({n + 1} + cut)', f'({n} + cut - j)')} - 1), 0) AS BIGINT) END)"""
    ask = f"""list_transform(range(0, {n} + cut), lambda j: CASE WHEN j = {n - 1} + cut THEN len WHEN j = 0 THEN 1
       ELSE CAST(round_even({geo(1, 'len', f'({n} + cut)', 'j')}, 0) AS BIGINT) END - 1)"""
    return f"""bounds AS (SELECT symbol, side, min(price) FILTER (size > 0 AND price > 0) AS lo, max(price) FILTER (size > 0) AS hi FROM lv GROUP BY ALL),
      ins AS (SELECT lv.*, row_number() OVER (PARTITION BY symbol, side ORDER BY price) - 1 AS pos, count(*) OVER (PARTITION BY symbol, side) AS len, lo, hi
        FROM lv JOIN bounds USING (symbol, side) WHERE price BETWEEN lo AND hi),
      sh AS (SELECT DISTINCT symbol, side, len, lo, hi, CASE WHEN len > {n} AND abs(ln(lo) - ln(hi)) > 1 THEN 1 ELSE 0 END AS cut FROM ins),
      sp AS (SELECT *, CASE WHEN side = 'bid' THEN {bid} ELSE {ask} END AS spaced FROM sh WHERE len > {n}),
      kp AS (SELECT *, CASE WHEN side = 'bid' AND cut = 1 THEN spaced[2] ELSE 0 END AS start,
        CASE WHEN side = 'bid' THEN spaced[2 + cut:{n + 1} + cut] ELSE spaced[1:{n}] END AS raw FROM sp),
      un AS (SELECT symbol, side, start, unnest(range(0, {n})) AS i, unnest(raw) AS x FROM kp),
      lw AS (SELECT *, greatest(0, min(x - i) OVER (PARTITION BY symbol, side ORDER BY i DESC) + i) AS y FROM un),
      fx AS (SELECT *, max(y - i) OVER (PARTITION BY symbol, side ORDER BY i) + i AS kept FROM lw),
      rg AS (SELECT symbol, side, start, i, kept, lag(kept) OVER w AS before, lead(kept) OVER w AS after FROM fx WINDOW w AS (PARTITION BY symbol, side ORDER BY i)),
      big AS (SELECT r.symbol, r.side, r.i AS level, max(CASE WHEN pos = kept THEN price END) AS price, sum(CASE WHEN pos >= start THEN size ELSE 0 END) AS size FROM ins JOIN rg r ON ins.symbol = r.symbol AND ins.side = r.side
        AND CASE WHEN ins.side = 'bid' THEN pos > coalesce(before, -1) AND pos <= kept ELSE pos >= kept AND pos < coalesce(after, len) END GROUP BY ALL),
      small AS (SELECT symbol, side, pos AS level, price, size FROM ins WHERE len <= {n}),
      groups AS (SELECT symbol, side, CAST(level AS INTEGER) AS level, price, size FROM big UNION ALL SELECT symbol, side, CAST(level AS INTEGER), price, size FROM small)"""


@query(
    "regroup_sides",
    with_views("depth_updates", f"""WITH {LEVELS}, lv AS (SELECT symbol, side, price, qty AS size FROM levels), {_regroup_sql(25)} SELECT * FROM groups"""),
    "price size",
)
def regroup_sides(spark, sf_dir):
    levels = _levels(spark, sf_dir).select("symbol", "side", "price", F.col("qty").alias("size"))
    return K.regroup_sides(scratch_table(levels))


# books of varied depth, one per order: levels are made row by row from the order itself
BOOK_SQL = """ob AS (SELECT o_orderkey AS book, concat(CASE WHEN o_orderkey % 11 = 0 THEN 'é' ELSE 'B' END, CAST(o_orderkey % 7 AS VARCHAR)) AS market,
    CASE WHEN o_orderkey % 13 = 0 THEN 0 ELSE epoch_us(o_orderdate) // 1000 END AS time_ms, (o_orderkey % 5) * 0.5E0 AS grouping,
    list_transform(range(0, o_orderkey % 60), lambda i: struct_pack(price := o_totalprice / 100 - 20 * ((o_orderkey % 60) - i), size := CAST((o_orderkey * (i + 1)) % 11 AS DOUBLE) - CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 0 END)) AS bids,
    list_transform(range(0, o_custkey % 40), lambda i: struct_pack(price := o_totalprice / 100 + 3 * i + 1 + i * i, size := CAST((o_custkey * (i + 1)) % 7 AS DOUBLE))) AS asks FROM orders)"""


def _books(spark, sf_dir):
    key, cust, total = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    upto = lambda n: F.filter(F.sequence(F.lit(0), n.cast("int")), lambda i: i < n)
    level = lambda price, size: F.struct(price.alias("price"), size.alias("size"))
    depth = key % 60
    bids = F.transform(
        upto(depth),
        lambda i: level(total / 100 - 20 * (depth - i), ((key * (i + 1)) % 11).cast("double") - F.when(key % 17 == 0, 1).otherwise(0)),
    )
    asks = F.transform(upto(cust % 40), lambda i: level(total / 100 + 3 * i + 1 + i * i, ((cust * (i + 1)) % 7).cast("double")))
    return _table(spark, sf_dir, "orders").select(
        key.alias("book"),
        F.concat(F.when(key % 11 == 0, "é").otherwise("B"), (key % 7).cast("string")).alias("market"),
        F.when(key % 13 == 0, F.lit(0).cast("bigint")).otherwise(F.unix_millis(F.col("o_orderdate").cast("timestamp"))).alias("time_ms"),
        ((key % 5) * 0.5).alias("grouping"), bids.alias("bids"), asks.alias("asks"),
    )


@query(
    "validate_book",
    f"""WITH {BOOK_SQL} SELECT book, concat_ws(',', CASE WHEN NOT grouping > 0 THEN 'grouping' END,
        CASE WHEN NOT regexp_full_match(market, '[\\x00-\\x7F]*') THEN 'market_non_ascii' END, CASE WHEN time_ms + 300000000000 <= 1199145600000 THEN 'time_too_old' END,
        CASE WHEN time_ms + 300000000000 > 1250000000000 + 86400000 THEN 'time_in_future' END,
        CASE WHEN len(list_filter(asks, lambda x: x.price <= 0)) > 0 THEN 'ask_price' END, CASE WHEN len(list_filter(asks, lambda x: x.size < 0)) > 0 THEN 'ask_size' END,
        CASE WHEN len(list_filter(bids, lambda x: x.price < 0)) > 0 THEN 'bid_price' END, CASE WHEN len(list_filter(bids, lambda x: x.size < 0)) > 0 THEN 'bid_size' END) AS failed,
        len(asks) = 0 AND len(bids) = 0 AS empty FROM ob""",
)
def validate_book(spark, sf_dir):
    books = _books(spark, sf_dir).withColumn("time_ms", F.col("time_ms") + 300_000_000_000)
    return C.validate_book(books, 1_250_000_000_000).select("book", F.array_join("failed", ",").alias("failed"), "empty")


@query("reject_epoch_books", f"WITH {BOOK_SQL} SELECT book, time_ms, time_ms > 0 AS kept FROM ob")
def reject_epoch_books(spark, sf_dir):
    good, bad = C.reject_epoch_books(_books(spark, sf_dir))
    return good.select("book", "time_ms", F.lit(True).alias("kept")).unionByName(bad.select("book", "time_ms", F.lit(False).alias("kept")))


_WIDE = [(f"{s[:-1]}_{f}_{i}", s, f, i) for s in ("bids", "asks") for i in range(1, 60) for f in ("price", "size")]


@query("book_to_wide", f"WITH {BOOK_SQL} SELECT book, {', '.join(f'{s}[{i}].{f} AS {c}' for c, s, f, i in _WIDE)} FROM ob", " ".join(c for c, *_ in _WIDE))
def book_to_wide(spark, sf_dir):
    return K.book_to_wide(_books(spark, sf_dir).select("book", "bids", "asks"), 59)


def _flat(books, column: str = "levels"):
    """One row a level. The outer form, since Spark puts a copy of the whole array expression, with all that it is made of, into a filter below the plain one."""
    return books.select("book", F.posexplode_outer(column).alias("level", "x")).where("level IS NOT NULL").select("book", "level", "x.price", "x.size")


@query("wide_to_book", f"WITH {BOOK_SQL}, l AS (SELECT book, 'bid' AS side, bids AS x FROM ob UNION ALL SELECT book, 'ask', asks FROM ob)"
       " SELECT book, side, CAST(i - 1 AS INTEGER) AS level, x[i].price AS price, x[i].size AS size FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM l)", "price size")
def wide_to_book(spark, sf_dir):
    wide = K.book_to_wide(_books(spark, sf_dir).select("book", "bids", "asks"), 59)
    books = K.wide_to_book(wide, 59)
    return _flat(books, "bids").withColumn("side", F.lit("bid")).unionByName(_flat(books, "asks").withColumn("side", F.lit("ask")))


@query("split_and_concat", f"WITH {BOOK_SQL}, c AS (SELECT book, list_concat(bids, bids) AS l FROM ob) SELECT book, CAST(i - 1 AS INTEGER) AS level, l[i].price AS price, l[i].size AS size"
       " FROM (SELECT book, l, unnest(range(1, len(l) + 1)) AS i FROM c)", "price size")
def split_and_concat(spark, sf_dir):
    """Bids put after themselves, split into halves and joined again."""
    books = _books(spark, sf_dir).select("book", "bids").withColumn("asks", F.col("bids"))
    return _flat(K.concat_bid_ask(K.split_bid_ask(K.concat_bid_ask(books))))


def _extrapolated_sql(column: str, n: int, reverse: bool) -> str:
    line = f"list_reverse({column})" if reverse else column
    return f"""e AS (SELECT book, {column} AS l, {line} AS r, len({column}) AS k FROM ob),
      m AS (SELECT *, coalesce(list_avg(list_filter(list_transform(range(2, k + 1), lambda i: CASE WHEN r[i - 1].price <> 0 THEN r[i].price / r[i - 1].price - 1 END), lambda x: x IS NOT NULL)), 0) AS step FROM e),
      g AS (SELECT *, unnest(range(1, greatest(k, {n}) + 1)) AS i FROM m)
      SELECT book, CAST(CASE WHEN k > 1 AND {'TRUE' if reverse else 'FALSE'} THEN greatest(k, {n}) - i ELSE i - 1 END AS INTEGER) AS level,
        CASE WHEN k = 0 THEN 0 WHEN k = 1 THEN r[1].price / pow(1.0005E0, i - 1) WHEN i <= k THEN r[i].price ELSE r[k].price * pow(1 + step, i - k) END AS price,
        CASE WHEN i <= k THEN r[i].size ELSE 0 END AS size FROM g"""


@query("extrapolate_levels", f"WITH {BOOK_SQL}, {_extrapolated_sql('asks', 30, False)}", "price size", digits=2)
def extrapolate_levels(spark, sf_dir):
    return _flat(_books(spark, sf_dir).select("book", K.extrapolate_levels(F.col("asks"), 30).alias("levels")))


@query("extrapolate_levels_down", f"WITH {BOOK_SQL.replace('o_totalprice / 100 - 20', 'o_totalprice + 5000 - 20')}, {_extrapolated_sql('bids', 40, True)}", "price size", digits=2)
def extrapolate_levels_down(spark, sf_dir):
    lifted = F.transform("bids", lambda x: F.struct((x["price"] - F.col("o_totalprice") / 100 + F.col("o_totalprice") + 5000).alias("price"), x["size"].alias("size")))
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("book"), "o_totalprice")
    books = _books(spark, sf_dir).join(orders, "book").select("book", lifted.alias("bids"))
    return _flat(books.select("book", K.extrapolate_levels(F.col("bids"), 40, reverse=True).alias("levels")))


@query(
    "pad_levels",
    f"""WITH {BOOK_SQL} SELECT book, CAST(i - 1 AS INTEGER) AS level, CASE WHEN i <= len(asks) THEN asks[i].price ELSE coalesce(asks[len(asks)].price, 0) END AS price,
        CASE WHEN i <= len(asks) THEN asks[i].size ELSE 0 END AS size FROM (SELECT book, asks, unnest(range(1, greatest(len(asks), 30) + 1)) AS i FROM ob)""",
    "price size",
)
def pad_levels(spark, sf_dir):
    types = {"price": "double", "size": "double"}
    return _flat(_books(spark, sf_dir).select("book", K.pad_levels(F.col("asks"), 30, types).alias("levels")))


@query(
    "regroup_book",
    f"""WITH {BOOK_SQL}, lv AS (SELECT book AS symbol, 'bid' AS side, unnest(bids).price AS price, unnest(bids).size AS size FROM ob
          UNION ALL SELECT book, 'ask', unnest(asks).price, unnest(asks).size FROM ob), {_regroup_sql(10)},
        have AS (SELECT DISTINCT symbol FROM lv), sides AS (SELECT symbol, s AS side FROM have, (VALUES ('bid'), ('ask')) v(s)),
        k AS (SELECT symbol, side, count(level) AS k, list(struct_pack(price := price, size := size) ORDER BY level) AS l FROM sides LEFT JOIN groups USING (symbol, side) GROUP BY ALL),
        e AS (SELECT symbol, side, k, CASE WHEN side = 'bid' THEN list_reverse(l) ELSE l END AS r FROM k),
        m AS (SELECT *, coalesce(list_avg(list_transform(range(2, k + 1), lambda i: r[i].price / r[i - 1].price - 1)), 0) AS step FROM e),
        g AS (SELECT *, unnest(range(1, 11)) AS i FROM m)
        SELECT symbol AS book, side, CAST(CASE WHEN k > 1 AND side = 'bid' THEN 10 - i ELSE i - 1 END AS INTEGER) AS level,
          CASE WHEN k = 0 THEN 0 WHEN k = 1 THEN r[1].price / pow(1.0005E0, i - 1) WHEN i <= k THEN r[i].price ELSE r[k].price * pow(1 + step, i - k) END AS price,
          CASE WHEN k > 0 AND i <= k THEN r[i].size ELSE 0 END AS size FROM g""",
    "price size", digits=3,
)
def regroup_book(spark, sf_dir):
    """Ten levels per side of every order's book."""
    books = _books(spark, sf_dir)
    side = lambda name: books.select("book", F.lit(name).alias("side"), F.inline(f"{name}s"))
    out = K.regroup_book(scratch_table(side("bid").unionByName(side("ask"))), 10, ["book"])
    # both sides at once: as a union the books would be made twice
    sides = out.select("book", F.inline_outer(F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"{s}s").alias("levels")) for s in ("bid", "ask")))))
    flat = sides.select("book", "side", F.posexplode_outer("levels").alias("level", "x")).where("level IS NOT NULL")
    return flat.select("book", "level", "x.price", "x.size", "side")


@query(
    "geometric_index",
    """WITH g AS (SELECT DISTINCT l_partkey + 30 AS len FROM lineitem),
       s AS (SELECT len, list_transform(range(0, 26), lambda j: CASE WHEN j = 25 THEN len WHEN j = 0 THEN 1 ELSE CAST(round_even(len - (pow(2, (25 - j) * log2(len) / 25) - 1), 0) AS BIGINT) END) AS raw FROM g),
       u AS (SELECT len, unnest(range(0, 26)) AS i, unnest(raw) AS x FROM s),
       l AS (SELECT *, greatest(0, min(x - i) OVER (PARTITION BY len ORDER BY i DESC) + i) AS y FROM u)
       SELECT len, CAST(i AS INTEGER) AS i, CAST(x AS INTEGER) AS x, CAST(max(y - i) OVER (PARTITION BY len ORDER BY i) + i AS INTEGER) AS fixed FROM l""",
)
def geometric_index(spark, sf_dir):
    """Spaced positions for every book length taken from the part keys in use."""
    lengths = _table(spark, sf_dir, "lineitem").select((F.col("l_partkey") + 30).alias("len")).distinct()
    spaced = lengths.select("len", S.geometric_index(F.lit(1), F.col("len"), F.lit(26)).alias("raw"))
    both = spaced.select("len", F.posexplode(F.arrays_zip("raw", S.fix_index("raw").alias("fixed"))).alias("i", "x"))
    return both.select("len", "i", F.col("x")["raw"].alias("x"), F.col("x")["fixed"].alias("fixed"))
