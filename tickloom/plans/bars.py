"""Bar queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import bars as B
from tickloom.operators.bars import BAR_COLUMNS
from tickloom.functions import scalars as S
from tickloom.plans.registry import query
from tickloom.plans.views import view, with_views
from tickloom.sources.tables import scan_trades

HOUR_MS, DAY_MS = 3_600_000, 86_400_000
PERIODS = [4 * HOUR_MS, DAY_MS]
OFFSETS = [HOUR_MS, 0]

DOUBLES = " ".join(c for c in BAR_COLUMNS if c not in ("time_ms", "num_trades", "trade_id"))


def _previous(shift: int, periods) -> str:
    whens = " ".join(f"WHEN {p} THEN {S.previous_period_ms(p, shift)}" for p in dict.fromkeys(periods))
    return f"(CASE period_ms {whens} END)"


def bars_ctes(trades: str, periods, offsets, where: str = "TRUE") -> str:
    """CTE list (without WITH) that ends in ``bars``: every bar column of the given trades."""
    pairs = ", ".join(f"(CAST({p} AS BIGINT), CAST({o} AS BIGINT))" for p, o in zip(periods, offsets))
    key = "market, period_ms, offset_ms, bucket_ms"
    over = f"PARTITION BY {key}"
    before = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    closes = ", ".join(
        f"coalesce(max_by(price, i) FILTER (time_ms <= bucket_ms + {_previous(s, periods)}), 0.0) AS close_prev_period{s}"
        for s in range(3)
    )
    price_q, volume_q = [], []
    for n, q in B.PRICE_QUANTILES.items():
        pos = f"((wt - 1) * {q}E0)"
        at = lambda f: f"max(CASE WHEN pb <= {f}({pos}) AND {f}({pos}) < pb + wgt THEN price END)"
        price_q.append(
            f"CASE WHEN {at('floor')} = {at('ceil')} THEN {at('floor')} ELSE"
            f" (1 - max({pos} - floor({pos}))) * {at('floor')} + max({pos} - floor({pos})) * {at('ceil')} END AS {n}"
        )
    for n, q in B.VOLUME_QUANTILES.items():
        volume_q.append(f"quantile_cont(volume, {q}) AS {n}")
    fin = lambda e: f"coalesce(CASE WHEN isfinite({e}) THEN {e} END, 0.0)"
    d = "(w1 - w2 / w1)"
    skew_s = "((w1 * (w1 * w1 - 3 * w2) + 2 * w3) / (w1 * w1))"
    poly = "(pow(w1, 4) - 6 * w1 * w1 * w2 + 8 * w1 * w3 + 3 * w2 * w2 - 6 * w4)"
    ka = "(pow(w1, 4) - 4 * w1 * w3 + 3 * w2 * w2)"
    kb = "(3 * (pow(w1, 4) - 2 * w1 * w1 * w2 + 4 * w1 * w3 - 3 * w2 * w2))"
    slope = "CASE WHEN n >= 2 AND t1 > t0 AND sxx > 0 THEN sxy / sxx ELSE 0.0 END"
    log_slope = f"CASE WHEN n >= 2 AND t1 > t0 THEN {fin(f'(slog / (mx / {d} * (w1 - last_volume)))')} ELSE 0.0 END"
    return f"""
    ranked AS (SELECT *, row_number() OVER (PARTITION BY market, id ORDER BY time_ms, price, volume, flag) AS rn
               FROM {trades}),
    clean AS (SELECT id, time_ms, market, price, volume, flag FROM ranked WHERE rn = 1 AND price > 0 AND volume > 0),
    r AS (SELECT c.*, period_ms, offset_ms,
                 time_ms - (((time_ms - offset_ms) % period_ms) + period_ms) % period_ms AS bucket_ms
          FROM clean c, (VALUES {pairs}) p(period_ms, offset_ms)),
    kept AS (SELECT * FROM r WHERE {where}),
    g AS (SELECT {key}, count(*) AS n, sum(volume) AS w1, sum(volume * price) / sum(volume) AS mp,
                 avg(price) AS ap, avg(volume) AS mv, min(time_ms) AS t0, max(time_ms) AS t1,
                 sum(volume * log2(price)) / sum(volume) AS ml, sum(volume * time_ms) / sum(volume) AS mt,
                 arg_min(price, (time_ms, id)) AS o
          FROM kept GROUP BY ALL),
    g2 AS (SELECT *, 2.0E0 / (greatest(coalesce(lag(n) OVER (PARTITION BY market, period_ms, offset_ms
                 ORDER BY bucket_ms), 0), 23) + 1) AS alpha FROM g),
    j AS (SELECT kept.*, n, mp, ap, mv, t0, t1, ml, o, alpha, (time_ms - t0) / 1000.0E0 AS x, log2(price) AS y,
                 (mt - t0) / 1000.0E0 AS mxx,
                 least(greatest(CAST(trunc(volume / exp(round_even(ln(o), 0) - 10)) AS BIGINT), 1), 65536) AS wgt
          FROM kept JOIN g2 USING ({key})),
    p AS (SELECT *, row_number() OVER o1 - 1 AS i,
                 sum(volume) OVER ({over} ORDER BY time_ms, id {before}) AS pw,
                 sum(volume * x) OVER ({over} ORDER BY time_ms, id {before}) AS pwx,
                 sum(volume * y) OVER ({over} ORDER BY time_ms, id {before}) AS pwy,
                 coalesce(sum(wgt) OVER ({over} ORDER BY price, time_ms, id {before}), 0) AS pb,
                 sum(wgt) OVER ({over}) AS wt,
                 avg(x) OVER ({over}) AS ax
          FROM j WINDOW o1 AS ({over} ORDER BY time_ms, id)),
    s AS (SELECT {key}, count(*) AS n, min(t0) AS t0, min(t1) AS t1, min(ml) AS ml, min(mxx) AS mxx, min(o) AS open,
                 min(ap) AS ap, min(ax) AS ax, max(price) AS high, min(price) AS low,
                 max_by(price, i) AS close, max_by(id, i) AS trade_id, max_by(volume, i) AS last_volume,
                 sum(volume) AS w1, sum(pow(volume, 2)) AS w2, sum(pow(volume, 3)) AS w3, sum(pow(volume, 4)) AS w4,
                 min(mp) AS mean_price, min(mv) AS mean_volume, max(volume) AS max_volume, min(volume) AS min_volume,
                 sum(volume * pow(price - mp, 2)) AS m2, sum(volume * pow(price - mp, 3)) AS m3,
                 sum(volume * pow(price - mp, 4)) AS m4,
                 sum(pow(volume - mv, 2)) AS v2, sum(pow(volume - mv, 3)) AS v3, sum(pow(volume - mv, 4)) AS v4,
                 sum((x - ax) * (price - ap)) AS sxy, sum(pow(x - ax, 2)) AS sxx, sum(pow(price - ap, 2)) AS syy,
                 sum(volume * pow(x - mxx, 2)) AS mx,
                 sum(CASE WHEN pw > 0 THEN (pwx / pw - x) * (pwy / pw - y) * pw / (pw + volume) ELSE 0 END) AS slog,
                 sum(alpha * price * pow(1 - alpha, n - 1 - i)
                     + CASE WHEN i = 0 THEN price * pow(1 - alpha, n - 1 - i) * (1 - alpha) ELSE 0 END) AS ema_price,
                 sum(CASE WHEN flag & 1 > 0 THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) AS buy_ratio,
                 CASE WHEN sum(volume) > 0 THEN sum(CASE WHEN flag & 1 > 0 THEN volume ELSE 0 END) / sum(volume)
                      ELSE 0.5 END AS buy_volume_ratio,
                 CASE WHEN sum(volume) > 0 THEN sum(CASE WHEN flag & 4 > 0 THEN volume ELSE 0 END) / sum(volume)
                      ELSE 0.5 END AS liquidation_volume_ratio,
                 {closes}, {', '.join(price_q)}, {', '.join(volume_q)}
          FROM p GROUP BY ALL),
    f AS (SELECT *, {slope} AS sl, {log_slope} AS lsl FROM s),
    bars AS (SELECT market, period_ms, offset_ms, bucket_ms AS time_ms, open, high, low, close, w1 AS volume, mean_price,
                 CASE WHEN n < 2 OR high = low THEN 0.0 ELSE {fin(f'sqrt(m2 / {d})')} END AS std_price,
                 CASE WHEN n < 4 OR high = low THEN 0.0
                      ELSE {fin(f'(({ka} * w1 * m4 / (m2 * m2) - {kb}) * ({d} / (w1 * {poly})))')} END AS kurtosis_price,
                 CASE WHEN n < 3 OR high = low THEN 0.0
                      ELSE {fin(f'(m3 / ({skew_s} * pow(m2 / {d}, 1.5)))')} END AS skewness_price,
                 ema_price, mean_volume,
                 CASE WHEN n < 2 OR max_volume = min_volume THEN 0.0 ELSE sqrt(v2 / (n - 1)) END AS std_volume,
                 CASE WHEN n < 4 OR max_volume = min_volume THEN 0.0
                      ELSE (n - 1.0E0) / ((n - 2.0E0) * (n - 3)) * ((n + 1) * (v4 / n / pow(v2 / n, 2) - 3) + 6)
                      END AS kurtosis_volume,
                 CASE WHEN n < 3 OR max_volume = min_volume THEN 0.0
                      ELSE v3 / n / pow(v2 / n, 1.5) * sqrt(n * (n - 1.0E0)) / (n - 2) END AS skewness_volume,
                 max_volume, buy_ratio, buy_volume_ratio, liquidation_volume_ratio, n AS num_trades,
                 {', '.join(B.PRICE_QUANTILES)}, {', '.join(B.VOLUME_QUANTILES)},
                 close_prev_period0, close_prev_period1, close_prev_period2,
                 sl AS price_regression_slope,
                 CASE WHEN n >= 2 THEN ap - open - sl * ax ELSE 0.0 END AS price_regression_intercept,
                 CASE WHEN n >= 2 AND t1 > t0 AND high > low
                      THEN least(greatest(sxy / sqrt(sxx) / sqrt(syy), -1), 1) ELSE 0.0 END AS price_regression_correlation,
                 pow(2, lsl) AS price_log_regression_slope,
                 CASE WHEN n >= 2 THEN ml - lsl * mxx ELSE 0.0 END AS price_log_regression_intercept,
                 trade_id
             FROM f)"""


def bars_sql(view_name: str, periods, offsets, where: str = "TRUE", columns: str = "*") -> str:
    return with_views(
        view_name, f"WITH {bars_ctes(view_name, periods, offsets, where).strip()} SELECT {columns} FROM bars"
    )


def _some(columns: str) -> tuple[str, list[str]]:
    names = ["market", "period_ms", "offset_ms", "time_ms", *columns.split()]
    return ", ".join(names), names


@query("trade_bars", bars_sql("trades", PERIODS, OFFSETS), DOUBLES)
def trade_bars(spark, sf_dir):
    return B.trade_bars(view(spark, sf_dir, "trades"), PERIODS, OFFSETS)


@query("trade_bars_big", bars_sql("trades_big", [7 * DAY_MS], [0]), DOUBLES, digits=3)
def trade_bars_big(spark, sf_dir):
    return B.trade_bars(view(spark, sf_dir, "trades_big"), [7 * DAY_MS])


@query("trade_bars_three_periods", bars_sql("trades", [HOUR_MS, 4 * HOUR_MS, DAY_MS], [0, HOUR_MS, 0]), DOUBLES)
def trade_bars_three_periods(spark, sf_dir):
    return B.trade_bars(view(spark, sf_dir, "trades"), [HOUR_MS, 4 * HOUR_MS, DAY_MS], [0, HOUR_MS, 0])


@query("trade_bars_chunked", bars_sql("trades", [DAY_MS], [0]), DOUBLES)
def trade_bars_chunked(spark, sf_dir):
    """Every bucket above 50 trades goes through the chunked way."""
    return B.trade_bars(view(spark, sf_dir, "trades"), [DAY_MS], rows_per_chunk=50)


AS_OF_MS = 1_705_500_000_000


@query(
    "trade_bars_closed",
    bars_sql("trades", PERIODS, OFFSETS, f"bucket_ms + period_ms <= {AS_OF_MS}"),
    DOUBLES,
)
def trade_bars_closed(spark, sf_dir):
    return B.trade_bars(view(spark, sf_dir, "trades"), PERIODS, OFFSETS, as_of_ms=AS_OF_MS)


def _part_of_bars(name: str, columns: str):
    """A query on some bar columns, sharing the full check."""
    listed, names = _some(columns)
    doubles = " ".join(c for c in columns.split() if c in DOUBLES.split())

    @query(name, bars_sql("trades", PERIODS, OFFSETS, columns=listed), doubles)
    def build(spark, sf_dir):
        return B.trade_bars(view(spark, sf_dir, "trades"), PERIODS, OFFSETS).select(*names)


_part_of_bars("volume_moments", "mean_volume std_volume skewness_volume kurtosis_volume max_volume")
_part_of_bars("weighted_price_moments", "mean_price std_price skewness_price kurtosis_price")
_part_of_bars("bar_quantiles", " ".join((*B.PRICE_QUANTILES, *B.VOLUME_QUANTILES)))
_part_of_bars("ema_price", "ema_price num_trades")
_part_of_bars("log_price_regression", "price_log_regression_slope price_log_regression_intercept")


def _simple(name: str, view_name: str, columns: str):
    listed, names = _some(columns)
    doubles = " ".join(c for c in columns.split() if c in DOUBLES.split())

    @query(name, bars_sql(view_name, PERIODS, OFFSETS, columns=listed), doubles)
    def build(spark, sf_dir):
        bars = B.simple_bars(view(spark, sf_dir, view_name), PERIODS, OFFSETS)
        return bars.withColumnRenamed("bucket_ms", "time_ms").select(*names)


_simple("bars_ohlc", "trades_big", "open high low close volume num_trades trade_id")
_simple("bars_flow_ratios", "trades_big", "buy_ratio buy_volume_ratio liquidation_volume_ratio num_trades")
_simple("bars_previous_closes", "trades", "close_prev_period0 close_prev_period1 close_prev_period2")


@query(
    "price_regression",
    with_views(
        "trades",
        """SELECT market, CASE WHEN max(x) > min(x) THEN regr_slope(price, x) ELSE 0 END AS regression_slope,
           avg(price) - CASE WHEN max(x) > min(x) THEN regr_slope(price, x) ELSE 0 END * avg(x) AS regression_intercept,
           corr(price, x) AS regression_correlation
           FROM (SELECT *, (time_ms - 1704067200000) / 3600000.0E0 AS x FROM trades) GROUP BY market""",
    ),
    "regression_slope regression_intercept regression_correlation",
)
def price_regression(spark, sf_dir):
    x = (F.col("time_ms") - F.lit(1704067200000)) / F.lit(3600000.0)
    return B.regression(view(spark, sf_dir, "trades"), ["market"], x, F.col("price"))


@query(
    "trade_dedupe",
    with_views(
        "trades",
        """SELECT market, id, time_ms, price, volume, CAST(flag AS INTEGER) AS flag FROM trades""",
    ),
    "price volume",
)
def trade_dedupe(spark, sf_dir):
    trades = view(spark, sf_dir, "trades")
    later = trades.withColumn("time_ms", F.col("time_ms") + 5)
    twice = later.unionByName(trades)
    return B.trade_dedupe(twice).select("market", "id", "time_ms", "price", "volume", F.col("flag").cast("int").alias("flag"))


@query(
    "cross_periods",
    with_views(
        "trades",
        f"""SELECT market, period_ms, offset_ms, count(*) AS n, min(id) AS first_id
            FROM trades, (VALUES (CAST({PERIODS[0]} AS BIGINT), CAST({OFFSETS[0]} AS BIGINT)),
                                 ({PERIODS[1]}, {OFFSETS[1]})) p(period_ms, offset_ms) GROUP BY ALL""",
    ),
)
def cross_periods(spark, sf_dir):
    crossed = B.cross_periods(view(spark, sf_dir, "trades"), PERIODS, OFFSETS)
    return crossed.groupBy("market", "period_ms", "offset_ms").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")
    )


@query(
    "bucket_start",
    with_views("trades_big", "SELECT id, time_ms, time_ms - (time_ms - 60000) % 300000 AS bucket_ms FROM trades_big"),
)
def bucket_start(spark, sf_dir):
    return view(spark, sf_dir, "trades_big").select(
        "id", "time_ms", S.bucket_start("time_ms", 300_000, 60_000).alias("bucket_ms")
    )


@query(
    "series_bounds",
    with_views("trades_big", "SELECT market, min(time_ms) AS first_ms, max(time_ms) AS last_ms FROM trades_big GROUP BY market"),
)
def series_bounds(spark, sf_dir):
    return B.series_bounds(view(spark, sf_dir, "trades_big"), ["market"])


LO_MS, HI_MS = 1_704_500_000_000, 1_705_500_000_000


@query(
    "scan_trades",
    with_views("trades", f"SELECT id, time_ms, market, price, volume, CAST(flag AS INTEGER) AS flag FROM trades"
               f" WHERE market IN ('click', 'view') AND time_ms >= {LO_MS} AND time_ms < {HI_MS}"),
    "price volume",
)
def scan(spark, sf_dir):
    found = scan_trades(view(spark, sf_dir, "trades"), ["click", "view"], LO_MS, HI_MS)
    return found.withColumn("flag", F.col("flag").cast("int"))


@query(
    "trade_order",
    with_views("trades", "SELECT id, market, row_number() OVER (PARTITION BY market ORDER BY time_ms, id) - 1 AS position,"
               " lag(id) OVER (PARTITION BY market ORDER BY time_ms, id) AS previous_id FROM trades"),
)
def trade_order(spark, sf_dir):
    """Position and previous id of each trade in its market's (time, id) order."""
    from tickloom.operators.prefix import running, time_chunk

    out = running(
        view(spark, sf_dir, "trades").select("id", "market", "time_ms"), ["market"], ["time_ms", "id"],
        time_chunk("time_ms", DAY_MS), sums={"position": F.lit(1).cast("bigint")}, lasts={"previous_id": F.col("id")},
    )
    return out.select("id", "market", "position", "previous_id")
