"""Trade bars: one row per market, period and bucket, 38 columns.

Plan: the rows are reduced to one record per bucket by hash aggregates with map-side
combine; that small table is joined back to the rows for everything that needs a value
of the whole bucket (mean, first price, trade count of the bucket before).  Columns
that depend on trade order are prefix computations in chunks
(:mod:`tickloom.operators.prefix`), quantiles are cumulative frequencies over distinct
values.  Buckets too large for a task are cut into ranges of about equal size by trade
order and by value.

Buckets are true period buckets; trades are ordered by (time, id).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.functions.scalars import (
    bucket_start,
    clamp,
    is_buy,
    is_liquidation,
    nan_to_num,
    previous_period_ms,
    safe_divide,
)
from tickloom.operators.digests import COMPRESSION, digest_quantile, merged_digests, quantile_digests
from tickloom.operators.filters import valid_trades
from tickloom.operators.prefix import running
from tickloom.session import scratch_table

GROUP = ["market", "period_ms", "offset_ms", "bucket_ms"]

# Quantiles, smallest span of the moving average, weight range of price quantiles.
PRICE_QUANTILES = {"price_q10": 0.10, "price_q25": 0.25, "price_q50": 0.5, "price_q75": 0.75, "price_q90": 0.9}
VOLUME_QUANTILES = {"volume_q50": 0.5, "volume_q75": 0.75, "volume_q90": 0.9, "volume_q95": 0.95}
MIN_EMA_SPAN = 23
MAX_PRICE_WEIGHT = 65_536

# The bar columns, in table order.
BAR_COLUMNS = """
time_ms open high low close volume
mean_price std_price kurtosis_price skewness_price ema_price
mean_volume std_volume kurtosis_volume skewness_volume max_volume
buy_ratio buy_volume_ratio liquidation_volume_ratio num_trades
price_q10 price_q25 price_q50 price_q75 price_q90
volume_q50 volume_q75 volume_q90 volume_q95
close_prev_period0 close_prev_period1 close_prev_period2
price_regression_slope price_regression_intercept price_regression_correlation
price_log_regression_slope price_log_regression_intercept
trade_id
""".split()

ROWS_PER_CHUNK = 1_000_000
#: Rows that a task cuts into ranges at least, where ranges are smaller.
ROWS_PER_TASK = 100_000
#: Rows that the windows of a task hold, about 1.5 KB each, where buckets are smaller.
ROWS_PER_WINDOW = 200_000


# --- preparing trades ---------------------------------------------------------


def trade_dedupe(trades: DataFrame, keys: Sequence[str] = ("market", "id")) -> DataFrame:
    """First occurrence of each trade id of a market.

    First is by time; equal times are told apart by the remaining columns, so a re-run
    task picks the same row.  Copies collapse before the shuffle.  (An order in one decimal
    would make this a hash aggregate, but is slower: 5.3 s against 3.9 s for six million ids.)
    """
    rest = [c for c in trades.columns if c not in keys]
    first = F.min(F.struct("time_ms", *(c for c in rest if c != "time_ms"))).alias("_t")
    return trades.groupBy(*keys).agg(first).select(*(c if c in keys else F.col("_t")[c].alias(c) for c in trades.columns))


def cross_periods(df: DataFrame, periods_ms: Sequence[int], offsets_ms: Sequence[int] | None = None) -> DataFrame:
    """Each row once per (period, offset) pair, so that all periods share one scan."""
    offsets_ms = list(offsets_ms) if offsets_ms is not None else [0] * len(periods_ms)
    pairs = list(zip(periods_ms, offsets_ms))
    long = lambda x: F.lit(x).cast("bigint")
    choices = F.array(*(F.struct(long(p).alias("period_ms"), long(o).alias("offset_ms")) for p, o in pairs))
    return df.select("*", F.inline(choices))


def bucketed(trades: DataFrame, periods_ms: Sequence[int], offsets_ms: Sequence[int] | None = None) -> DataFrame:
    crossed = cross_periods(trades, periods_ms, offsets_ms)
    return crossed.withColumn("bucket_ms", bucket_start("time_ms", F.col("period_ms"), F.col("offset_ms")))


def closed_only(df: DataFrame, as_of_ms: int | None) -> DataFrame:
    """Drop buckets still open at ``as_of_ms``."""
    return df if as_of_ms is None else df.filter(F.col("bucket_ms") + F.col("period_ms") <= as_of_ms)


def trade_order(time_ms="time_ms", id_="id") -> Column:
    """(time, id) as one number.

    Aggregates ordered by a struct cannot be hash aggregates; a decimal key keeps them so.
    """
    step = F.lit("20000000000000000000").cast("decimal(20,0)")
    return (F.col(time_ms).cast("decimal(18,0)") * step + F.col(id_).cast("decimal(19,0)")).cast("decimal(38,0)")


# --- aggregates over one bucket -----------------------------------------------


def ohlc_columns() -> dict[str, Column]:
    """Needs ``_ord`` from :func:`trade_order`."""
    return {
        "open": F.min_by("price", "_ord"),
        "high": F.max("price"),
        "low": F.min("price"),
        "close": F.max_by("price", "_ord"),
        "volume": F.sum("volume"),
        "num_trades": F.count(F.lit(1)),
        "trade_id": F.max_by("id", "_ord"),
    }


def flow_columns() -> dict[str, Column]:
    n, total = F.count(F.lit(1)).cast("double"), F.sum("volume")
    share = lambda cond: F.when(
        total > 0, safe_divide(F.sum(F.when(cond, F.col("volume")).otherwise(0.0)), total)
    ).otherwise(0.5)
    return {
        "buy_ratio": clamp(F.count_if(is_buy("flag")) / n, 0.0, 1.0),
        "buy_volume_ratio": clamp(share(is_buy("flag")), 0.0, 1.0),
        "liquidation_volume_ratio": clamp(share(is_liquidation("flag")), 0.0, 1.0),
    }


def previous_close_columns(periods_ms: Sequence[int]) -> dict[str, Column]:
    """Last price up to the bucket start plus a smaller standard period; 0 when there is none."""

    def cut(shift: int) -> Column:
        out = F.lit(None).cast("bigint")
        for p in dict.fromkeys(periods_ms):
            out = F.when(F.col("period_ms") == p, F.lit(previous_period_ms(p, shift)).cast("bigint")).otherwise(out)
        return out

    def close_at(shift: int) -> Column:
        inside = F.col("time_ms") <= F.col("bucket_ms") + cut(shift)
        return F.coalesce(F.max_by("price", F.when(inside, F.col("_ord"))), F.lit(0.0))

    return {f"close_prev_period{s}": close_at(s) for s in range(3)}


def regression_columns(x: Column, y: Column, prefix: str = "price_regression") -> dict[str, Column]:
    """Least squares of y on x: slope 0 when all x agree, everything 0 for a single point."""
    spread = F.max(x) > F.min(x)
    slope = F.when(spread, F.regr_slope(y, x)).otherwise(F.lit(0.0))
    several = F.count(x) >= 2
    intercept = F.when(several, F.avg(y) - slope * F.avg(x))
    moves = spread & (F.max(y) > F.min(y))
    return {
        f"{prefix}_slope": nan_to_num(slope),
        f"{prefix}_intercept": nan_to_num(intercept),
        f"{prefix}_correlation": clamp(nan_to_num(F.when(moves, F.corr(y, x))), -1.0, 1.0),
    }


def regression(df: DataFrame, keys: Sequence[str], x: Column, y: Column) -> DataFrame:
    """Least squares per key."""
    return df.groupBy(*keys).agg(*(c.alias(n) for n, c in regression_columns(x, y, "regression").items()))


def _elapsed(start: str) -> Column:
    return (F.col("time_ms") - F.col(start)) / F.lit(1000.0)


def bucket_summary(rows: DataFrame) -> DataFrame:
    """First pass, one record per bucket: sums, extremes and means.

    Plain sums with map-side combine; ``_``-columns serve the second pass.
    """
    w, p, x = F.col("volume"), F.col("price"), _elapsed("bucket_ms")
    return (
        rows.withColumn("_ord", trade_order())
        .groupBy(*GROUP)
        .agg(
            F.min_by("price", "_ord").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.sum(w).alias("volume"),
            F.count(F.lit(1)).alias("num_trades"),
            *(c.alias(n) for n, c in flow_columns().items()),
            F.avg(w).alias("mean_volume"),
            F.max(w).alias("max_volume"),
            F.min(w).alias("_min_volume"),
            F.min("time_ms").alias("_first"),
            F.max("time_ms").alias("_last"),
            F.avg(x).alias("_avg_x"),
            F.avg(p).alias("_avg_price"),
            safe_divide(F.sum(w * p), F.sum(w)).alias("mean_price"),
            safe_divide(F.sum(w * x), F.sum(w)).alias("_mean_x"),
            safe_divide(F.sum(w * F.log2(p)), F.sum(w)).alias("_mean_log"),
        )
    )


def with_ema_span(summary: DataFrame) -> DataFrame:
    """Span of each bucket's moving average: the trade count of the bucket before, at least 23."""
    before = Window.partitionBy("market", "period_ms", "offset_ms").orderBy("bucket_ms")
    span = F.greatest(F.coalesce(F.lag("num_trades").over(before), F.lit(0)), F.lit(MIN_EMA_SPAN))
    return summary.withColumn("_alpha", F.lit(2.0) / (span + 1))


def in_ranges(rows: DataFrame, order: Sequence[str], tasks: int, rows_per_range: int | None = None) -> DataFrame:
    """Rows cut into ranges along ``order``, numbered by ``_range``: ``tasks`` of about the same size.

    The borders come from a sample of the rows, so a burst or a long tail gets as many ranges
    as it has rows for; end ``order`` with a unique column.  The numbers belong to a written
    table: they stay the same when a task is repeated.  With ``rows_per_range`` a task cuts its
    rows into ranges of so many, so that small ranges don't need a task each.
    """
    dealt = rows.repartitionByRange(tasks, *order)
    if rows_per_range is None:
        return scratch_table(dealt.withColumn("_range", F.spark_partition_id().cast("bigint")))
    # the number of a row within its task is in the lower 33 bits
    number, task = F.monotonically_increasing_id(), F.shiftleft(F.spark_partition_id().cast("bigint"), 33)
    cut = task + F.floor((number - task) / rows_per_range).cast("bigint")
    return scratch_table(dealt.sortWithinPartitions(*order).withColumn("_range", cut))


# --- second pass -----------------------------------------------------------------

# Bucket values the second pass reads; they are the same on every row of a bucket.
SUMMARY_COLUMNS = """
open high low mean_price num_trades mean_volume max_volume _min_volume
_first _last _avg_x _avg_price _mean_x _mean_log _alpha
""".split()


def with_summary(rows: DataFrame, summary: DataFrame) -> DataFrame:
    """Rows with the values of their bucket, ``_x`` (seconds since the first trade) and ``_y`` (log2 price)."""
    joined = rows.drop("flag").join(summary.select(*GROUP, *SUMMARY_COLUMNS), GROUP)
    shift = (F.col("_first") - F.col("bucket_ms")) / 1000.0
    return joined.withColumns(
        {
            "_x": _elapsed("_first"),
            "_y": F.log2("price"),
            "_avg_x": F.col("_avg_x") - shift,
            "_mean_x": F.col("_mean_x") - shift,
        }
    )


def trade_positions(joined: DataFrame, one_chunk: bool) -> DataFrame:
    """Position of each trade in its bucket and sums over the trades before it.

    Unless every bucket is one chunk, ``_range`` from :func:`in_ranges` tells the chunks.
    """
    w = F.col("volume")
    return running(
        joined, GROUP, ["time_ms", "id"], F.lit(0) if one_chunk else F.col("_range"), one_chunk=one_chunk,
        sums={"_i": F.lit(1), "_pw": w, "_pwx": w * F.col("_x"), "_pwy": w * F.col("_y")},
    )


def ordered_sums(periods_ms: Sequence[int], standard_log_regression: bool = False) -> dict[str, Column]:
    """Aggregates over the placed trades of a bucket."""
    w, x, price, alpha, i = (F.col(c) for c in ("volume", "_x", "price", "_alpha", "_i"))
    last = F.col("num_trades") - 1
    keep = F.pow(1 - alpha, (last - i).cast("double"))
    ema_term = alpha * price * keep + F.when(i == 0, price * keep * (1 - alpha)).otherwise(0.0)
    before = F.col("_pw")
    factor = w if standard_log_regression else F.lit(1.0)
    # deviations from the means of the trades before; the weight itself is left out of the
    # co-moment as in the established definition of this column, which makes it order-dependent
    co_moment = F.when(
        before > 0,
        (safe_divide(F.col("_pwx"), before) - x) * (safe_divide(F.col("_pwy"), before) - F.col("_y"))
        * factor * before / (before + w),
    ).otherwise(0.0)

    def powers(weight: Column, d: Column, names: dict[str, int]) -> dict[str, Column]:
        out, product, degree = {}, weight, 0
        for name, k in names.items():
            while degree < k:
                product, degree = product * d, degree + 1
            out[name] = F.sum(product)
        return out

    one = lambda c: F.max(c)  # noqa: E731  the same on every row of the bucket
    dx, dy = x - F.col("_avg_x"), price - F.col("_avg_price")
    dwx = x - F.col("_mean_x")

    def close_at(shift: int) -> Column:
        cut = F.lit(None).cast("bigint")
        for p in dict.fromkeys(periods_ms):
            cut = F.when(F.col("period_ms") == p, F.lit(previous_period_ms(p, shift)).cast("bigint")).otherwise(cut)
        return F.coalesce(F.max_by("price", F.when(F.col("time_ms") <= F.col("bucket_ms") + cut, i)), F.lit(0.0))

    at_end = lambda c: F.max(F.when(i == last, F.col(c)))
    return {
        **{c: one(c) for c in ("num_trades", "open", "high", "low", "_first", "_last", "_mean_x", "_mean_log")},
        **{c: one(c) for c in ("_avg_x", "_avg_price", "_min_volume", "max_volume")},
        "close": at_end("price"),
        "trade_id": at_end("id"),
        "_last_volume": at_end("volume"),
        **{f"close_prev_period{s}": close_at(s) for s in range(3)},
        "ema_price": F.sum(ema_term),
        **powers(F.lit(1.0), w, {"_w1": 1, "_w2": 2, "_w3": 3, "_w4": 4}),
        **powers(w, price - F.col("mean_price"), {"_m2": 2, "_m3": 3, "_m4": 4}),
        **powers(F.lit(1.0), w - F.col("mean_volume"), {"_v2": 2, "_v3": 3, "_v4": 4}),
        "_sxx": F.sum(dx * dx),
        "_sxy": F.sum(dx * dy),
        "_syy": F.sum(dy * dy),
        "_mx": F.sum(w * dwx * dwx),
        "_slog": F.sum(co_moment),
    }


def weighted_moment_columns() -> dict[str, Column]:
    """Weighted std, skewness and excess kurtosis of price with reliability weights.

    Needs the power sums ``_w1.._w4`` of the weights and ``_m2.._m4`` of the deviations.
    """
    w1, w2, w3, w4, m2, m3, m4 = (F.col(f"_{c}") for c in "w1 w2 w3 w4 m2 m3 m4".split())
    n, flat = F.col("num_trades"), F.col("high") == F.col("low")
    d = w1 - safe_divide(w2, w1)
    variance = safe_divide(m2, d)
    p2, p4 = w1 * w1, w1 * w1 * w1 * w1
    s = safe_divide(w1 * (p2 - 3 * w2) + 2 * w3, p2)
    skewness = safe_divide(m3, s * F.pow(variance, F.lit(1.5)))
    poly = p4 - 6 * p2 * w2 + 8 * w1 * w3 + 3 * w2 * w2 - 6 * w4
    a = p4 - 4 * w1 * w3 + 3 * w2 * w2
    b = 3 * (p4 - 2 * p2 * w2 + 4 * w1 * w3 - 3 * w2 * w2)
    kurtosis = (safe_divide(a * w1 * m4, m2 * m2) - b) * safe_divide(d, w1 * poly)
    zero = F.lit(0.0)
    return {
        "std_price": F.when((n < 2) | flat, zero).otherwise(nan_to_num(F.sqrt(variance))),
        "skewness_price": F.when((n < 3) | flat, zero).otherwise(nan_to_num(skewness)),
        "kurtosis_price": F.when((n < 4) | flat, zero).otherwise(nan_to_num(kurtosis)),
    }


def volume_moment_columns() -> dict[str, Column]:
    """Sample std and unbiased skewness and excess kurtosis of volume, from ``_v2.._v4``."""
    n = F.col("num_trades").cast("double")
    v2, v3, v4 = (F.col(f"_{c}") for c in "v2 v3 v4".split())
    flat = F.col("max_volume") == F.col("_min_volume")
    g1 = safe_divide(v3 / n, F.pow(v2 / n, F.lit(1.5)))
    g2 = safe_divide(v4 / n, (v2 / n) * (v2 / n)) - 3
    zero = F.lit(0.0)
    return {
        "std_volume": F.when((n < 2) | flat, zero).otherwise(F.sqrt(safe_divide(v2, n - 1))),
        "skewness_volume": F.when((n < 3) | flat, zero).otherwise(
            nan_to_num(g1 * safe_divide(F.sqrt(n * (n - 1)), n - 2))
        ),
        "kurtosis_volume": F.when((n < 4) | flat, zero).otherwise(
            nan_to_num(safe_divide((n - 1) * ((n + 1) * g2 + 6), (n - 2) * (n - 3)))
        ),
    }


def price_regression_columns() -> dict[str, Column]:
    """Least squares of price - open on seconds since the first trade.

    No slope when all times agree, nothing at all for a single trade.
    """
    several, spread = F.col("num_trades") >= 2, F.col("_last") > F.col("_first")
    slope = F.when(several & spread, nan_to_num(safe_divide(F.col("_sxy"), F.col("_sxx")))).otherwise(0.0)
    moves = several & spread & (F.col("high") > F.col("low"))
    correlation = safe_divide(F.col("_sxy"), F.sqrt(F.col("_sxx")) * F.sqrt(F.col("_syy")))
    return {
        "price_regression_slope": slope,
        "price_regression_intercept": F.when(
            several, F.col("_avg_price") - F.col("open") - slope * F.col("_avg_x")
        ).otherwise(0.0),
        "price_regression_correlation": F.when(moves, clamp(nan_to_num(correlation), -1.0, 1.0)).otherwise(0.0),
    }


def log_regression_columns(standard: bool = False) -> dict[str, Column]:
    """Volume-weighted regression of log2(price) on seconds; the slope is given as 2^slope."""
    several, spread = F.col("num_trades") >= 2, F.col("_last") > F.col("_first")
    variance = safe_divide(F.col("_mx"), F.col("_w1") - safe_divide(F.col("_w2"), F.col("_w1")))
    sxx = F.col("_mx") if standard else variance * (F.col("_w1") - F.col("_last_volume"))
    slope = F.when(several & spread, nan_to_num(safe_divide(F.col("_slog"), sxx))).otherwise(0.0)
    return {
        "price_log_regression_slope": F.pow(F.lit(2.0), slope),
        "price_log_regression_intercept": F.when(
            several, nan_to_num(F.col("_mean_log") - slope * F.col("_mean_x"))
        ).otherwise(0.0),
    }


# What the second pass adds to the first.
ORDERED_COLUMNS = """
close trade_id close_prev_period0 close_prev_period1 close_prev_period2 ema_price
std_price skewness_price kurtosis_price std_volume skewness_volume kurtosis_volume
price_regression_slope price_regression_intercept price_regression_correlation
price_log_regression_slope price_log_regression_intercept
""".split()


def finish(sums: DataFrame, standard_log_regression: bool, extra: Sequence[str] = ()) -> DataFrame:
    """Bar columns from the sums of the second pass."""
    columns = {
        **weighted_moment_columns(),
        **volume_moment_columns(),
        **price_regression_columns(),
        **log_regression_columns(standard_log_regression),
    }
    ready = sums.withColumns({"ema_price": nan_to_num("ema_price"), **columns})
    return ready.select(*GROUP, *ORDERED_COLUMNS, *extra)


# --- quantiles ------------------------------------------------------------------


def price_weight() -> Column:
    """Whole-number weight of a trade in the price quantiles, from its volume and the first price."""
    scale = F.exp(F.rint(F.log("open")) - 10)
    return F.least(F.greatest((F.col("volume") / scale).try_cast("bigint"), F.lit(1)), F.lit(MAX_PRICE_WEIGHT))


def _quantile_columns(
    quantiles: dict[str, tuple[str, float]], below: dict[str, Column], freq: dict[str, Column],
    total: dict[str, Column], value: dict[str, Column], applies: dict[str, Column],
) -> dict[str, Column]:
    """Aggregates that pick the two values around each quantile position, and the share between them."""
    out = {}
    for name, (kind, fraction) in quantiles.items():
        position = (total[kind] - 1) * F.lit(fraction)

        def at(index: Column) -> Column:
            hit = applies[kind] & (below[kind] <= index) & (index < below[kind] + freq[kind])
            return F.max(F.when(hit, value[kind]))

        out[f"_lo_{name}"] = at(F.floor(position))
        out[f"_hi_{name}"] = at(F.ceil(position))
        out[f"_f_{name}"] = F.max(F.when(applies[kind], position - F.floor(position)))
    return out


def _blend(name: str) -> Column:
    low, high, fraction = F.col(f"_lo_{name}"), F.col(f"_hi_{name}"), F.col(f"_f_{name}")
    return F.when(low == high, low).otherwise((1 - fraction) * low + fraction * high)


def weighted_quantiles(
    values: DataFrame, keys: Sequence[str], quantiles: dict[str, tuple[str, float]], tasks: int, rows_per_range: int | None = None
) -> DataFrame:
    """Exact interpolated quantiles of ``value`` repeated ``freq`` times, per key.

    ``values`` has ``keys``, ``kind``, ``value`` and ``freq``; ``quantiles`` maps an output
    column to ``(kind, fraction)``.  Equal values are combined before the shuffle, and
    the distinct values are ranked in ``tasks`` ranges, or in ranges of ``rows_per_range``.
    """
    part = [*keys, "kind"]
    distinct = in_ranges(values.groupBy(*part, "value").agg(F.sum("freq").alias("freq")), [*part, "value"], tasks, rows_per_range)
    ranked = running(distinct, part, ["value"], F.col("_range"), sums={"_below": F.col("freq")}, totals=True)
    kinds = {kind for kind, _ in quantiles.values()}
    every = lambda c: {k: F.col(c) for k in kinds}
    columns = _quantile_columns(
        quantiles, every("_below"), every("freq"), every("_below_total"), every("value"),
        {k: F.col("kind") == k for k in kinds},
    )
    found = ranked.groupBy(*keys).agg(*(c.alias(n) for n, c in columns.items()))
    return found.select(*keys, *(_blend(n).alias(n) for n in quantiles))


BAR_QUANTILES = {n: ("p", q) for n, q in PRICE_QUANTILES.items()} | {n: ("v", q) for n, q in VOLUME_QUANTILES.items()}


def bar_values(joined: DataFrame, weight: Column | None = None) -> DataFrame:
    """Prices (kind ``p``, by whole weights, or by ``weight``) and volumes (``v``, each once) of the trades of each bucket."""
    weight = price_weight() if weight is None else weight
    once = F.lit(1).cast(joined.select(weight.alias("w")).schema["w"].dataType)
    kinds = F.array(
        F.struct(F.lit("p").alias("kind"), F.col("price").alias("value"), weight.alias("freq")),
        F.struct(F.lit("v").alias("kind"), F.col("volume").alias("value"), once.alias("freq")),
    )
    return joined.select(*GROUP, F.inline(kinds))


def bar_quantiles(joined: DataFrame, tasks: int, rows_per_range: int | None = None) -> DataFrame:
    """Quantile columns of buckets of any size."""
    return weighted_quantiles(bar_values(joined), GROUP, BAR_QUANTILES, 2 * tasks, rows_per_range)


def bar_digests(rows: DataFrame, compression: int = COMPRESSION) -> DataFrame:
    """``(bucket, kind, digest)`` of bucketed trades: prices weighted by their volumes, and volumes.

    Digests are stored beside the bars; those of late trades are merged into them with :func:`refreshed_digests`,
    without the trades that were there before. The trades themselves are not shuffled.
    """
    return quantile_digests(bar_values(rows, F.col("volume")), [*GROUP, "kind"], weight="freq", compression=compression)


def refreshed_digests(stored: DataFrame, late: DataFrame, compression: int = COMPRESSION) -> DataFrame:
    """Stored digests with those of late trades: only buckets that have late trades are read and come back."""
    keys = [*GROUP, "kind"]
    touched = late.select(*keys).distinct()
    return merged_digests(stored.join(touched, keys, "left_semi").select(*keys, "digest").unionByName(late.select(*keys, "digest")), keys, compression)


def digest_columns(digests: DataFrame) -> DataFrame:
    """The quantile columns of the bars from their digests, one row a bucket."""
    of = lambda kind: F.max_by("digest", F.when(F.col("kind") == kind, 1))
    both = digests.groupBy(*GROUP).agg(of("p").alias("p"), of("v").alias("v"))
    return both.select(*GROUP, *(digest_quantile(F.col(kind), q).alias(name) for name, (kind, q) in BAR_QUANTILES.items()))


# --- the operator ---------------------------------------------------------------


def by_bucket(rows: DataFrame, n_rows: int) -> DataFrame:
    """Rows dealt by bucket to as many tasks as ``n_rows`` ask for, at least the session's own number; the windows take them as they lie.

    The number is fixed: left to the session, tasks would be joined by the bytes of what is moved, and their windows hold many times as much.
    """
    tasks = -(-n_rows // ROWS_PER_WINDOW)
    own = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(tasks, own), *GROUP) if tasks > 1 else rows


def _small_buckets(joined: DataFrame, periods_ms: Sequence[int], standard: bool) -> DataFrame:
    """Second pass where every bucket fits a task: one shuffle, one sort for the order of trades, and one aggregate.

    The aggregate holds the distinct prices and volumes of a bucket, with their weights, for its quantiles.
    """
    placed = trade_positions(joined.withColumn("_weight", price_weight()), one_chunk=True)
    columns = {
        **ordered_sums(periods_ms, standard),
        "_p": F.percentile("price", list(PRICE_QUANTILES.values()), F.col("_weight")),
        "_v": F.percentile("volume", list(VOLUME_QUANTILES.values())),
    }
    sums = placed.groupBy(*GROUP).agg(*(c.alias(n) for n, c in columns.items()))
    found = {n: F.col(c)[i] for c, names in (("_p", PRICE_QUANTILES), ("_v", VOLUME_QUANTILES)) for i, n in enumerate(names)}
    return finish(sums.withColumns(found), standard, list(BAR_QUANTILES))


def _large_buckets(joined: DataFrame, periods_ms: Sequence[int], standard: bool, n_rows: int, rows_per_chunk: int) -> DataFrame:
    """Second pass for buckets too large for a task: everything in ranges of the trades and of the values."""
    small = rows_per_chunk if rows_per_chunk < ROWS_PER_TASK else None
    tasks = 1 + n_rows // max(rows_per_chunk, ROWS_PER_TASK)
    placed = trade_positions(in_ranges(joined, [*GROUP, "time_ms", "id"], tasks, small), one_chunk=False)
    sums = placed.groupBy(*GROUP).agg(*(c.alias(n) for n, c in ordered_sums(periods_ms, standard).items()))
    return finish(sums, standard).join(bar_quantiles(joined, tasks, small), GROUP)


def trade_bars(
    trades: DataFrame,
    periods_ms: Sequence[int],
    offsets_ms: Sequence[int] | None = None,
    *,
    as_of_ms: int | None = None,
    dedupe: bool = True,
    standard_log_regression: bool = False,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Bars of trades ``(id, time_ms, market, price, volume, flag)`` for all periods in one job.

    The first pass is written to the shared folder, one record per bucket.  Buckets up to
    ``rows_per_chunk`` trades take plain windows, larger ones ranges; both give the same
    columns, and one plan holds both.
    ``as_of_ms`` leaves out buckets still open then.  Pass ``dedupe=False`` for a table
    whose ids are already unique: it saves a shuffle and a written table of all rows.
    """
    clean = scratch_table(trade_dedupe(trades)) if dedupe else trades
    rows = closed_only(bucketed(valid_trades(clean), periods_ms, offsets_ms), as_of_ms)
    return bars_of_rows(rows, periods_ms, standard_log_regression, rows_per_chunk)


def bars_of_rows(
    rows: DataFrame, periods_ms: Sequence[int], standard_log_regression: bool = False, rows_per_chunk: int = ROWS_PER_CHUNK
) -> DataFrame:
    """Bars of trades that are already unique, valid and bucketed."""
    summary = scratch_table(with_ema_span(bucket_summary(rows)))
    is_large = F.col("num_trades") > rows_per_chunk
    in_large, n_rows = (x or 0 for x in summary.agg(F.sum(F.when(is_large, F.col("num_trades"))), F.sum("num_trades")).first())
    small = summary.filter(~is_large)
    if in_large:  # their rows are not moved with the others
        joined = by_bucket(with_summary(rows, small), n_rows - in_large)
    else:
        joined = with_summary(by_bucket(rows, n_rows), small)
    second = _small_buckets(joined, periods_ms, standard_log_regression)
    if in_large:
        large = scratch_table(summary.filter(is_large))
        second = second.unionByName(_large_buckets(with_summary(rows, large), periods_ms, standard_log_regression, in_large, rows_per_chunk))
    bars = summary.withColumns({c: nan_to_num(c) for c in ("mean_price", "mean_volume", "max_volume")})
    out = bars.join(second, GROUP).withColumn("time_ms", F.col("bucket_ms"))
    return out.select("market", "period_ms", "offset_ms", *BAR_COLUMNS)


def simple_bars(
    trades: DataFrame, periods_ms: Sequence[int], offsets_ms: Sequence[int] | None = None, *, dedupe: bool = True
) -> DataFrame:
    """The bar columns that a single pass of hash aggregates can give."""
    clean = trade_dedupe(trades) if dedupe else trades
    rows = bucketed(valid_trades(clean), periods_ms, offsets_ms).withColumn("_ord", trade_order())
    columns = {**ohlc_columns(), **flow_columns(), **previous_close_columns(periods_ms)}
    return rows.groupBy(*GROUP).agg(*(c.alias(n) for n, c in columns.items()))


def stale_from(
    bars: DataFrame, trades: DataFrame, periods_ms: Sequence[int], offsets_ms: Sequence[int] | None = None
) -> DataFrame:
    """First stale bucket per market, period and offset: ``stale_ms``.

    A bucket with trades is stale when no bar is stored for it, or one whose ``trade_id`` is not
    that of its newest trade.  Buckets without trades are skipped.
    """
    rows = bucketed(trades, periods_ms, offsets_ms).withColumn("_ord", trade_order())
    newest = rows.groupBy(*GROUP).agg(F.max_by("id", "_ord").alias("_found"))
    return _first_unlike(newest, bars, "trade_id")


def changed_from(bars: DataFrame, rows: DataFrame) -> DataFrame:
    """First bucket per market, period and offset whose bar does not count its trades: ``stale_ms``.

    ``rows`` are all valid, bucketed trades of the buckets to be checked, from a table that only grows: then a bar of as many trades is one of
    the same trades, wherever in the bucket a late one falls.
    """
    return _first_unlike(rows.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("_found")), bars, "num_trades")


def _first_unlike(found: DataFrame, bars: DataFrame, column: str) -> DataFrame:
    stored = bars.select("market", "period_ms", "offset_ms", F.col("time_ms").alias("bucket_ms"), F.col(column).alias("_stored"))
    checked = found.join(stored, GROUP, "left")
    stale = ~F.col("_found").eqNullSafe(F.col("_stored"))
    return checked.filter(stale).groupBy("market", "period_ms", "offset_ms").agg(F.min("bucket_ms").alias("stale_ms"))


def refresh_stale_bars(
    bars: DataFrame, trades: DataFrame, periods_ms: Sequence[int], offsets_ms: Sequence[int] | None = None,
    *, as_of_ms: int | None = None, dedupe: bool = True, rows_per_chunk: int = ROWS_PER_CHUNK, stale: DataFrame | None = None,
) -> DataFrame:
    """Recomputed bars from the first stale bucket of each series on; nothing for series in order.

    ``stale`` may name these buckets, ``(market, period_ms, offset_ms, stale_ms)``: newest trades alone do not show that a
    trade has come late into the middle of a bucket.

    The last good bar before it is recomputed as well, for its trade count, and left out.
    """
    series = ["market", "period_ms", "offset_ms"]
    valid = valid_trades(trade_dedupe(trades) if dedupe else trades)
    first = stale_from(bars, valid, periods_ms, offsets_ms) if stale is None else stale
    before = bars.select(*series, "time_ms").join(first, series).filter(F.col("time_ms") < F.col("stale_ms"))
    before = before.groupBy(*series).agg(F.max("time_ms").alias("_from"))
    first = scratch_table(first.join(before, series, "left").withColumn("_from", F.coalesce("_from", "stale_ms")))
    rows = closed_only(bucketed(valid, periods_ms, offsets_ms), as_of_ms).join(first, series)
    again = rows.filter(F.col("bucket_ms") >= F.col("_from")).drop("stale_ms", "_from")
    fresh = bars_of_rows(again, periods_ms, rows_per_chunk=rows_per_chunk).join(first, series)
    return fresh.filter(F.col("time_ms") >= F.col("stale_ms")).drop("stale_ms", "_from")


def series_bounds(df: DataFrame, keys: Sequence[str], time_col: str = "time_ms") -> DataFrame:
    """First and last time per key, 0 where there is none."""
    zero = F.lit(0).cast("bigint")
    return df.groupBy(*keys).agg(
        F.coalesce(F.min(time_col), zero).alias("first_ms"), F.coalesce(F.max(time_col), zero).alias("last_ms")
    )
