"""Bars from stored segments: a late trade costs its segment and what follows in its bucket, not the series after it.

A bucket is cut into ``slices`` spans of time. Each span with trades has a record of what its trades add up to: counts, extremes,
central moments and co-moments about its own means, the affine map that its trades are for the moving average, and a quantile digest. Records of one bucket combine in
any grouping by shifting moments to the common mean, so a bar is an aggregate over at most ``slices`` records. Two things come from
before a segment: the weighted sums up to it, for the log regression, whose terms depend on all trades before; and the span of the
moving average, which is the trade count of the bucket before. So a new trade makes stale the segments of its bucket from its own on, and, if it changes the span of the next bucket, that one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.functions.scalars import clamp, is_buy, is_liquidation, nan_to_num, previous_period_ms, safe_divide
from tickloom.operators.bars import (
    BAR_COLUMNS, BAR_QUANTILES, GROUP, MIN_EMA_SPAN, ROWS_PER_CHUNK, bucketed, in_ranges, log_regression_columns,
    price_regression_columns, volume_moment_columns, weighted_moment_columns,
)
from tickloom.operators.digests import DIGEST, digest_quantile, merged_digests, quantile_digests
from tickloom.operators.filters import valid_trades
from tickloom.operators.prefix import running
from tickloom.session import scratch_table

SLICES = 16
SERIES = GROUP[:3]
SEGMENT = [*GROUP, "segment"]

#: What a segment record holds besides its key.
RECORD = """
n bigint, first_ms bigint, last_ms bigint, open double, close double, trade_id bigint, last_volume double, high double, low double, min_volume double, max_volume double,
w1 double, w2 double, w3 double, w4 double, buys bigint, buy_volume double, liquidation_volume double,
mean_price double, m2 double, m3 double, m4 double, mean_volume double, v2 double, v3 double, v4 double,
avg_x double, avg_price double, sxx double, sxy double, syy double, mean_x double, mx double, mean_log double, slog double,
alpha double, ema double, close0 double, close1 double, close2 double
""".replace("\n", " ").strip()
RECORD_SCHEMA = f"market string, period_ms bigint, offset_ms bigint, bucket_ms bigint, segment int, {RECORD}, p {DIGEST}, v {DIGEST}"
RECORD_COLUMNS = [x.split()[0] for x in RECORD.split(", ")]


def in_segments(trades: DataFrame, periods_ms: Sequence[int], offsets_ms: Sequence[int] | None = None, slices: int = SLICES) -> DataFrame:
    """Trades with their bucket of each period and the span of it that they lie in."""
    rows = bucketed(valid_trades(trades), periods_ms, offsets_ms)
    return rows.withColumn("segment", F.floor((F.col("time_ms") - F.col("bucket_ms")) * slices / F.col("period_ms")).cast("int"))


def _seconds() -> Column:
    return (F.col("time_ms") - F.col("bucket_ms")) / 1000.0


def _heads(rows: DataFrame) -> DataFrame:
    """First pass: what a segment's trades add up to without any mean."""
    w, p, x = F.col("volume"), F.col("price"), _seconds()
    total = F.sum(w)
    weighted = lambda c: safe_divide(F.sum(w * c), total)
    return rows.groupBy(*SEGMENT).agg(
        F.count(F.lit(1)).alias("n"), F.min("time_ms").alias("first_ms"), F.max("time_ms").alias("last_ms"), F.max(p).alias("high"), F.min(p).alias("low"),
        F.min(w).alias("min_volume"), F.max(w).alias("max_volume"), *(F.sum(F.pow(w, F.lit(k))).alias(f"w{k}") for k in (1, 2, 3, 4)),
        F.count_if(is_buy("flag")).alias("buys"), F.sum(F.when(is_buy("flag"), w).otherwise(0.0)).alias("buy_volume"),
        F.sum(F.when(is_liquidation("flag"), w).otherwise(0.0)).alias("liquidation_volume"),
        weighted(p).alias("mean_price"), F.avg(w).alias("mean_volume"), F.avg(x).alias("avg_x"), F.avg(p).alias("avg_price"), weighted(x).alias("mean_x"), weighted(F.log2(p)).alias("mean_log"),
    )


def _with_past(heads: DataFrame) -> DataFrame:
    """Heads of all segments of some series with what comes from before: sums up to the segment, and the step of the moving average."""
    earlier = Window.partitionBy(*GROUP).orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    sums = {"_n": F.col("n"), "_w": F.col("w1"), "_wx": F.col("w1") * F.col("mean_x"), "_wy": F.col("w1") * F.col("mean_log")}
    counts = heads.groupBy(*GROUP).agg(F.sum("n").alias("_count"))
    span = F.greatest(F.coalesce(F.lag("_count").over(Window.partitionBy(*SERIES).orderBy("bucket_ms")), F.lit(0)), F.lit(MIN_EMA_SPAN))
    alphas = counts.select(*GROUP, (F.lit(2.0) / (span + 1)).alias("alpha"))
    return heads.join(alphas, GROUP).withColumns({n: F.coalesce(F.sum(c).over(earlier), F.lit(0)) for n, c in sums.items()})


def _records(rows: DataFrame, heads: DataFrame, periods_ms: Sequence[int], rows_per_chunk: int) -> DataFrame:
    """Second pass over the trades of some segments; ``heads`` are theirs, with their past."""
    joined = rows.join(heads, SEGMENT).withColumns({"_x": _seconds(), "_y": F.log2("price")})
    one_chunk = (heads.agg(F.max("n")).first()[0] or 0) <= rows_per_chunk
    if not one_chunk:
        joined = in_ranges(joined, [*SEGMENT, "time_ms", "id"], 1 + (heads.agg(F.sum("n")).first()[0] // rows_per_chunk))
    w, x, y, price, alpha, i = (F.col(c) for c in ("volume", "_x", "_y", "price", "alpha", "_i"))
    placed = running(
        joined, SEGMENT, ["time_ms", "id"], F.lit(0) if one_chunk else F.col("_range"), one_chunk=one_chunk,
        sums={"_i": F.lit(1), "_pw": w, "_pwx": w * x, "_pwy": w * y},
    )
    last = F.col("n") - 1
    before = F.col("_w") + F.col("_pw")
    term = (safe_divide(F.col("_wx") + F.col("_pwx"), before) - x) * (safe_divide(F.col("_wy") + F.col("_pwy"), before) - y) * before / (before + w)
    keep = F.pow(1 - alpha, (last - i).cast("double"))
    # the first trade of a bucket is the whole average, later ones an alpha of it
    ema = price * keep * F.when((i == 0) & (F.col("_n") == 0), F.lit(1.0)).otherwise(alpha)
    dp, dv, dx, da, dwx = price - F.col("mean_price"), w - F.col("mean_volume"), x - F.col("avg_x"), price - F.col("avg_price"), x - F.col("mean_x")

    def close_at(shift: int) -> Column:
        cut = F.lit(None).cast("bigint")
        for p in dict.fromkeys(periods_ms):
            cut = F.when(F.col("period_ms") == p, F.lit(previous_period_ms(p, shift)).cast("bigint")).otherwise(cut)
        return F.max_by("price", F.when(F.col("time_ms") <= F.col("bucket_ms") + cut, i))

    at = lambda place, c: F.max(F.when(i == place, F.col(c)))
    known = [c for c in RECORD_COLUMNS if c in heads.columns]
    sums = {
        "open": at(0, "price"), "close": at(last, "price"), "trade_id": at(last, "id"), "last_volume": at(last, "volume"),
        **{f"m{k}": F.sum(w * F.pow(dp, F.lit(k))) for k in (2, 3, 4)}, **{f"v{k}": F.sum(F.pow(dv, F.lit(k))) for k in (2, 3, 4)},
        "sxx": F.sum(dx * dx), "sxy": F.sum(dx * da), "syy": F.sum(da * da), "mx": F.sum(w * dwx * dwx),
        "slog": F.sum(F.when(before > 0, term).otherwise(0.0)), "ema": F.sum(ema), **{f"close{s}": close_at(s) for s in range(3)},
    }
    found = placed.groupBy(*SEGMENT).agg(*(F.max(c).alias(c) for c in known), *(c.alias(n) for n, c in sums.items()))
    digests = quantile_digests(bar_values_of_segments(rows), [*SEGMENT, "kind"], weight="freq")
    of = lambda kind: F.max_by("digest", F.when(F.col("kind") == kind, 1)).alias(kind)
    both = digests.groupBy(*SEGMENT).agg(of("p"), of("v"))
    return found.join(both, SEGMENT).select(*SEGMENT, *RECORD_COLUMNS, "p", "v")


def bar_values_of_segments(rows: DataFrame) -> DataFrame:
    """Prices by volume and volumes of the trades of each segment, as :func:`tickloom.operators.bars.bar_values`."""
    kinds = F.array(
        F.struct(F.lit("p").alias("kind"), F.col("price").alias("value"), F.col("volume").alias("freq")),
        F.struct(F.lit("v").alias("kind"), F.col("volume").alias("value"), F.lit(1.0).alias("freq")),
    )
    return rows.select(*SEGMENT, F.inline(kinds))


def segment_records(trades: DataFrame, periods_ms: Sequence[int], offsets_ms: Sequence[int] | None = None, slices: int = SLICES, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Records of all segments of trades whose ids are unique."""
    rows = in_segments(trades, periods_ms, offsets_ms, slices)
    return _records(rows, scratch_table(_with_past(_heads(rows))), periods_ms, rows_per_chunk)


HEAD_COLUMNS = ["n", "w1", "mean_x", "mean_log"]


def stale_segments(stored: DataFrame, touched: DataFrame) -> DataFrame:
    """``(bucket, from_segment)``: where trades must be read again once ``touched`` segments have new ones.

    Each touched bucket from its first touched segment on, and the bucket after it as a whole, for the span of its moving average.
    """
    first = touched.groupBy(*GROUP).agg(F.min("segment").alias("from_segment"))
    buckets = stored.select(*GROUP).unionByName(first.select(*GROUP)).distinct()
    after = buckets.withColumn("_next", F.lead("bucket_ms").over(Window.partitionBy(*SERIES).orderBy("bucket_ms")))
    following = after.join(first.select(*GROUP), GROUP, "left_semi").where("_next IS NOT NULL").select(*SERIES, F.col("_next").alias("bucket_ms"), F.lit(0).alias("from_segment"))
    return first.unionByName(following).groupBy(*GROUP).agg(F.min("from_segment").alias("from_segment"))


def refreshed_records(stored: DataFrame, rows: DataFrame, stale: DataFrame, periods_ms: Sequence[int], rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """New records of stale segments. ``rows`` are their trades alone, from :func:`in_segments`; of all other segments the stored records tell what is needed."""
    fresh = scratch_table(_heads(rows))
    good = stored.join(stale, GROUP, "left").where("from_segment IS NULL OR segment < from_segment")
    columns = [*SEGMENT, *HEAD_COLUMNS]
    past = _with_past(good.select(*columns).unionByName(fresh.select(*columns)))
    heads = fresh.join(past.select(*SEGMENT, "alpha", "_n", "_w", "_wx", "_wy"), SEGMENT)
    return _records(rows, scratch_table(heads), periods_ms, rows_per_chunk)


def bars_of_segments(records: DataFrame) -> DataFrame:
    """All bar columns from segment records; quantiles come from digests, the others are exact."""
    n, w = F.col("n"), F.col("w1")
    bucket = Window.partitionBy(*GROUP)
    total = lambda c: F.sum(c).over(bucket)
    mean = lambda weight, c: safe_divide(total(weight * F.col(c)), total(weight))
    later = bucket.orderBy(F.desc("segment")).rowsBetween(Window.unboundedPreceding, -1)
    rows = records.drop("p", "v").withColumns(
        {
            "_after": F.coalesce(F.sum(n).over(later), F.lit(0)), "_p": mean(w, "mean_price"), "_v": mean(n, "mean_volume"), "_ax": mean(n, "avg_x"),
            "_ap": mean(n, "avg_price"), "_xw": mean(w, "mean_x"), "_l": mean(w, "mean_log"),
        }
    )

    def shifted(weight: Column, mean: str, to: str, second: str, third: str, fourth: str) -> list[Column]:
        d = F.col(mean) - F.col(to)
        a, b, c = F.col(second), F.col(third), F.col(fourth)
        return [F.sum(a + d * d * weight), F.sum(b + 3 * d * a + d * d * d * weight), F.sum(c + 4 * d * b + 6 * d * d * a + d * d * d * d * weight)]

    dx, da, dw = F.col("avg_x") - F.col("_ax"), F.col("avg_price") - F.col("_ap"), F.col("mean_x") - F.col("_xw")
    share = lambda c: F.when(F.sum(w) > 0, safe_divide(F.sum(c), F.sum(w))).otherwise(0.5)
    first, last = (lambda c: F.min_by(c, "segment")), (lambda c: F.max_by(c, "segment"))
    moments = zip(("_m2", "_m3", "_m4", "_v2", "_v3", "_v4"), [*shifted(w, "mean_price", "_p", "m2", "m3", "m4"), *shifted(n, "mean_volume", "_v", "v2", "v3", "v4")])
    one = F.max
    columns = {
        "num_trades": F.sum(n), "open": first("open"), "close": last("close"), "trade_id": last("trade_id"), "_last_volume": last("last_volume"), "high": F.max("high"), "low": F.min("low"),
        "_min_volume": F.min("min_volume"), "max_volume": F.max("max_volume"), "_first": F.min("first_ms"), "_last": F.max("last_ms"), **{f"_w{k}": F.sum(f"w{k}") for k in (1, 2, 3, 4)},
        "volume": F.sum(w), "mean_price": one("_p"), "mean_volume": one("_v"), "_avg_x": one("_ax"), "_avg_price": one("_ap"), "_mean_x": one("_xw"), "_mean_log": one("_l"), **dict(moments),
        "_sxx": F.sum(F.col("sxx") + n * dx * dx), "_sxy": F.sum(F.col("sxy") + n * dx * da), "_syy": F.sum(F.col("syy") + n * da * da), "_mx": F.sum(F.col("mx") + w * dw * dw),
        "_slog": F.sum("slog"), "ema_price": F.sum(F.col("ema") * F.pow(1 - F.col("alpha"), F.col("_after").cast("double"))),
        "buy_ratio": clamp(F.sum("buys") / F.sum(n).cast("double"), 0.0, 1.0), "buy_volume_ratio": clamp(share("buy_volume"), 0.0, 1.0), "liquidation_volume_ratio": clamp(share("liquidation_volume"), 0.0, 1.0),
        **{f"close_prev_period{s}": F.coalesce(F.max_by(f"close{s}", F.when(F.col(f"close{s}").isNotNull(), F.col("segment"))), F.lit(0.0)) for s in range(3)},
    }
    sums = rows.groupBy(*GROUP).agg(*(c.alias(name) for name, c in columns.items()))
    # the regressions count time from the first trade
    start = (F.col("_first") - F.col("bucket_ms")) / 1000.0
    sums = sums.withColumns({"_avg_x": F.col("_avg_x") - start, "_mean_x": F.col("_mean_x") - start})
    done = sums.withColumns({**weighted_moment_columns(), **volume_moment_columns(), **price_regression_columns(), **log_regression_columns()})
    done = done.withColumns({c: nan_to_num(c) for c in ("mean_price", "mean_volume", "max_volume", "ema_price")})
    kinds = F.array(F.struct(F.lit("p").alias("kind"), F.col("p").alias("digest")), F.struct(F.lit("v").alias("kind"), F.col("v").alias("digest")))
    digests = merged_digests(records.select(*GROUP, F.inline(kinds)), [*GROUP, "kind"])
    of = lambda kind: F.max_by("digest", F.when(F.col("kind") == kind, 1)).alias(f"_d{kind}")
    both = digests.groupBy(*GROUP).agg(of("p"), of("v"))
    done = done.join(both, GROUP).withColumns({name: digest_quantile(F.col(f"_d{kind}"), q) for name, (kind, q) in BAR_QUANTILES.items()})
    return done.withColumn("time_ms", F.col("bucket_ms")).select(*SERIES, *BAR_COLUMNS)


def segment_refresher(
    trade_path: str, segment_path: str, bar_path: str, periods_ms: Sequence[int], offsets_ms: Sequence[int] | None = None, slices: int = SLICES,
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: store a batch's new trades, then renew the segments and bars that they make stale.

    Trades are read again only for stale segments, and only on their dates. A repeated batch changes nothing: its trades are
    known, and its segments and bars come out the same.
    """
    from tickloom.sinks.tables import append_trades, put_rows, read_rows, write_bars

    def on_batch(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        append_trades(batch, trade_path)
        touched = scratch_table(in_segments(batch, periods_ms, offsets_ms, slices).select(*SEGMENT).distinct())
        stored = read_rows(spark, segment_path, RECORD_SCHEMA)
        stale = scratch_table(stale_segments(stored, touched))
        rows = stale_trades(spark.read.parquet(trade_path), stale, periods_ms, offsets_ms, slices)
        fresh = refreshed_records(stored, rows, stale, periods_ms)
        put_rows(fresh, segment_path, SEGMENT, "bucket_ms")
        records = read_rows(spark, segment_path, RECORD_SCHEMA).join(stale.select(*GROUP), GROUP, "left_semi")
        write_bars(bars_of_segments(records), bar_path)

    return on_batch


def stale_trades(stored: DataFrame, stale: DataFrame, periods_ms: Sequence[int], offsets_ms: Sequence[int] | None = None, slices: int = SLICES) -> DataFrame:
    """The trades of stale segments, from a table of trades by date; other dates are not read."""
    day = 86_400_000
    begin = F.col("bucket_ms") + F.floor(F.col("from_segment") * F.col("period_ms") / slices)
    days = stale.select(F.explode(F.sequence(F.floor(begin / day), F.floor((F.col("bucket_ms") + F.col("period_ms") - 1) / day))).alias("d")).distinct()
    dates = days.select(F.date_from_unix_date(F.col("d").cast("int")).alias("date"))  # as many as the series has days
    near = stored.join(F.broadcast(dates), "date", "left_semi").drop("date")
    rows = in_segments(near, periods_ms, offsets_ms, slices)
    return rows.join(stale, GROUP).where("segment >= from_segment").drop("from_segment")
