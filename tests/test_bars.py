import math

import pandas as pd
from pyspark.sql import functions as F

from tickloom.operators import bars as B
from tickloom.operators.prefix import each_step, running

MINUTE = 60_000
SCHEMA = "id bigint, time_ms bigint, market string, price double, volume double, flag smallint"


def trades(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def skewed(spark, n=4000):
    """One bucket with nearly all trades, many equal times and prices."""
    return spark.range(n).select(
        "id", (F.lit(600_000) + (F.col("id") * 7919 % 997) * 50).alias("time_ms"), F.lit("m").alias("market"),
        (F.col("id") * 31 % 101 + 1).cast("double").alias("price"), (F.col("id") * 17 % 13 + 1).cast("double").alias("volume"),
        (F.col("id") % 3 + 1).cast("smallint").alias("flag"),
    ).unionByName(trades(spark, [(10**6, 5, "m", 3.0, 1.0, 1)]))


def test_chunked_and_plain_agree_on_a_hot_bucket(spark):
    rows = skewed(spark)
    key = lambda r: (r["market"], r["time_ms"])
    plain = sorted(B.trade_bars(rows, [10 * MINUTE]).collect(), key=key)
    chunked = sorted(B.trade_bars(rows, [10 * MINUTE], rows_per_chunk=100).collect(), key=key)
    assert len(plain) == len(chunked) == 2
    for a, b in zip(plain, chunked):
        for c in a.asDict():
            if isinstance(a[c], float):
                assert math.isclose(a[c], b[c], rel_tol=1e-9, abs_tol=1e-9), c
            else:
                assert a[c] == b[c], c


def test_single_trade_and_flat_price(spark):
    bar = B.trade_bars(trades(spark, [(1, 100, "m", 5.0, 2.0, 1)]), [MINUTE]).first()
    assert (bar.open, bar.close, bar.volume, bar.ema_price) == (5.0, 5.0, 2.0, 5.0)
    assert bar.std_price == bar.price_regression_slope == bar.price_log_regression_intercept == 0.0
    assert bar.price_log_regression_slope == 1.0 and bar.trade_id == 1
    flat = B.trade_bars(trades(spark, [(i, 100 * i, "m", 5.0, 2.0, 2) for i in range(1, 6)]), [MINUTE]).first()
    assert flat.kurtosis_price == flat.skewness_volume == 0.0 and flat.buy_ratio == 0.0


def test_order_against_a_plain_loop(spark):
    rows = [(i, 1000 + (i * 37 % 11) * 100, "m", 1.0 + i % 7, 1.0 + i % 3, 1) for i in range(50)]
    bar = B.trade_bars(trades(spark, rows), [MINUTE], rows_per_chunk=7).first()
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    alpha, ema = 2 / 24, ordered[0][3]
    sxy = w_sum = wx = wy = 0.0
    for _, t, _, p, w, _ in ordered:
        ema = ema * (1 - alpha) + p * alpha
        x, y = (t - ordered[0][1]) / 1000, math.log2(p)
        if w_sum:
            sxy += (wx / w_sum - x) * (wy / w_sum - y) * w_sum / (w_sum + w)
        w_sum, wx, wy = w_sum + w, wx + w * x, wy + w * y
    mean = wx / w_sum
    m2 = sum(w * ((t - ordered[0][1]) / 1000 - mean) ** 2 for _, t, _, _, w, _ in ordered)
    d = w_sum - sum(r[4] ** 2 for r in ordered) / w_sum
    slope = sxy / (m2 / d * (w_sum - ordered[-1][4]))
    assert math.isclose(bar.ema_price, ema) and math.isclose(bar.price_log_regression_slope, 2**slope)
    assert (bar.open, bar.close, bar.trade_id) == (ordered[0][3], ordered[-1][3], ordered[-1][0])
    assert bar.low <= min(bar.open, bar.close) <= max(bar.open, bar.close) <= bar.high


def test_duplicates_collapse(spark):
    rows = [(1, 100, "m", 5.0, 2.0, 1)] * 1000 + [(1, 90, "m", 6.0, 1.0, 1), (2, 120, "m", -1.0, 1.0, 1)]
    bar = B.trade_bars(trades(spark, rows), [MINUTE]).first()
    assert (bar.num_trades, bar.open, bar.volume) == (1, 6.0, 1.0)


def test_refresh_is_idle_when_current(spark):
    rows = skewed(spark, 200)
    stored = B.trade_bars(rows, [MINUTE])
    assert B.refresh_stale_bars(stored, rows, [MINUTE]).count() == 0


def test_running_matches_a_loop(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), "id", (F.col("id") * 7 % 11).alias("v"))
    out = running(df, ["k"], ["id"], F.floor(F.col("id") / 40), sums={"s": F.col("v")}, maxes={"m": F.col("v")},
                  lasts={"l": F.when(F.col("v") > 5, F.col("v"))}, totals=True)
    seen = {}
    for r in sorted(out.collect(), key=lambda r: r.id):
        s, m, last = seen.get(r.k, (0, None, None))
        assert (r.s, r.m, r.l) == (s, m, last)
        seen[r.k] = (s + r.v, r.v if m is None else max(m, r.v), r.v if r.v > 5 else last)
    assert {r.k: r.s_total for r in out.collect()} == {k: v[0] for k, v in seen.items()}


def test_ranges_follow_the_rows(spark):
    """A long tail of volumes and a burst in time: no range holds twice its share."""
    n, tasks = 20_000, 20
    rows = spark.range(n).select(
        F.lit("m").alias("market"), "id", F.when(F.col("id") < n - 5, F.col("id") % 50).otherwise(F.col("id") * 10**6).alias("time_ms"),
        F.when(F.col("id") == 0, 1e12).otherwise(F.rand(3)).alias("volume"),
    ).repartition(8)
    for order in (["market", "time_ms", "id"], ["market", "volume", "id"]):
        cut = B.in_ranges(rows, order, tasks)
        sizes = cut.groupBy("_range").agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("lo"), F.max(F.struct(*order)).alias("hi"))
        found = sorted(sizes.collect(), key=lambda r: r["_range"])
        assert max(r.n for r in found) <= 2 * n / tasks and sum(r.n for r in found) == n
        assert all(a.hi < b.lo for a, b in zip(found, found[1:]))


def test_small_ranges_share_a_task(spark, monkeypatch):
    """Ranges of five trades: their number grows with the trades, that of the tasks doesn't."""
    n, tasks, cut = 2_000, [], B.in_ranges

    def noted(rows, order, number, *rest):
        tasks.append(number)
        return cut(rows, order, number, *rest)

    monkeypatch.setattr(B, "in_ranges", noted)
    trades = spark.range(n).select(
        "id", ((F.col("id") * 7919) % 1000).alias("time_ms"), F.lit("m").alias("market"),
        (100 + F.col("id") % 13).cast("double").alias("price"), (1 + F.col("id") % 7).cast("double").alias("volume"), F.lit(1).cast("smallint").alias("flag"),
    )
    small = B.trade_bars(trades, [100], rows_per_chunk=5).toPandas().sort_values("time_ms", ignore_index=True)
    assert len(small) == 10 and max(tasks) <= 2
    pd.testing.assert_frame_equal(small, B.trade_bars(trades, [100]).toPandas().sort_values("time_ms", ignore_index=True), rtol=1e-9)
    ranges = cut(trades, ["time_ms", "id"], 2, 5)
    sizes = ranges.groupBy("_range").agg(F.count("*").alias("n"), F.min(F.struct("time_ms", "id")).alias("lo"), F.max(F.struct("time_ms", "id")).alias("hi"))
    found = sorted(sizes.collect(), key=lambda r: r["_range"])
    assert max(r.n for r in found) == 5 and sum(r.n for r in found) == n and len(found) <= n / 5 + 2
    assert all(a.hi < b.lo for a, b in zip(found, found[1:]))


def test_steps_in_blocks(spark):
    spans = spark.createDataFrame([("a", 0, 95), ("b", 7, 7), ("c", 5, 4)], "k string, lo bigint, hi bigint")
    for spread in (False, True):
        out = each_step(spans, F.col("lo"), F.col("hi"), 5, "t", spread=spread, per_row=3)
        assert sorted((r.k, r.t) for r in out.collect()) == [("a", t) for t in range(0, 96, 5)] + [("b", 7)]


def test_windows_hold_a_bounded_number_of_rows(spark, monkeypatch):
    """Tasks go by measured rows, whatever the session would join; the bars are the same, also beside large buckets."""
    from pyspark.sql import functions as F

    from tickloom.operators import bars as B

    trades = spark.range(4000).select(
        "id", (F.col("id") * 37 % 86_400_000).alias("time_ms"), F.concat(F.lit("m"), (F.col("id") % 40).cast("string")).alias("market"),
        (1.0 + F.col("id") % 17).alias("price"), (1.0 + F.col("id") % 5).alias("volume"), (F.col("id") % 4).cast("smallint").alias("flag"),
    ).unionByName(spark.range(4000, 4900).selectExpr("id", "id AS time_ms", "'busy' AS market", "2.0D + id % 3 AS price", "1.0D AS volume", "1S AS flag"))
    seen = []
    windows = B._small_buckets
    monkeypatch.setattr(B, "_small_buckets", lambda joined, *a: seen.append(joined) or windows(joined, *a))
    run = lambda n=B.ROWS_PER_CHUNK: sorted(str(r) for r in B.trade_bars(trades, [86_400_000], rows_per_chunk=n).collect())
    plain = run()
    monkeypatch.setattr(B, "ROWS_PER_WINDOW", 100)
    assert run() == plain and len(plain) == 41
    assert [str(x).split()[0] for x in run(500)] == [x.split()[0] for x in plain]
    dealt = [x.rdd.getNumPartitions() for x in seen[1:]]
    assert dealt == [49, 40]
