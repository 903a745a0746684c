"""Bars kept current by recomputing stale ones: what is recomputed, and what a failed batch leaves."""

import os

import pandas as pd
import pytest

from tickloom.operators import bars as B
from tickloom.sinks import tables as T
from tickloom.streaming import streams as Z

SCHEMA = "id bigint, time_ms bigint, market string, price double, volume double, flag smallint"
DAY, HOUR = 86_400_000, 3_600_000
PERIODS = [6 * HOUR, DAY]


def rows(first, last, market="m", step=HOUR):
    return [(i, i * step, market, 1.0 + i * 7 % 11, 1.0 + i * 5 % 3, 1 + i % 2) for i in range(first, last)]


def files(path):
    return sorted(f"{at}/{x}" for at, _, names in os.walk(path) for x in names if x.endswith(".parquet"))


def same_as_all(spark, path, trades):
    order = ["market", "period_ms", "time_ms"]
    got = T.read_bars(spark, path).toPandas().sort_values(order, ignore_index=True)
    want = B.trade_bars(spark.createDataFrame(trades, SCHEMA), PERIODS).toPandas().sort_values(order, ignore_index=True)
    pd.testing.assert_frame_equal(got, want, rtol=1e-9)


@pytest.fixture
def begun(monkeypatch):
    """Notes from which time on bars are recomputed."""
    seen, plain = [], B.refresh_stale_bars

    def noted(*args, **named):
        seen.append(named["stale"].agg({"stale_ms": "min"}).first()[0])
        return plain(*args, **named)

    monkeypatch.setattr(B, "refresh_stale_bars", noted)
    return seen


def test_copies_make_nothing_stale(spark, tmp_path, begun):
    refresh = Z.bar_refresher(f"{tmp_path}/trades", f"{tmp_path}/bars", PERIODS)
    refresh(spark.createDataFrame(rows(0, 80), SCHEMA), 0)
    before = files(f"{tmp_path}/bars")
    refresh(spark.createDataFrame(rows(0, 80)[::3], SCHEMA), 1)
    assert begun == [0] and files(f"{tmp_path}/bars") == before
    refresh(spark.createDataFrame(rows(0, 5) + rows(80, 90), SCHEMA), 2)  # copies from the first day on beside new trades
    assert begun == [0, 3 * DAY]
    same_as_all(spark, f"{tmp_path}/bars", rows(0, 90))


def test_late_trades_amid_a_bucket_and_a_new_bucket_between(spark, tmp_path, begun):
    refresh = Z.bar_refresher(f"{tmp_path}/trades", f"{tmp_path}/bars", PERIODS)
    trades = [r for r in rows(0, 120) + rows(0, 120, "n") if r[0] // 6 != 9]
    late = [r for r in rows(0, 120) if r[0] // 6 == 9] + [(500, 2 * DAY + 8 * HOUR + 1, "n", 3.0, 2.0, 1), (501, 5, "n", -1.0, 2.0, 1)]
    refresh(spark.createDataFrame(trades, SCHEMA), 0)
    refresh(spark.createDataFrame(late, SCHEMA), 1)
    assert begun == [0, 2 * DAY]  # the invalid trade of the first day changes no bar
    same_as_all(spark, f"{tmp_path}/bars", trades + late)


def test_a_failed_batch_is_made_good(spark, tmp_path, monkeypatch):
    refresher = lambda: Z.bar_refresher(f"{tmp_path}/trades", f"{tmp_path}/bars", PERIODS)
    trades, late = [r for r in rows(0, 900, step=HOUR // 10) if not 400 <= r[0] < 480], rows(400, 480, step=HOUR // 10)
    refresher()(spark.createDataFrame(trades, SCHEMA), 0)
    plain = T.write_bars

    def failing(bars, path):  # the bars of the next date keep their number of trades, but their moving average depends on these
        plain(bars.filter(f"time_ms < {2 * DAY}"), path)
        raise OSError("disk")

    monkeypatch.setattr(T, "write_bars", failing)
    with pytest.raises(OSError):
        refresher()(spark.createDataFrame(late, SCHEMA), 1)
    monkeypatch.setattr(T, "write_bars", plain)
    refresher()(spark.createDataFrame(late, SCHEMA), 1)
    same_as_all(spark, f"{tmp_path}/bars", trades + late)
    assert os.listdir(f"{tmp_path}/bars-stale") == []


def test_trades_stored_by_another_are_not_missed(spark, tmp_path):
    batch = spark.createDataFrame(rows(0, 30), SCHEMA)
    T.append_trades(batch, f"{tmp_path}/trades")
    Z.bar_refresher(f"{tmp_path}/trades", f"{tmp_path}/bars", PERIODS)(batch, 0)
    same_as_all(spark, f"{tmp_path}/bars", rows(0, 30))


def test_small_buckets_are_sorted_once(spark):
    """One order of trades; quantiles come from the aggregate, also of few, equal and undefined values."""
    trades = spark.createDataFrame(rows(0, 40) + [(90, 50 * DAY, "m", 2.0, 1.0, 1), (91, 60 * DAY, "m", float("nan"), 1.0, 1), (92, 60 * DAY + 1, "m", 1.0, 2.0, 1)], SCHEMA)
    summary = B.with_ema_span(B.bucket_summary(B.bucketed(trades, PERIODS)))
    small = B._small_buckets(B.with_summary(B.bucketed(trades, PERIODS), summary), PERIODS, False)
    plan = small._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") <= 2  # the span of the bucket before, the order of trades
    plain = B.trade_bars(trades, PERIODS).toPandas().sort_values(["period_ms", "time_ms"], ignore_index=True)
    ranges = B.trade_bars(trades, PERIODS, rows_per_chunk=3).toPandas().sort_values(["period_ms", "time_ms"], ignore_index=True)
    names = ["time_ms", *B.BAR_QUANTILES]
    pd.testing.assert_frame_equal(plain[names], ranges[names], rtol=1e-9)
