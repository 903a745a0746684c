"""Bars from segments: what a late trade makes stale, and equality with bars computed at once."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_digests import rank_error

from tickloom.operators import bars as B
from tickloom.operators import segments as S

TRADES = "id long, time_ms long, market string, price double, volume double, flag short"
HOUR = 3_600_000
PERIODS, OFFSETS = [HOUR, 4 * HOUR], [0, HOUR]
SHORT, SHIFTS = [600_000, 1_800_000], [0, 600_000]


@pytest.fixture(scope="module")
def trades():
    rng = random.Random(8)
    rows = []
    for market in ("a", "b"):
        t, p = 1_700_000_000_000, 100.0
        for i in range(1500):
            t += rng.choice([0, 1, 1000, 20_000, 90_000, 3_000_000 if rng.random() < 0.02 else 5])
            p = max(1.0, p + rng.gauss(0, 1))
            rows.append((i, t, market, round(p, 2), rng.choice([1.0, 2.5, 40.0, 900.0]), rng.choice([1, 2, 5, 6])))
    return rows


class Near(float):
    """A number that equals others up to rounding."""

    def __eq__(self, other):
        return math.isclose(self, other, rel_tol=1e-6, abs_tol=1e-6)

    def __ne__(self, other):
        return not self == other


def exact(df):
    columns = [c for c in df.columns if c not in B.BAR_QUANTILES]
    rows = sorted(map(tuple, df.select(*columns).collect()), key=lambda r: r[:4])
    return [tuple(Near(x) if isinstance(x, float) else x for x in r) for r in rows]


@pytest.mark.parametrize("rows_per_chunk", [B.ROWS_PER_CHUNK, 40])
def test_bars_of_segments(spark, trades, rows_per_chunk):
    table = spark.createDataFrame(trades, TRADES).repartition(5)
    records = S.segment_records(table, PERIODS, OFFSETS, rows_per_chunk=rows_per_chunk)
    got, want = S.bars_of_segments(records), B.trade_bars(table, PERIODS, OFFSETS)
    assert got.columns == want.columns and exact(got) == exact(want)
    buckets = {}
    for r in B.bucketed(table, PERIODS, OFFSETS).collect():
        buckets.setdefault((r.market, r.period_ms, r.bucket_ms), []).append((r.price, r.volume))
    for bar in got.collect():
        price, volume = np.array(buckets[(bar.market, bar.period_ms, bar.time_ms)]).T
        for name, (kind, q) in B.BAR_QUANTILES.items():
            assert rank_error(*((price, volume) if kind == "p" else (volume, np.ones(len(volume)))), bar[name], q) <= 0.01, (bar, name)


def test_a_late_trade_reads_few_rows(spark, trades):
    late = (9999, trades[700][1] + 1, "a", 555.0, 7.0, 1)
    old = spark.createDataFrame(trades, TRADES)
    records = S.segment_records(old, SHORT, SHIFTS)
    everything = old.unionByName(spark.createDataFrame([late], TRADES))
    touched = S.in_segments(spark.createDataFrame([late], TRADES), SHORT, SHIFTS).select(*S.SEGMENT).distinct()
    stale = S.stale_segments(records, touched)
    stored = everything.withColumn("date", F.to_date(F.timestamp_millis("time_ms")))
    rows = S.stale_trades(stored, stale, SHORT, SHIFTS)
    # one segment and the rest of its bucket, and the next bucket, of each period: not the series after them
    read = rows.count()
    after = everything.where(f"market = 'a' AND time_ms >= {late[1]}").count() * 2
    assert 0 < read < after / 3
    reach = rows.agg(F.max("bucket_ms") - F.min("bucket_ms")).first()[0]
    assert reach <= 4 * 1_800_000 and rows.where("market <> 'a'").count() == 0
    buckets = rows.groupBy("period_ms").agg(F.countDistinct("bucket_ms").alias("n"), F.min("time_ms").alias("first")).collect()
    assert all(b.n == 2 and b["first"] > late[1] - b.period_ms / S.SLICES for b in buckets)

    fresh = S.refreshed_records(records, rows, stale, SHORT)
    kept = records.join(fresh.select(*S.SEGMENT), S.SEGMENT, "left_anti")
    got, want = S.bars_of_segments(kept.unionByName(fresh)), B.trade_bars(everything, SHORT, SHIFTS)
    names = [c for c in want.columns if c not in B.BAR_QUANTILES]
    assert not [(x[:4], n, a, b) for x, y in zip(exact(got), exact(want)) for n, a, b in zip(names, x, y) if a != b]
    assert got.count() == want.count()


def test_no_trades(spark):
    empty = spark.createDataFrame([], TRADES)
    assert S.bars_of_segments(S.segment_records(empty, PERIODS, OFFSETS)).count() == 0
