"""Replayed books against the books that the streaming state gives, tick by tick."""

import random

from pyspark.sql import functions as F

from tickloom.operators import replay as R
from tickloom.streaming import book_state as S

SCHEMA = "symbol string, side string, kind string, level_key double, price double, qty double, id long, event_ms long, low_key double, high_key double"
TICK = 1000


def messages(seed, n=700):
    rng = random.Random(seed)
    rows, t = [], 5000
    for i in range(n):
        t += rng.choice([0, 1, 30, 200, 2600 if rng.random() < 0.05 else 3])
        symbol, side = rng.choice("ab"), rng.choice(["bid", "ask"])
        id_ = i * 2 + rng.choice([-40, 0, 0, 0, 0, 1])  # some come too late
        key = float(rng.randrange(1, 12))
        rows.append((symbol, side, "update", key, key, rng.choice([0.0, 0.0, 1.0, 2.5]), id_, t, None, None))
        if rng.random() < 0.03:
            low, high = (float(rng.randrange(1, 12)), float("inf")) if side == "bid" else (float("-inf"), float(rng.randrange(1, 12)))
            rows.append((symbol, side, "clear", None, None, None, id_, t, low, high))
            for k in range(int(max(low, 1)), int(min(high, 12))):
                rows.append((symbol, side, "level", float(k), float(k), rng.choice([3.0, 4.0]), id_, t, None, None))
    return rows


def streamed(spark, rows, expiry_ms):
    """The whole books after each tick that has messages, from the streaming state."""
    table = spark.createDataFrame(rows, SCHEMA).withColumn("tick", (F.floor(F.col("event_ms") / TICK) + 1) * TICK).cache()
    ticks = sorted(r.tick for r in table.select("tick").distinct().collect())
    state, out = spark.createDataFrame([], S.STATE_SCHEMA), {}
    for tick in range(ticks[0], ticks[-1] + TICK, TICK):
        fresh = state.withColumns({c: F.lit(0).cast(S.STATE[c]) for c in ("change_count", "stat_count", "mean", "m2")})
        after = S.next_state(fresh, table.where(F.col("tick") == tick).drop("tick"), tick, True, expiry_ms)
        got = after.collect()
        state = spark.createDataFrame(got, S.STATE_SCHEMA)
        out[tick] = {(r.symbol, r.side, r.level_key): (r.price, r.qty, r.last_id, r.last_ms, r.change_count) for r in got if r.qty > 0}
    table.unpersist()
    return out


def test_replay_equals_the_streaming_state(spark):
    for seed, expiry in ((1, 0), (2, 4000)):
        rows = messages(seed, 150)
        want = streamed(spark, rows, expiry)
        table = spark.createDataFrame(rows, SCHEMA).repartition(4)
        for parts in (1, 5):
            got = {}
            last = max(want)
            for r in R.replayed_books(table, TICK, last, expiry_ms=expiry, parts=parts).collect():
                got.setdefault(r.tick_ms, {})[(r.symbol, r.side, r.level_key)] = (r.price, r.qty, r.last_id, r.last_ms, r.change_count)
            ends = {s: (max(r[7] for r in rows if r[0] == s) // TICK + 1) * TICK for s in "ab"}
            for tick, book in want.items():
                assert got.get(tick, {}) == {k: v for k, v in book.items() if tick <= max(ends[k[0]], last)}, (seed, parts, tick)


def test_statistics_and_no_messages(spark):
    rows = [("a", "bid", "update", 1.0, 1.0, q, i, 100 + i, None, None) for i, q in enumerate([1.0, 2.0, 6.0])]
    rows.append(("a", "bid", "update", 2.0, 2.0, 1.0, 9, 2500, None, None))
    books = {(r.tick_ms, r.price): r for r in R.replayed_books(spark.createDataFrame(rows, SCHEMA), TICK).collect()}
    assert sorted(books) == [(1000, 1.0), (2000, 1.0), (3000, 1.0), (3000, 2.0)]
    assert (books[(1000, 1.0)].qty_mean, books[(1000, 1.0)].change_count) == (3.0, 3) and abs(books[(1000, 1.0)].qty_var - 14 / 3) < 1e-12
    assert books[(2000, 1.0)].change_count == 0 and books[(2000, 1.0)].qty_mean is None
    assert R.replayed_books(spark.createDataFrame([], SCHEMA), TICK).count() == 0
