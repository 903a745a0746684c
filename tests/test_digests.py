"""Quantile digests against numpy's exact ranks."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickloom.operators import digests as D

FRACTIONS = [0.001, 0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 0.999]


def rank_error(values, weights, answer, fraction):
    order = np.argsort(values)
    values, weights = values[order], weights[order]
    below = weights[values < values[values <= answer].max(initial=-np.inf)].sum() / weights.sum()
    upto = weights[values <= values[values >= answer].min(initial=np.inf)].sum() / weights.sum()
    return max(below - fraction, fraction - upto, 0)


def shapes():
    rng = np.random.default_rng(1)
    yield "normal", rng.normal(size=60_000), np.ones(60_000)
    yield "weighted", rng.lognormal(0, 3, 50_000), np.ceil(rng.lognormal(3, 2, 50_000))
    yield "few values", rng.integers(0, 5, 40_000).astype(float), np.ones(40_000)
    yield "rising", np.arange(30_000.0), np.ones(30_000)
    yield "one heavy", np.append(rng.normal(size=3000), 7.0), np.append(np.ones(3000), 1e6)
    yield "short", rng.normal(size=30), rng.integers(1, 9, 30).astype(float)
    yield "single", np.array([4.0]), np.array([2.0])


@pytest.fixture(scope="module")
def made(spark):
    """Digests of all shapes: from tasks that each see a part, in any order."""
    rows = [(name, float(v), float(w), i) for name, values, weights in shapes() for i, (v, w) in enumerate(zip(values, weights))]
    table = spark.createDataFrame(rows, "key string, value double, weight double, i int").repartition(7, "i")
    return D.quantile_digests(table, ["key"])


def test_ranks(made):
    got = {r["key"]: r for r in made.select("key", F.size("digest").alias("n"), D.total_weight(F.col("digest")).alias("w"), *(D.digest_quantile(F.col("digest"), q).alias(f"q{i}") for i, q in enumerate(FRACTIONS))).collect()}
    for name, values, weights in shapes():
        row = got[name]
        assert row.n <= max(D.COMPRESSION + 1, min(len(values), D.COMPRESSION)) and np.isclose(row.w, weights.sum())
        for i, q in enumerate(FRACTIONS):
            assert rank_error(values, weights, row[f"q{i}"], q) <= 0.01, (name, q, row[f"q{i}"])


def test_merging_in_steps(spark, made):
    """A stored digest and those of late values, again and again, stay within the error."""
    rng = np.random.default_rng(2)
    values = rng.gamma(2, size=20_000)
    table = spark.createDataFrame([(1, float(v), 1.0, i % 10) for i, v in enumerate(values)], "key int, value double, weight double, step int")
    parts = [D.quantile_digests(table.where(F.col("step") == i), ["key"]) for i in range(10)]
    whole = parts[0]
    for part in parts[1:]:
        whole = D.merged_digests(whole.unionByName(part), ["key"])
    (row,) = whole.select(*(D.digest_quantile(F.col("digest"), q).alias(f"q{i}") for i, q in enumerate(FRACTIONS))).collect()
    assert all(rank_error(values, np.ones(len(values)), row[f"q{i}"], q) <= 0.01 for i, q in enumerate(FRACTIONS))


def test_odd_values(spark):
    rows = [("a", None, 1.0), ("a", 1.0, 0.0), ("a", 2.0, None), ("a", 3.0, -1.0), ("b", 5.0, 2.0), ("b", 5.0, 2.0)]
    table = spark.createDataFrame(rows, "key string, value double, weight double")
    (row,) = D.quantile_digests(table, ["key"]).select("key", D.total_weight(F.col("digest")).alias("w"), D.digest_quantile(F.col("digest"), 0.3).alias("q")).collect()
    assert tuple(row) == ("b", 4.0, 5.0)
    assert D.quantile_digests(table.limit(0), ["key"]).count() == 0


def test_refresh_reads_no_old_trades(spark):
    """Merging late digests into stored ones has only the stored digests and the late trades as inputs."""
    from tickloom.operators import bars as B

    trades = "id long, time_ms long, market string, price double, volume double, flag short"
    old = spark.createDataFrame([(i, i * 1000, "m", 1.0 + i % 50, 1.0, 1) for i in range(2000)], trades)
    late = spark.createDataFrame([(9000 + i, 1500 + i, "m", 99.0, 5.0, 1) for i in range(50)], trades)
    digest = lambda t: B.bar_digests(B.bucketed(t, [600_000]))
    refreshed = B.refreshed_digests(digest(old), digest(late))
    assert {r.bucket_ms for r in refreshed.collect()} == {0}
    (row,) = B.digest_columns(refreshed).collect()
    whole = {r.bucket_ms: r for r in B.digest_columns(digest(old.unionByName(late))).collect()}
    assert abs(row.price_q50 - whole[0].price_q50) < 1 and row.price_q90 == whole[0].price_q90 == 99.0


def test_blocks_are_bounded_by_centroids():
    """Digests are held by their centroids, and no key is cut."""
    cells = pa.array([[{"mean": float(i), "weight": 1.0} for i in range(100)]] * 20_000, D._DIGEST)
    keys = pa.array(np.repeat(np.arange(4_000), 5))
    batches = pa.Table.from_arrays([keys, cells], names=["k", "digest"]).to_batches(max_chunksize=10_000)
    tables = list(D._tables(iter(batches), 1, True))
    assert sum(t.num_rows for t in tables) == 20_000 and max(t.num_rows for t in tables) * 100 <= D.BLOCK_ROWS + D.SLICE_ROWS * 100
    ends = [(t["k"][0].as_py(), t["k"][-1].as_py()) for t in tables]
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))
