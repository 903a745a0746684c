"""Keys that fit a task are moved once; longer ones go in chunks, with the same results."""

from pyspark.sql import functions as F

from tickloom.operators import books as K
from tickloom.operators import features as D


def shuffles(df) -> int:
    """Exchanges of the plan that move rows of its widest step, as planned before any runs."""
    df.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df._jdf.sparkSession().sessionState().executePlan(df._jdf.logicalPlan(), df._jdf.queryExecution().mode()).executedPlan().toString().count("Exchange hashpartitioning")
    finally:
        df.sparkSession.conf.set("spark.sql.adaptive.enabled", "true")


def feed(spark, rows, value):
    return spark.createDataFrame(rows, f"inst_id string, {value} double, ts long, arrival long")


def test_context_asof_whole_and_chunked(spark):
    a = feed(spark, [("x", float(i), 10 * i // 2 * 2, i % 3) for i in range(60)] + [("y", 1.0, 5, 1), ("y", 2.0, 5, 2), ("y", 3.0, None, 1), (None, 4.0, 5, 1)], "oi")
    b = feed(spark, [("x", float(-i), 7 * i, 0) for i in range(40)] + [("y", -1.0, 31, 0), (None, -4.0, 7, 0), (None, -5.0, 45, 0)], "px")
    clock = spark.createDataFrame([(k, t) for k in ("x", "y", None) for t in range(0, 640, 20)] + [("y", 40)], "inst_id string, tick_ms long")
    for step in (None, 20):
        run = lambda n, step=step: D.context_asof(clock, {"a": a, "b": b}, 100, step_ms=step, rows_per_key=n)  # noqa: E731, B023
        whole, chunked, mixed = (sorted(map(str, run(n).collect())) for n in (10**6, 1, 50))
        known = [r for r in whole if "inst_id=None" not in r]
        assert whole == chunked == mixed and len(known) > 60
        assert "Row(inst_id='y', tick_ms=40, a=Row(oi=2.0, ts=5, arrival=2), b=Row(px=-1.0, ts=31, arrival=0))" in known
        assert shuffles(run(10**6)) == 1


def test_regroup_whole_and_sliced(spark):
    rows = spark.range(900).select(
        (F.col("id") % 3).alias("book"), F.when(F.col("id") % 2 == 0, "bid").otherwise("ask").alias("side"),
        F.when(F.col("id") % 2 == 0, 1000.0 - F.col("id")).otherwise(1000.0 + F.col("id") * (F.col("id") % 3 + 1)).alias("price"),
        (F.col("id") * 7 % 5).cast("double").alias("size"),
    ).filter("book < 2 OR id < 90")
    rows = rows.unionByName(rows.limit(1).withColumn("book", F.lit(None).cast("bigint")))
    whole, sliced, mixed = (sorted(map(str, K.regroup_sides(rows, 10, ["book"], n).collect())) for n in (10**6, 1, 100))
    assert whole == sliced == mixed and len(whole) == 60
    assert shuffles(K.regroup_sides(rows, 10, ["book"])) == 1


def test_tasks_by_measured_rows(spark):
    from tickloom.operators.prefix import dealt, large_keys

    rows = spark.range(1000).select((F.col("id") % 10).alias("k"))
    many, tasks = large_keys(rows, ["k"], 50)
    assert many.count() == 10 and tasks == 20 and large_keys(rows, ["k"], 100) == (None, 10)
    assert dealt(rows, tasks, "k").rdd.getNumPartitions() == 20


def test_keys_are_counted_by_their_hashes_first(spark, monkeypatch):
    from tickloom.operators import prefix

    # nearly as many keys as rows: no task gives a row for each of its keys; one key is long, as is the null key, which never counts
    rows = spark.range(20_000).select(F.when(F.col("id") < 300, 1).when(F.col("id") >= 600, F.col("id")).alias("k"), F.col("id").alias("x"))
    written = []
    write = prefix.scratch_table
    monkeypatch.setattr(prefix, "scratch_table", lambda df: written.append(df) or write(df))
    assert prefix.large_keys(rows, ["k"], 400) == (None, 50) and not written
    for cells in (1, 7, 1 << 14):
        monkeypatch.setattr(prefix, "KEY_CELLS", cells)
        many, tasks = prefix.large_keys(rows, ["k"], 200)
        assert [r.k for r in many.collect()] == [1] and tasks == 100
        assert prefix.large_keys(rows.limit(0), ["k"], 200) == (None, 0)
    monkeypatch.setattr(prefix, "KEY_CELLS", 2)
    assert prefix.large_keys(rows, ["k"], 400) == (None, 50)


def test_clock_is_worked_out_once(spark):
    a = feed(spark, [("x", 1.0, 7, 0), ("x", 1.0, -25, 0), ("y", 1.0, 20, 0), ("z", 1.0, None, 0), (None, 1.0, 95, 0)], "oi")
    b = feed(spark, [("x", 1.0, 61, 0), ("y", 1.0, 20, 0), ("w", 1.0, 101, 0)], "px")
    for end, want in ((100, {("x", -20, 100, 7), ("y", 20, 100, 5), (None, 100, 100, 1)}), (None, {("x", -20, 60, 5), ("y", 20, 20, 1)})):
        clock = D.clock_ticks([a, b], 20, end)
        assert "Aggregate" not in clock._jdf.queryExecution().optimizedPlan().toString()
        ticks = clock.groupBy("inst_id").agg(F.min("tick_ms"), F.max("tick_ms"), F.count("*"))
        assert {tuple(r) for r in ticks.collect()} == want
