"""Order book state kept from a stream of depth updates and snapshots.

The state is a table of levels in the shared folder, one row a level. Each micro-batch joins its messages with the
table by level, so that a busy symbol is spread over its levels, and writes the next version: snapshots clear, updates
change or remove, old levels expire on the clock of the stream, touched or not. What a trigger emits are the whole books.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from tickloom.functions.scalars import price_key

# Fixed value: levels not updated for 10 hours expire.
EXPIRY_MS = 36_000_000

LEVEL = ["symbol", "side", "level_key"]
STATE = {
    "price": "double", "qty": "double", "last_id": "bigint", "last_ms": "bigint", "change_count": "bigint", "stat_count": "bigint",
    "mean": "double", "m2": "double",
}
STATE_SCHEMA = "symbol string, side string, level_key double, " + ", ".join(f"{n} {t}" for n, t in STATE.items())
MESSAGE_COLUMNS = ["symbol", "side", "kind", "level_key", "price", "qty", "id", "event_ms", "low_key", "high_key"]
OUTPUT_COLUMNS = [*LEVEL, "price", "qty", "last_id", "last_ms", "change_count", "stat_count", "qty_var", "qty_std", "qty_mean"]


def update_messages(updates: DataFrame) -> DataFrame:
    """Depth updates (as rows per level) in the form the state takes."""
    none = F.lit(None).cast("double")
    return updates.select(
        "symbol", "side", F.lit("update").alias("kind"), price_key("price").alias("level_key"), "price", "qty",
        F.col("final_id").alias("id"), "event_ms", none.alias("low_key"), none.alias("high_key"),
    )


def snapshot_messages(snapshots: DataFrame, full_cleanup: bool | None = True, max_depth: int = 5000) -> DataFrame:
    """Snapshots ``(symbol, last_id, time_ms, bids, asks)`` as one range marker a side, and levels.

    The range of the bids starts at the lowest bid, that of the asks ends at the highest ask;
    with a full clean-up (or, when ``None``, for a side at its greatest depth) it is the whole side.
    """
    prices = lambda side: F.transform(side, lambda x: x["price"])
    none = F.lit(None).cast("double")

    def of(side: str) -> DataFrame:
        levels = F.col(f"{side}s")
        whole = F.lit(full_cleanup) if full_cleanup is not None else F.size(levels) >= max_depth
        edge = price_key(F.array_min(prices(levels)) if side == "bid" else F.array_max(prices(levels)))
        low = F.when(whole | F.lit(side == "ask"), F.lit(-math.inf)).otherwise(edge)
        high = F.when(whole | F.lit(side == "bid"), F.lit(math.inf)).otherwise(edge)
        base = snapshots.filter(F.size(levels) > 0).select(
            "symbol", F.lit(side).alias("side"), F.col("last_id").alias("id"), F.col("time_ms").alias("event_ms"), levels.alias("_l"),
            low.alias("low_key"), high.alias("high_key"),
        )
        markers = base.withColumns({"kind": F.lit("clear"), "level_key": none, "price": none, "qty": none})
        rows = base.select("symbol", "side", "id", "event_ms", F.inline("_l")).withColumn("level_key", price_key("price"))
        rows = rows.withColumns({"kind": F.lit("level"), "low_key": none, "high_key": none})
        return markers.select(MESSAGE_COLUMNS).unionByName(rows.select(MESSAGE_COLUMNS))

    return of("bid").unionByName(of("ask"))


def next_state(state: DataFrame, messages: DataFrame, clock_ms: int | None, allow_removal: bool = True, expiry_ms: int = EXPIRY_MS) -> DataFrame:
    """The levels after a batch of messages, taken in the order of id, kind, time and quantity.

    A snapshot of id ``c`` clears what is not newer in its range: stored levels up to ``c``, messages below ``c``. A
    message older than its level is left out. The first message of a batch that empties a level unchanged since the
    last emission removes it. Levels not updated for ``expiry_ms`` before ``clock_ms`` expire.
    """
    # a few snapshots a symbol and side in one trigger
    clears = messages.filter("kind = 'clear'").groupBy("symbol", "side").agg(F.collect_list(F.struct("id", "low_key", "high_key")).alias("_clears"))
    covering = F.filter("_clears", lambda c: F.col("level_key").between(c["low_key"], c["high_key"]))
    cleared = F.coalesce(F.array_max(F.transform(covering, lambda c: c["id"])), F.lit(-(2**63)))
    rank = F.when(F.col("kind") == "level", 1).otherwise(2)
    new = messages.filter("kind <> 'clear'").join(clears, ["symbol", "side"], "left").filter(F.col("id") >= cleared)
    new = new.select(*LEVEL, F.col("price").alias("_price"), F.col("qty").alias("_qty"), F.col("id").alias("_id"), F.col("event_ms").alias("_ms"), rank.alias("_rank"))
    old = state.join(clears, ["symbol", "side"], "left").filter(F.col("last_id") > cleared).select(*LEVEL, *STATE)
    rows = old.join(new, LEVEL, "full")
    live = F.col("_id").isNotNull() & (F.col("last_id").isNull() | (F.col("_id") >= F.col("last_id")))
    order = Window.partitionBy(*LEVEL).orderBy(F.col("_live").desc(), "_id", "_rank", "_ms", "_qty")
    rows = rows.withColumn("_live", live).withColumn("_n", F.row_number().over(order))
    removes = F.lit(allow_removal) & F.col("_live") & (F.col("_n") == 1) & (F.col("_rank") == 2) & (F.col("_qty") <= 0)
    removes = removes & (F.col("change_count") == 0) & (F.col("_id") != F.col("last_id"))
    rows = rows.withColumn("_gone", F.coalesce(removes, F.lit(False)))
    used = F.col("_live") & ~F.col("_gone")
    of_used = lambda c: F.when(used, F.col(c))
    place = F.when(used, F.col("_n"))
    sums = rows.groupBy(*LEVEL).agg(
        *(F.max(c).alias(c) for c in STATE), F.max("_gone").alias("_gone"), F.count(place).alias("_k"), F.avg(of_used("_qty")).alias("_mean"),
        F.var_pop(of_used("_qty")).alias("_var"), F.min_by("_price", place).alias("_price"), F.max_by("_qty", place).alias("_qty"),
        F.max_by("_id", place).alias("_id"), F.max_by("_ms", place).alias("_ms"),
    )
    kept = F.col("last_id").isNotNull() & ~F.col("_gone")
    before = F.when(kept, F.col("stat_count")).otherwise(0)
    changed, n = F.col("_k") > 0, before + F.col("_k")
    mean, m2 = F.when(before > 0, F.col("mean")).otherwise(0.0), F.when(before > 0, F.col("m2")).otherwise(0.0)
    more, spread = F.coalesce("_mean", F.lit(0.0)), F.coalesce(F.col("_var") * F.col("_k"), F.lit(0.0))
    pick = lambda a, b: F.when(changed, F.col(a)).otherwise(F.col(b))
    out = sums.filter(kept | changed).select(
        *LEVEL, F.when(kept, F.col("price")).otherwise(F.col("_price")).alias("price"), pick("_qty", "qty").alias("qty"), pick("_id", "last_id").alias("last_id"),
        pick("_ms", "last_ms").alias("last_ms"), (F.when(kept, F.col("change_count")).otherwise(0) + F.col("_k")).alias("change_count"), n.alias("stat_count"),
        F.when(n > 0, (mean * before + more * F.col("_k")) / n).otherwise(0.0).alias("mean"),
        F.when(n > 0, m2 + spread + (more - mean) * (more - mean) * before * F.col("_k") / n).otherwise(0.0).alias("m2"),
    )
    return out.filter(F.col("last_ms") >= clock_ms - expiry_ms) if expiry_ms > 0 and clock_ms is not None else out


def shown(state: DataFrame) -> DataFrame:
    """The books of a state: levels with a quantity, and what changed since the emission before."""
    n = F.col("stat_count")
    return state.filter("qty > 0").withColumns(
        {
            "qty_var": F.when(n > 0, F.col("m2") / n), "qty_std": F.when(n > 1, F.sqrt(F.col("m2") / (n - 1))),
            "qty_mean": F.when(n > 0, F.col("mean")),
        }
    ).select(OUTPUT_COLUMNS)


def book_keeper(folder: str, emit: Callable[[DataFrame, int], None], allow_removal: bool = True, expiry_ms: int = EXPIRY_MS, reset: bool = True):
    """``foreachBatch`` function over messages: keep the state below ``folder`` and give each trigger's whole books to ``emit``.

    Run it with a 15 s trigger for periodic books. A level that is gone is not in the next books; with ``reset`` counts and
    statistics start anew after each emission, for untouched levels too. Two versions of the state are kept: a batch
    that is repeated starts from the version before it and gives the same result.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        at = lambda i: f"{folder}/state-{i % 2}"
        clock_at = lambda i: f"{folder}/clock-{i % 2}"  # noqa: E731  apart from the levels: it goes on when there are none
        if batch_id == 0:
            state, clock = spark.createDataFrame([], STATE_SCHEMA), None
        else:
            state = spark.read.schema(STATE_SCHEMA).parquet(at(batch_id - 1))
            clock = spark.read.schema("clock_ms bigint").parquet(clock_at(batch_id - 1)).first()[0]
            if reset:
                state = state.withColumns({c: F.lit(0).cast(STATE[c]) for c in ("change_count", "stat_count", "mean", "m2")})
        messages = batch.persist()
        try:
            newest = messages.agg(F.max("event_ms")).first()[0]
            clock = max((x for x in (clock, newest) if x is not None), default=None)
            next_state(state, messages, clock, allow_removal, expiry_ms).write.mode("overwrite").parquet(at(batch_id))
            spark.range(1).select(F.lit(clock).cast("bigint").alias("clock_ms")).write.mode("overwrite").parquet(clock_at(batch_id))
        finally:
            messages.unpersist()
        emit(shown(spark.read.schema(STATE_SCHEMA).parquet(at(batch_id))), batch_id)

    return on_batch


def use_rocksdb(spark) -> None:
    """State with several variables needs the RocksDB store."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


class FundingProcessor(StatefulProcessor):
    """Accepted funding record of an instrument, records taken in arrival order."""

    def __init__(self, schema: T.StructType):
        self.schema = schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.accepted = handle.getValueState("accepted", self.schema)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        names = self.schema.names
        ts, funding_time = names.index("ts"), names.index("funding_time")
        current = tuple(self.accepted.get()) if self.accepted.exists() else None
        changed = False
        batch = pd.concat(list(rows), ignore_index=True).sort_values("arrival", kind="stable")
        for row in batch[names].astype(object).itertuples(index=False, name=None):
            if current is None or (row[ts] > current[ts] and row[funding_time] >= current[funding_time]):
                current, changed = row, True
        if changed:
            self.accepted.update(current)
            yield pd.DataFrame([current], columns=names)

    def close(self) -> None:
        pass


def latest_funding_state(funding: DataFrame) -> DataFrame:
    """Newest accepted funding record per instrument: later time, funding time not earlier."""
    use_rocksdb(funding.sparkSession)
    return funding.groupBy("inst_id").transformWithStateInPandas(
        statefulProcessor=FundingProcessor(funding.schema), outputStructType=funding.schema, outputMode="update", timeMode="none"
    )
