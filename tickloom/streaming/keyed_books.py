"""Order books from a stream in Spark's own keyed state: what a trigger touches is all that it reads and writes.

The key is a symbol, a side and a part of its levels; the levels of a part are a map in the state store. A trigger's messages change
the levels they name, a snapshot also looks through the parts of its side, and a timer in event time lets levels expire, with or without new
messages. The output are changes: a level as it is now, or that it is gone. :func:`books_after` makes the books of any trigger from them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from tickloom.operators.prefix import each_step
from tickloom.streaming.book_state import EXPIRY_MS, MESSAGE_COLUMNS, use_rocksdb

#: Parts of the levels of a side.
PARTS = 8

KEY = ["symbol", "side", "part"]
LEVEL_SCHEMA = "price double, qty double, last_id bigint, last_ms bigint"
CHANGES = "symbol string, side string, level_key double, price double, qty double, last_id bigint, last_ms bigint, change_count bigint, qty_mean double, qty_var double, gone boolean"

Level = tuple[float, float, int, int]  # price, quantity, id, time


class Run:
    """Messages in their order, as one array a field; ``update`` tells updates from levels of snapshots."""

    FIELDS = {"update": bool, "price": np.float64, "qty": np.float64, "id": np.int64, "event_ms": np.int64}

    def __init__(self, update: np.ndarray, price: np.ndarray, qty: np.ndarray, id: np.ndarray, event_ms: np.ndarray):  # noqa: A002
        self.update, self.price, self.qty, self.id, self.event_ms = update, price, qty, id, event_ms

    def __len__(self) -> int:
        return len(self.id)

    def __getitem__(self, at) -> Run:
        return Run(*(getattr(self, f)[at] for f in self.FIELDS))


def after_run(old: Level | None, run: Run, cleared: int | None, allow_removal: bool) -> tuple[Level | None, np.ndarray | None]:
    """A level after one trigger's messages, and the quantities that it took; None if nothing happened to it.

    ``cleared`` is the id of the newest snapshot that covers the level.
    """
    had = old
    if old is not None and cleared is not None and old[2] <= cleared:
        old = None
    bounds = [x for x in (cleared, None if old is None else old[2]) if x is not None]
    live = run[run.id >= max(bounds)] if bounds else run
    if len(live) and allow_removal and old is not None and live.update[0] and live.qty[0] <= 0 and live.id[0] != old[2]:
        old, live = None, live[1:]
    if not len(live):
        return old, None if old is had else live.qty
    price = live.price[0] if old is None else old[0]
    return (float(price), float(live.qty[-1]), int(live.id[-1]), int(live.event_ms[-1])), live.qty


def after_messages(old: Level | None, messages: Sequence[dict], cleared: int | None, allow_removal: bool) -> tuple[Level | None, list[float] | None]:
    """:func:`after_run` of messages that are records."""
    records = [{**m, "update": m["kind"] == "update"} for m in messages]
    run = Run(*(np.array([m[f] for m in records], t) for f, t in Run.FIELDS.items()))
    new, taken = after_run(old, run, cleared, allow_removal)
    return new, None if taken is None else taken.tolist()


class Batch:
    """One trigger's messages of a key: snapshots' ranges, and the messages of each level in the order of id, kind, time and quantity.

    Messages are kept as numbers, frame by frame, and sorted together; so a busy level costs no Python objects.
    """

    def __init__(self, frames: Iterable[pd.DataFrame]):
        self.clears: list[tuple[float, float, int]] = []
        self.first_ms: int | None = None
        held: list[list[np.ndarray]] = []
        for frame in frames:
            if frame[["id", "event_ms"]].isna().to_numpy().any():
                raise ValueError("a message has no id or no time")
            if len(frame):
                first = int(frame["event_ms"].min())
                self.first_ms = first if self.first_ms is None else min(first, self.first_ms)
            clear = (frame["kind"] == "clear").to_numpy(bool)
            self.clears += [(m.low_key, m.high_key, int(m.id)) for m in frame[clear].itertuples()]
            rest = frame[~clear]
            rest = rest.assign(update=rest["kind"] == "update")
            held.append([rest["level_key"].to_numpy(np.float64), *(rest[f].to_numpy(t) for f, t in Run.FIELDS.items())])
        level, *fields = (np.concatenate(x) for x in zip(*held)) if held else (np.empty(0, t) for t in (np.float64, *Run.FIELDS.values()))
        self.run = run = Run(*fields)
        # messages without a level, and those of a level that has a message without a quantity, are taken as they came
        known, lost = np.flatnonzero(~np.isnan(level)), np.flatnonzero(np.isnan(level))
        by = np.lexsort([x[known] for x in (run.qty, run.event_ms, run.update, run.id, level)])
        self.order = np.concatenate((known[by], lost))
        level = level[self.order]
        self.starts = np.flatnonzero(np.concatenate(([True], level[1:] != level[:-1]))) if len(level) else np.empty(0, np.int64)
        self.keys = level[self.starts].tolist()

    def levels(self) -> Iterator[tuple[float, Run]]:
        ends = [*self.starts[1:].tolist(), len(self.order)]
        for key, a, b in zip(self.keys, self.starts.tolist(), ends):
            own = self.order[a:b]
            run = self.run[own]
            if np.isnan(run.qty).any():
                place = lambda i: (self.run.id[i], self.run.update[i], self.run.event_ms[i], self.run.qty[i])
                run = self.run[np.array(sorted(np.sort(own).tolist(), key=place))]
            yield key, run

    def cleared(self, level: float) -> int | None:
        """The id of the newest snapshot that covers a level."""
        return max((i for low, high, i in self.clears if low <= level <= high), default=None)


class BookProcessor(StatefulProcessor):
    """The levels of one part of a side."""

    def __init__(self, allow_removal: bool, expiry_ms: int):
        self.allow_removal, self.expiry_ms = allow_removal, expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.levels = handle.getMapState("levels", "level_key double", LEVEL_SCHEMA)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        batch = Batch(rows)
        held: dict[float, Level] = {}
        if batch.clears:
            held = {k[0]: tuple(v) for k, v in self.levels.iterator()}
        touched = set(batch.keys)
        out = []
        for level, run in chain(batch.levels(), ((k, batch.run[:0]) for k in held if k not in touched)):
            old = held.get(level) if batch.clears else self._stored(level)
            new, taken = after_run(old, run, batch.cleared(level), self.allow_removal)
            if taken is None:
                continue
            if new is None:
                self.levels.removeKey((level,))
                out.append(_change(key, level, old, taken, True))
            else:
                self.levels.updateValue((level,), new)
                out.append(_change(key, level, new, taken, False))
        if self.expiry_ms > 0 and batch.first_ms is not None:
            first = batch.first_ms + self.expiry_ms + 1
            if first < min(map(_time_of, self.handle.listTimers()), default=first + 1):
                self.handle.registerTimer(first)
        if out:
            yield _frame(out)

    def _stored(self, level: float) -> Level | None:
        value = self.levels.getValue((level,))
        return None if value is None else tuple(value)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        """Let old levels go, and come again when the oldest of the others may."""
        now = timerValues.getCurrentWatermarkInMs()
        out, oldest = [], None
        for (level,), value in list(self.levels.iterator()):
            if value[3] + self.expiry_ms < now:
                self.levels.removeKey((level,))
                out.append(_change(key, level, tuple(value), [], True))
            else:
                oldest = value[3] if oldest is None else min(oldest, value[3])
        if oldest is not None:
            self.handle.registerTimer(max(oldest + self.expiry_ms + 1, now + 1))
        if out:
            yield _frame(out)

    def close(self) -> None:
        pass


def _time_of(timer) -> int:
    return int(timer[0] if isinstance(timer, tuple) else timer)


def _change(key, level: float, value: Level, taken: Sequence[float], gone: bool) -> tuple:
    n = len(taken)
    mean = float(np.mean(taken)) if n else None
    var = float(np.var(taken)) if n else None
    return (key[0], key[1], level, *value, n, mean, var, gone)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split()[0] for x in CHANGES.split(", ")]).astype({"qty_mean": "float64", "qty_var": "float64"})


def book_changes(messages: DataFrame, allow_removal: bool = True, expiry_ms: int = EXPIRY_MS, parts: int = PARTS, delay: str = "0 seconds") -> DataFrame:
    """Changes of all levels from a stream of messages (see :mod:`tickloom.streaming.book_state`), to be written in update mode.

    All messages of a trigger are one batch: a snapshot of id ``c`` clears what is not newer in its range, a message older than its level is left
    out, and the first message that empties a level removes it. Levels expire ``expiry_ms`` after their last message on the clock of the watermark; messages
    older than the watermark, ``delay`` behind the newest, are dropped.
    """
    use_rocksdb(messages.sparkSession)
    every = F.sequence(F.lit(0), F.lit(parts - 1))
    part = F.when(F.col("kind") == "clear", every).otherwise(F.array(F.pmod(F.xxhash64("level_key"), F.lit(parts)).cast("int")))
    timed = messages.select(*MESSAGE_COLUMNS).withColumn("event_time", F.timestamp_millis("event_ms")).withWatermark("event_time", delay)
    keyed = timed.withColumn("part", F.explode(part)).groupBy(*KEY)
    return keyed.transformWithStateInPandas(
        statefulProcessor=BookProcessor(allow_removal, expiry_ms), outputStructType=CHANGES, outputMode="Update", timeMode="EventTime"
    )


def books_after(changes: DataFrame, last: int, step: str = "step") -> DataFrame:
    """The whole books after each step from 0 to ``last``, from changes numbered by ``step``.

    A level looks as its last change says until the next one; counts and statistics are those of the step's own changes. Of several
    changes in one step the removal is the last: levels expire after the step's messages.
    """
    level = ["symbol", "side", "level_key"]
    value = F.struct("gone", "price", "qty", "last_id", "last_ms", "change_count", "qty_mean", "qty_var")
    each = changes.groupBy(*level, step).agg(F.max(value).alias("v")).select(*level, F.col(step).cast("bigint").alias("_from"), "v.*")
    following = F.lead("_from").over(Window.partitionBy(*level).orderBy("_from"))
    spans = each.withColumn("_next", following).where("NOT gone AND qty > 0")
    shown = each_step(spans, F.col("_from"), F.coalesce(F.col("_next") - 1, F.lit(last).cast("bigint")), 1, step)
    own = F.col(step) == F.col("_from")
    return shown.select(
        step, *level, "price", "qty", "last_id", "last_ms", F.when(own, F.col("change_count")).otherwise(0).cast("bigint").alias("change_count"),
        *(F.when(own, F.col(c)).alias(c) for c in ("qty_mean", "qty_var")),
    )

