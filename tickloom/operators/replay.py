"""Order books replayed from stored messages: updates, snapshots that clear a range of prices, removals and expiry.

The levels of a book are dealt out by a hash of their prices, and a snapshot's range goes to every part of its book. A task sweeps a part in
the order of time and keeps only the levels that are there. It gives spans, from the tick at which a level looks like this to the last one; books at
ticks are made of these afterwards, so quiet levels cost nothing in between.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.prefix import each_step
from tickloom.streaming.book_state import MESSAGE_COLUMNS

#: Parts of a book.
PARTS = 16
#: Spans that leave a task together.
SPAN_ROWS = 1 << 14

_KINDS = {"clear": 0, "level": 1, "update": 2}
_SPAN = {
    "symbol": "string", "side": "string", "level_key": "double", "price": "double", "qty": "double", "last_id": "bigint", "last_ms": "bigint",
    "change_count": "bigint", "qty_mean": "double", "qty_var": "double", "from_ms": "bigint", "until_ms": "bigint",
}
_ARROW = pa.schema([(n, {"string": pa.string(), "double": pa.float64(), "bigint": pa.int64()}[t]) for n, t in _SPAN.items()])


class Level:
    """A level and what its messages of one tick were."""

    __slots__ = ("price", "qty", "last_id", "last_ms", "seen", "tick")

    def __init__(self, price: float):
        self.price, self.seen, self.tick = price, [], None

    def take(self, row: dict) -> None:
        self.qty, self.last_id, self.last_ms = row["qty"], row["id"], row["event_ms"]
        self.seen.append(row["qty"])


class Book:
    """The levels of one part of one side of a book."""

    def __init__(self, symbol: str, side: str, tick_ms: int, allow_removal: bool, expiry_ms: int):
        self.symbol, self.side, self.tick_ms, self.allow_removal, self.expiry_ms = symbol, side, tick_ms, allow_removal, expiry_ms
        self.levels: dict[float, Level] = {}

    def span(self, key: float, level: Level, until: int | None) -> Iterator[tuple]:
        """What the level has shown since its tick, up to ``until`` (none: for good). The tick of its messages has their counts, later ones have none."""
        if level.tick is None or not level.qty > 0:
            return
        last = until
        if self.expiry_ms > 0:
            expires = (level.last_ms + self.expiry_ms) // self.tick_ms * self.tick_ms
            last = expires if last is None else min(last, expires)
        base = (self.symbol, self.side, key, level.price, level.qty, level.last_id, level.last_ms)
        if last is None or last >= level.tick:
            n = len(level.seen)
            mean = sum(level.seen) / n
            yield (*base, n, mean, sum((x - mean) ** 2 for x in level.seen) / n, level.tick, level.tick)
        if last is None or last > level.tick:
            yield (*base, 0, None, None, level.tick + self.tick_ms, last)

    def advance(self, tick: int, rows: list[dict]) -> Iterator[tuple]:
        """Take the messages of one tick, in order of id, kind, time and quantity."""
        clears = [r for r in rows if r["kind"] == 0]
        cleared = lambda key: max((c["id"] for c in clears if c["low_key"] <= key <= c["high_key"]), default=None)
        touched: dict[float, list[dict]] = {}
        for r in rows:
            if r["kind"]:
                touched.setdefault(r["level_key"], []).append(r)
        for key in [k for k in self.levels if k not in touched] if clears else ():
            if (c := cleared(key)) is not None and self.levels[key].last_id <= c:
                yield from self.gone(key, tick)
        for key, messages in touched.items():
            c = cleared(key) if clears else None
            old = self.levels.get(key)
            if old is not None and self.expiry_ms > 0 and old.last_ms < tick - self.tick_ms - self.expiry_ms:
                yield from self.gone(key, tick)
                old = None
            if old is not None and c is not None and old.last_id <= c:
                yield from self.gone(key, tick)
                old = None
            live = [m for m in messages if (c is None or m["id"] >= c) and (old is None or m["id"] >= old.last_id)]
            if not live:
                continue
            first = live[0]
            if self.allow_removal and old is not None and first["kind"] == 2 and first["qty"] <= 0 and first["id"] != old.last_id:
                yield from self.gone(key, tick)
                old, live = None, live[1:]
                if not live:
                    continue
            if old is not None:
                yield from self.span(key, old, tick - self.tick_ms)
            level = self.levels[key] = old or Level(live[0]["price"])
            level.seen, level.tick = [], tick
            for m in live:
                level.take(m)

    def gone(self, key: float, tick: int) -> Iterator[tuple]:
        yield from self.span(key, self.levels.pop(key), tick - self.tick_ms)

    def rest(self) -> Iterator[tuple]:
        for key, level in self.levels.items():
            yield from self.span(key, level, None)


def level_spans(messages: DataFrame, tick_ms: int, allow_removal: bool = True, expiry_ms: int = 0, parts: int = PARTS) -> DataFrame:
    """Spans of all levels: how a level looks at the ticks from ``from_ms`` to ``until_ms`` (null: for good).

    ``messages`` are those of :func:`tickloom.streaming.book_state.update_messages` and ``snapshot_messages``. The messages of a tick
    are one batch. A snapshot of id ``c`` clears what is not newer in its range: levels up to ``c``, messages of its tick below ``c``. A message older
    than its level is left out. The first message of a tick that empties a level removes it. A level that was not updated for ``expiry_ms`` before a tick is not
    there any more. A task holds the levels of its part, not their history; messages of one level, however many, pass through it in order.
    """
    tick = (F.floor(F.col("event_ms") / tick_ms).cast("bigint") + 1) * tick_ms
    kind = F.create_map(*(F.lit(x) for pair in _KINDS.items() for x in pair))[F.col("kind")]
    every = F.sequence(F.lit(0), F.lit(parts - 1))
    part = F.when(F.col("kind") == "clear", every).otherwise(F.array(F.pmod(F.xxhash64("level_key"), F.lit(parts)).cast("int")))
    rows = messages.select(*MESSAGE_COLUMNS).withColumns({"tick": tick, "part": F.explode(part), "kind": kind})
    by = ["symbol", "side", "part"]
    ordered = rows.repartition(*by).sortWithinPartitions(*by, "tick", "id", "kind", "event_ms", "qty")

    def run(batches):
        book, place, held, out = None, None, [], []
        for batch in batches:
            for row in batch.to_pylist():
                at = (row["symbol"], row["side"], row["part"])
                if held and (at != place or row["tick"] != held[0]["tick"]):
                    out += book.advance(held[0]["tick"], held)
                    held = []
                if at != place:
                    out += book.rest() if book else ()
                    book, place = Book(row["symbol"], row["side"], tick_ms, allow_removal, expiry_ms), at
                held.append(row)
                if len(out) >= SPAN_ROWS:
                    yield _batch(out)
                    out = []
        if book:
            out += [*book.advance(held[0]["tick"], held), *book.rest()]
        yield _batch(out)

    return ordered.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in _SPAN.items()))


def _batch(rows: Sequence[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(_SPAN)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def replayed_books(messages: DataFrame, tick_ms: int, until_ms: int | None = None, allow_removal: bool = True, expiry_ms: int = 0, parts: int = PARTS) -> DataFrame:
    """Every book at every tick, up to its symbol's last tick or ``until_ms``, from updates and snapshots."""
    spans = level_spans(messages, tick_ms, allow_removal, expiry_ms, parts)
    tick = (F.floor(F.col("event_ms") / tick_ms).cast("bigint") + 1) * tick_ms
    ends = messages.groupBy(F.col("symbol").alias("_s")).agg(F.max(tick).alias("_last"))
    spans = spans.join(ends, F.col("symbol") == F.col("_s"))
    until = F.least(F.coalesce("until_ms", "_last"), "_last" if until_ms is None else F.lit(until_ms).cast("bigint"))
    shown = each_step(spans.drop("_s"), F.col("from_ms"), until, tick_ms, "tick_ms")
    return shown.select("symbol", "tick_ms", "side", "level_key", "price", "qty", "last_id", "last_ms", "change_count", "qty_mean", "qty_var")
