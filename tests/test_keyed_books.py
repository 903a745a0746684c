"""Books in keyed state: changes only where messages or timers touch, expiry on the clock of the stream."""

import uuid

from tickloom.session import shared_dir
from tickloom.streaming import keyed_books as K
from tickloom.streaming import streams as Z

SCHEMA = "symbol string, side string, kind string, level_key double, price double, qty double, id long, event_ms long, low_key double, high_key double"


def update(symbol, price, qty, id_, ms):
    return (symbol, "bid", "update", price, price, qty, id_, ms, None, None)


def test_expiry_needs_no_message_of_the_book(spark):
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/in")
    changes = K.book_changes(spark.readStream.schema(SCHEMA).parquet(f"{folder}/in"), expiry_ms=1000, parts=2)
    triggers = [
        [update("a", 1.0, 5.0, 1, 1000), update("a", 2.0, 6.0, 2, 1200), update("b", 1.0, 7.0, 1, 1100)],
        [update("b", 1.0, 8.0, 2, 2150)],
        [update("b", 1.0, 0.0, 3, 2160), ("b", "bid", "clear", None, None, None, 4, 2170, float("-inf"), float("inf"))],
    ]
    got = []
    for step, rows in enumerate(triggers):
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(f"{folder}/in")
        seen = []
        Z.run_available(changes, lambda batch, i, seen=seen: seen.extend(batch.collect()), f"{folder}/state", "update")
        got.append({(r.symbol, r.level_key): (r.qty, r.gone) for r in seen})
    assert got[0] == {("a", 1.0): (5.0, False), ("a", 2.0): (6.0, False), ("b", 1.0): (7.0, False)}
    # the clock of the other symbol lets one level of the first go; the other stays and is not touched
    assert got[1] == {("b", 1.0): (8.0, False), ("a", 1.0): (5.0, True)}
    assert got[2] == {("b", 1.0): (8.0, True)}


def test_after_messages():
    m = lambda kind, qty, id_: {"kind": kind, "qty": qty, "id": id_, "price": 9.0, "event_ms": id_}
    old = (9.5, 1.0, 5, 5)
    assert K.after_messages(old, [], None, True) == (old, None)
    assert K.after_messages(old, [m("update", 2.0, 4)], None, True) == (old, None)
    assert K.after_messages(old, [m("update", 0.0, 6)], None, True) == (None, [])
    assert K.after_messages(old, [m("update", 0.0, 6)], None, False) == ((9.5, 0.0, 6, 6), [0.0])
    assert K.after_messages(old, [m("update", 0.0, 6), m("update", 3.0, 7)], None, True) == ((9.0, 3.0, 7, 7), [3.0])
    assert K.after_messages(old, [], 5, True) == (None, [])
    assert K.after_messages(old, [m("level", 3.0, 8), m("update", 0.0, 6)], 8, True) == ((9.0, 3.0, 8, 8), [3.0])


def test_clock_of_an_empty_book_goes_on(spark):
    """After everything has expired a late message does not set the clock back: it expires at once."""
    from tickloom.streaming.book_state import book_keeper

    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    shown = []
    keeper = book_keeper(folder, lambda books, i: shown.append({r.price: r.qty for r in books.collect()}), expiry_ms=1000)
    rows = [[update("a", 1.0, 5.0, 1, 1000)], [update("a", 1.0, 0.0, 2, 9000)], [update("a", 2.0, 3.0, 3, 1500)], [update("a", 3.0, 4.0, 4, 8500)]]
    for i, batch in enumerate(rows):
        keeper(spark.createDataFrame(batch, SCHEMA), i)
    assert shown == [{1.0: 5.0}, {}, {}, {3.0: 4.0}]


def test_messages_of_a_trigger_are_arrays():
    """Frames of any size, in any order, give each level's messages in order, without a record a message."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(3)
    n = 5000
    rows = pd.DataFrame({
        "kind": rng.choice(["update", "level"], n), "level_key": rng.integers(0, 40, n) / 8, "price": rng.integers(1, 9, n) * 1.0, "qty": rng.integers(0, 4, n) * 1.0,
        "id": rng.integers(0, 300, n), "event_ms": rng.integers(0, 90, n), "low_key": np.nan, "high_key": np.nan,
    })
    clears = pd.DataFrame({"kind": "clear", "level_key": np.nan, "price": np.nan, "qty": np.nan, "id": [150, 9], "event_ms": [7, -3], "low_key": [-np.inf, 2.0], "high_key": [2.5, np.inf]})
    batch = K.Batch([rows[:10], rows[10:10], pd.concat([rows[10:], clears])])
    rank = {"level": 1, "update": 2}
    assert batch.first_ms == -3 and [batch.cleared(x) for x in (0.0, 2.5, 3.0)] == [150, 150, 9]
    records = rows.to_dict("records")
    seen = 0
    for level, run in batch.levels():
        own = sorted((m for m in records if m["level_key"] == level), key=lambda m: (m["id"], rank[m["kind"]], m["event_ms"], m["qty"]))
        assert run.id.tolist() == [m["id"] for m in own] and run.qty.tolist() == [m["qty"] for m in own]
        old, cleared = (1.0, 2.0, 120, 5), batch.cleared(level)
        new, taken = K.after_run(old, run, cleared, True)
        assert (new, taken.tolist()) == K.after_messages(old, own, cleared, True)
        seen += len(run)
    assert seen == n and len(batch.keys) == 40
    assert list(K.Batch([]).levels()) == [] and K.Batch([]).first_ms is None


def test_messages_without_level_or_quantity_are_taken_as_they_came():
    import numpy as np
    import pandas as pd

    nan = np.nan
    rows = [(nan, 9, 1.0), (1.0, 5, nan), (1.0, 5, 2.0), (1.0, 4, 7.0), (nan, 3, 2.0)]
    frame = pd.DataFrame([("update", k, 1.0, q, i, 0, nan, nan) for k, i, q in rows], columns=["kind", "level_key", "price", "qty", "id", "event_ms", "low_key", "high_key"])
    got = [(str(k), list(zip(run.id.tolist(), map(str, run.qty)))) for k, run in K.Batch([frame]).levels()]
    assert got == [("1.0", [(4, "7.0"), (5, "nan"), (5, "2.0")]), ("nan", [(9, "1.0")]), ("nan", [(3, "2.0")])]
