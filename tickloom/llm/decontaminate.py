"""Benchmark decontamination: find passages of benchmark items in documents and take them out."""

from __future__ import annotations

from collections import defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.text import byte_bounded, utf8

#: Consecutive words of an item that make a window.
WINDOW = 10
#: Bytes of benchmark text up to which its windows are broadcast; beyond it, they are joined. A byte of text comes to about
#: 10 bytes of windows in each worker.
BROADCAST_BYTES = 8 << 20

#: Letters in lower case, digits and bytes from 0x80 on stay; all else separates words.
_PLAIN = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_SCAN = "n_words long, n_hit long, items array<string>, hits array<struct<first: long, last: long>>"
_ITEMS = pa.list_(pa.string())
_HITS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def plain_words(raw: bytes) -> list[bytes]:
    return raw.translate(_PLAIN).split()


def item_windows(words: list[bytes], window: int) -> list[tuple[bytes, ...]]:
    """Windows of one item; an item of fewer words is one window, one without words has none."""
    length = min(window, len(words))
    return [tuple(words[i : i + length]) for i in range(len(words) - length + 1)] if words else []


class Windows:
    """A hash set of windows by length, over ids of the benchmark's own words, in flat tables.

    ``of[first[i]:first[i + 1]]`` are the numbers of the items that have window ``i``.
    """

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({name for name, _ in items if name is not None})
        numbers = {name: i for i, name in enumerate(self.names)}
        number = self.vocabulary.setdefault
        made: dict[int, list[tuple[np.ndarray, int]]] = defaultdict(list)
        for name, raw in items:
            ids = np.array([number(w, len(self.vocabulary) + 1) for w in plain_words(raw)], np.int32)
            if len(ids):
                length = min(window, len(ids))
                made[length].append((np.lib.stride_tricks.sliding_window_view(ids, length), -1 if name is None else numbers[name]))
        self.sets = {}
        for length, parts in sorted(made.items()):
            ids = np.concatenate([x for x, _ in parts])
            item = np.repeat(np.array([i for _, i in parts], np.int32), [len(x) for x, _ in parts])
            hashed = self._hash(ids)
            order = np.lexsort((item, *ids.T, hashed))
            hashed, ids, item = hashed[order], ids[order], item[order]
            new = np.concatenate(([True], (ids[1:] != ids[:-1]).any(axis=1)))
            named = item >= 0
            first = np.append(np.concatenate(([0], np.cumsum(named)))[np.flatnonzero(new)], named.sum())
            self.sets[length] = (hashed[new], ids[new], first, item[named])

    @staticmethod
    def _hash(ids: np.ndarray) -> np.ndarray:
        weights = np.random.default_rng(ids.shape[1]).integers(1, 1 << 62, ids.shape[1]) | 1
        out = np.zeros(len(ids), np.int64)
        for i, weight in enumerate(weights):
            out += ids[:, i] * weight
        return out

    def scan(self, words: list[bytes]) -> tuple[set[str], list[tuple[int, int]]]:
        """Items that have a window in the words, and the word ranges hit (last exclusive, merged)."""
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int32, len(words))
        known = np.concatenate(([0], np.cumsum(ids > 0)))
        items, ranges = set(), []
        for length, (hashed, keys, first, of) in self.sets.items():
            if length > len(words):
                continue
            starts = np.flatnonzero(known[length:] - known[:-length] == length)
            if not len(starts):
                continue
            windows = ids[starts[:, None] + np.arange(length)]
            own = self._hash(windows)
            place = np.searchsorted(hashed, own)
            # windows of one hash lie side by side: step through them until all are compared
            open_ = np.flatnonzero((place < len(hashed)) & (hashed[np.minimum(place, len(hashed) - 1)] == own))
            while len(open_):
                same = (keys[place[open_]] == windows[open_]).all(axis=1)
                for k in np.unique(place[open_[same]]).tolist():
                    items.update(of[first[k] : first[k + 1]].tolist())
                ranges += [(s, s + length) for s in starts[open_[same]].tolist()]
                open_ = open_[~same]
                place[open_] += 1
                open_ = open_[(place[open_] < len(hashed))]
                open_ = open_[hashed[place[open_]] == own[open_]]
        return {self.names[k] for k in items}, merged(ranges)


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(ranges):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Rows of ``docs`` as ``(id_col, text_col, n_words, n_hit, items, hits)``.

    ``items`` are the item ids, sorted as strings, that have a window in the text; ``hits`` the ranges of words
    (last exclusive) inside any occurrence; ``n_hit`` the number of such words. A null or empty text has no words
    and no hits. An item without words has no windows, one with fewer than ``window`` words is one window, and one
    without an id marks words but is not listed. Rows that repeat stay; repeated items count once. Empty tables give no
    rows or no hits. Further columns are not read.

    The windows are broadcast as a hash set of word ids if the benchmark's text has at most ``broadcast_bytes``;
    a larger one is joined on the windows.
    """
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("item_text"))
    rows = byte_bounded(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("item_text") + F.coalesce(F.octet_length("item"), F.lit(0)) + 16)).first()[0] or 0
    out = _by_broadcast(rows, items, window) if size <= broadcast_bytes else _by_join(rows, items, window)
    return out.select(F.col("id").alias(id_col), F.col("text").alias(text_col), "n_words", "n_hit", "items", "hits")


def _batch(batch, found) -> pa.RecordBatch:
    n_words, items, hits = zip(*found)
    n_hit = [sum(b - a for a, b in x) for x in hits]
    columns = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([sorted(x) for x in items], _ITEMS)]
    hits = pa.array([[{"first": a, "last": b} for a, b in x] for x in hits], _HITS)
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, hits], names=["id", "text", "n_words", "n_hit", "items", "hits"])


def _by_broadcast(rows: DataFrame, items: DataFrame, window: int) -> DataFrame:
    gathered = [(x["item"], (x["item_text"] or "").encode()) for x in items.distinct().collect()]
    shared = rows.sparkSession.sparkContext.broadcast(Windows(gathered, window))

    def run(batches):
        windows = shared.value
        for batch in batches:
            found = []
            for raw in utf8(batch.column(1)):
                words = plain_words(raw)
                found.append((len(words), *windows.scan(words)))
            if found:
                yield _batch(batch, found)

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string, {_SCAN}")


def _by_join(rows: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """The same for a benchmark of any size: windows of documents meet the distinct windows of items in a join."""

    def of_items(batches):
        for batch in batches:
            names, out = batch.column(0).to_pylist(), []
            for name, raw in zip(names, utf8(batch.column(1))):
                out += [(name, len(x), b" ".join(x).decode()) for x in item_windows(plain_words(raw), window)]
            columns = zip(*out) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.int64(), pa.string()))], names=["item", "length", "window"])

    windows = byte_bounded(items).mapInArrow(of_items, "item string, length long, window string").distinct()
    lengths = [x[0] for x in windows.select("length").distinct().collect()]  # 1 to window at most

    def of_texts(batches):
        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                words = plain_words(raw)
                for length in lengths:
                    for first in range(0, len(words) - length + 1, 20_000):
                        at = range(first, min(len(words) - length + 1, first + 20_000))
                        own = [b" ".join(words[i : i + length]).decode() for i in at]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([key] * len(own), pa.string()), pa.array(at, pa.int64()), pa.array([length] * len(own), pa.int64()), pa.array(own, pa.string())],
                            names=["key", "first", "length", "window"],
                        )

    # equal texts have equal hits: each text is looked up once
    keyed = rows.withColumn("key", F.sha2(F.coalesce("text", F.lit("")), 256))
    texts = keyed.groupBy("key").agg(F.first("text").alias("text"))
    found = texts.mapInArrow(of_texts, "key string, first long, length long, window string")
    found = found.join(windows.select("window").distinct(), "window", "left_semi")
    per_key = found.groupBy("key").agg(F.collect_list(F.struct("first", (F.col("first") + F.col("length")).alias("last"))).alias("ranges"))
    named = found.select("key", "window").distinct().join(windows.where("item IS NOT NULL"), "window").groupBy("key").agg(F.collect_set("item").alias("names"))
    joined = keyed.join(per_key.join(named, "key", "left"), "key", "left").select("id", "text", "ranges", "names")

    def gather(batches):
        for batch in batches:
            found = []
            for raw, ranges, names in zip(utf8(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                found.append((len(plain_words(raw)), set(names or []), merged([(x["first"], x["last"]) for x in ranges or []])))
            if found:
                yield _batch(batch, found)

    return joined.mapInArrow(gather, f"id {rows.schema['id'].dataType.simpleString()}, text string, {_SCAN}")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", **columns) -> DataFrame:
    """One row a document: ``(id_col, n_words, n_hit, n_items, items_sha256, contaminated)``; see :func:`scan`."""
    found = scan(docs, benchmark, window, id_col, **columns)
    return found.select(
        id_col,
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def without_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", **columns) -> DataFrame:
    """``(id_col, text_col)`` with the words hit, and what stands between them, taken out of each text."""
    found = scan(docs, benchmark, window, id_col, text_col, **columns)

    def run(batches):
        for batch in batches:
            texts = [cut_words(raw, hits or []) for raw, hits in zip(utf8(batch.column(1)), batch.column(2).to_pylist())]
            texts = [None if null else x.decode() for x, null in zip(texts, batch.column(1).is_null().to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    rows = found.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), "hits")
    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string")
    return out.select(F.col("id").alias(id_col), F.col("text").alias(text_col))


def cut_words(raw: bytes, hits: list[dict]) -> bytes:
    """The text without the ranges of words, from each range's first letter to its last."""
    if not hits:
        return raw
    letters = np.frombuffer(raw.translate(_PLAIN), np.uint8) != 0x20
    edges = np.flatnonzero(np.diff(np.concatenate(([False], letters, [False])).astype(np.int8)))
    starts, ends = edges[::2].tolist(), edges[1::2].tolist()
    out, at = [], 0
    for x in hits:
        out.append(raw[at : starts[x["first"]]])
        at = ends[x["last"] - 1]
    return b"".join([*out, raw[at:]])


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", **columns) -> DataFrame:
    """``(id_col, text_col)`` of the documents that have no window of any item."""
    return scan(docs, benchmark, window, id_col, text_col, **columns).where("n_hit = 0").select(id_col, text_col)


