"""Exact substring dedup: remove words inside windows of words that occur more than once."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.text import blocks, byte_bounded, utf8, words_of
from tickloom.session import scratch_table

#: Words of a window.
WINDOW = 35
#: Length from which windows are doubled.
SHORTEST = 18
#: Texts whose windows a task looks up together, in words.
BATCH_WORDS = 400_000
#: Windows of one bucket of the last look-up, about.
BUCKET_WINDOWS = 2_000_000

_HASH = np.dtype([("a", "<u8"), ("b", "<u8")])


def lengths(window: int, shortest: int) -> list[int]:
    """Window lengths, each at most twice the one before: a window is covered by two of the length before it."""
    out = [window]
    while out[0] > shortest:
        out.insert(0, max(shortest, -(-out[0] // 2)))
    return out


def windows_of(words: list[bytes], window: int, length: int):
    """``(first, hashes, chosen)`` for each block of a text: the hashes of its windows of ``length`` words, and for each
    window of ``window`` words from word ``first`` on the place of the one of least hash inside it.

    Equal windows choose equal ones, so a window can only repeat if the one it has chosen repeats.
    """
    for first, joined in blocks(words, window - 1):
        if len(joined.starts) < window:
            return
        hashes = joined.hashes(length)
        inside = np.lib.stride_tricks.sliding_window_view(hashes, window - length + 1)
        chosen = np.concatenate([inside[i : i + 65536].argmin(axis=1) + np.arange(i, min(i + 65536, len(inside))) for i in range(0, len(inside), 65536)])
        yield first, hashes, chosen


def _candidates(words: list[bytes], window: int, length: int, repeated: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Of the window starts in ``runs`` those whose chosen shorter window is among the sorted ``repeated``, as runs."""
    keep = np.zeros(max(0, len(words) - window + 1), bool)
    for first, hashes, chosen in windows_of(words, window, length):
        own = hashes[chosen]
        at = np.minimum(np.searchsorted(repeated, own), len(repeated) - 1)
        keep[first : first + len(own)] = repeated[at] == own
    return as_runs(keep & of_runs(runs, len(keep)))


def as_runs(flags: np.ndarray) -> np.ndarray:
    """First and last (exclusive) place of each run of true flags, flat."""
    return np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))


def of_runs(runs: np.ndarray, n: int) -> np.ndarray:
    """The flags of :func:`as_runs`; no runs at all stand for every place."""
    if not len(runs):
        return np.ones(n, bool)
    edges = np.zeros(n + 1, np.int32)
    np.add.at(edges, runs[::2], 1)
    np.add.at(edges, runs[1::2], -1)
    return np.cumsum(edges)[:n] > 0


def _level(texts: DataFrame, classes: DataFrame, window: int, length: int) -> DataFrame:
    """Texts that keep candidate windows after a look at shorter windows of ``length`` words, with the runs of these.

    ``texts`` has ``(name, digest, key, copies, text, runs)``. Each batch of texts counts its own chosen windows first and sends one
    row a hash and batch, so that a passage which everyone shares comes to as many rows as there are batches. What a batch
    knows to repeat goes along as one row a text.
    """

    def choose(batches):
        for batch in batches:
            own, of = [], []
            for i, (raw, runs) in enumerate(zip(utf8(batch.column(1)), batch.column(2).to_pylist())):
                words, keep = words_of(raw), np.array(runs or [], np.int64)
                found = [hashes[np.unique(chosen[of_runs(keep, len(words) - window + 1)[first : first + len(chosen)]])] for first, hashes, chosen in windows_of(words, window, length)]
                if found:
                    # blocks of a text share windows: one place is sent once
                    own.append(np.concatenate(found))
                    of.append(np.full(len(own[-1]), i))
            if not own:
                continue
            hashes, rows = np.concatenate(own), np.concatenate(of)
            copies = batch.column(3).to_numpy()[rows] > 1
            order = np.argsort(hashes, kind="stable")
            hashes, rows, copies = hashes[order], rows[order], copies[order]
            new = np.concatenate(([True], hashes[1:] != hashes[:-1]))
            group = np.cumsum(new) - 1
            sure = (np.bincount(group) > 1) | (np.bincount(group, copies) > 0)
            lead = np.flatnonzero(new)
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            asked = hashes[lead].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(asked), pa.array(keys[rows[lead]]), pa.array(sure), pa.nulls(len(lead), pa.binary())], names=["hash", "key", "sure", "known"])
            known = sure[group]
            by_text = np.argsort(rows[known], kind="stable")
            kept, mine = hashes[known][by_text], rows[known][by_text]
            texts_of, starts = np.unique(mine, return_index=True)
            blobs = [np.unique(x).tobytes() for x in np.split(kept, starts[1:])] if len(texts_of) else []
            sent = np.array(keys[texts_of], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(sent), pa.array(sent), pa.array(np.zeros(len(sent), bool)), pa.array(blobs, pa.binary())], names=["hash", "key", "sure", "known"])

    looked_up = texts.select("key", "text", "runs", "copies").mapInArrow(choose, "hash long, key long, sure boolean, known binary")
    groups = "OVER (PARTITION BY hash, known IS NULL)"
    looked_up = looked_up.selectExpr("hash", "key", "known", f"known IS NOT NULL OR count(*) {groups} > 1 OR max(sure) {groups} AS repeated")
    repeated = looked_up.where("repeated").groupBy("key").agg(F.collect_list(F.when(F.col("known").isNull(), F.col("hash"))).alias("hashes"), F.collect_list("known").alias("known"))
    # back to the texts by the columns that these are dealt by already
    repeated = repeated.join(classes.select("key", "name", "digest"), "key").drop("key")

    def narrow(batches):
        for batch in batches:
            runs = []
            for raw, before, hashes, known in zip(utf8(batch.column(4)), *(batch.column(i).to_pylist() for i in (5, 6, 7))):
                found = np.unique(np.concatenate([np.array(hashes, np.int64).view(np.uint64), *(np.frombuffer(x, np.uint64) for x in known)]))
                runs.append(_candidates(words_of(raw), window, length, found, np.array(before or [], np.int64)))
            keep = np.flatnonzero([len(x) > 0 for x in runs])
            if len(keep):
                taken = batch.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([*taken.columns[:5], pa.array([runs[i] for i in keep], pa.list_(pa.int64()))], names=["name", "digest", "key", "copies", "text", "runs"])

    joined = texts.join(repeated, ["name", "digest"]).select("name", "digest", "key", "copies", "text", "runs", "hashes", "known")
    return joined.mapInArrow(narrow, "name string, digest string, key long, copies long, text string, runs array<long>")


def _asked(raw: bytes, runs: np.ndarray, window: int) -> np.ndarray:
    """128-bit hashes of the candidate windows of one text, in order."""
    out = []
    words = words_of(raw)
    flags = of_runs(runs, len(words) - window + 1)
    for first, joined in blocks(words, window - 1):
        at = np.flatnonzero(flags[first : first + len(joined.starts) - window + 1])
        out.append(b"".join([xxhash.xxh3_128_digest(x) for x in joined.slices(window, at)]))
    return np.frombuffer(b"".join(out), _HASH)


def _removed(texts: DataFrame, window: int) -> DataFrame:
    """``(key, n_removed, kept_sha256, kept)`` of the texts that lose words, from their candidate windows.

    Texts are put together in batches and written with the hashes of their candidate windows, one sorted blob for each
    batch and bucket of hashes. Buckets count, and answer with one bit a hash; the batch then knows its windows.
    """
    windows = "coalesce(aggregate(sequence(0, size(runs) - 2, 2), 0L, (s, i) -> s + runs[i + 1] - runs[i]), octet_length(text))"
    total = texts.select(F.sum(F.expr(windows))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_WINDOWS))

    def ask(batches):
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        schema = [("batch", pa.int64()), ("bucket", pa.int64()), ("hashes", pa.binary()), ("sure", pa.binary()), ("key", pa.int64()), ("copies", pa.int64()), ("text", pa.string()), ("runs", pa.list_(pa.int64()))]
        schema = pa.schema(schema)
        for batch in batches:
            for rows in _by_words(batch):
                name = part << 32 | number
                number += 1
                rows = rows.to_pylist()
                hashes = [_asked(x["text"].encode(), np.array(x["runs"] or [], np.int64), window) for x in rows]
                own, counts = np.unique(np.concatenate(hashes), return_counts=True)
                sure = counts > 1
                for x, mine in zip(rows, hashes):
                    if x["copies"] > 1:
                        sure[np.searchsorted(own, mine)] = True
                of = own["a"] % np.uint64(buckets)
                out = [{"batch": name, "bucket": b, "hashes": own[of == b].tobytes(), "sure": np.packbits(sure[of == b]).tobytes()} for b in np.unique(of).tolist()]
                yield pa.RecordBatch.from_pylist([*out, *({"batch": name, **x} for x in rows)], schema=schema)

    kinds = "batch long, bucket long, hashes binary, sure binary, key long, copies long, text string, runs array<long>"
    asked = scratch_table(texts.select("key", "copies", "text", "runs").mapInArrow(ask, kinds))

    def answer(batches):
        """A bucket's blobs: once to count, once to answer."""
        for bucket in _whole_buckets(batches):
            every = np.concatenate([np.frombuffer(x, _HASH) for x in bucket["hashes"]])
            sure = np.concatenate([np.unpackbits(np.frombuffer(s, np.uint8), count=len(h) // 16) for h, s in zip(bucket["hashes"], bucket["sure"])])
            order = np.argsort(every, order=("a", "b"), kind="stable")
            every = every[order]
            group = np.cumsum(np.concatenate(([True], every[1:] != every[:-1]))) - 1
            repeated = (np.bincount(group) > 1) | (np.bincount(group, sure[order]) > 0)
            flags = np.zeros(len(every), bool)
            flags[order] = repeated[group]
            ends = np.cumsum([len(h) // 16 for h in bucket["hashes"]])
            bits = [np.packbits(x).tobytes() for x in np.split(flags, ends[:-1])]
            n = len(bits)
            yield pa.RecordBatch.from_arrays([pa.array(bucket["batch"], pa.int64()), pa.array([bucket["bucket"]] * n, pa.int64()), pa.array(bits, pa.binary())], names=["batch", "bucket", "bits"])

    questions = byte_bounded(asked).where("hashes IS NOT NULL").select("bucket", "batch", "hashes", "sure")
    answers = questions.repartition("bucket").sortWithinPartitions("bucket", "batch").mapInArrow(answer, "batch long, bucket long, bits binary")

    def apply(batches):
        for rows in _whole_batches(batches):
            bits = {x["bucket"]: np.frombuffer(x["bits"], np.uint8) for x in rows if x["bits"] is not None}
            texts_ = [x for x in rows if x["bits"] is None]
            hashes = [_asked(x["text"].encode(), np.array(x["runs"] or [], np.int64), window) for x in texts_]
            own = np.unique(np.concatenate(hashes))
            of = own["a"] % np.uint64(buckets)
            flags = np.zeros(len(own), bool)
            for b in np.unique(of).tolist():
                at = np.flatnonzero(of == b)
                flags[at] = np.unpackbits(bits[b], count=len(at)).astype(bool)
            out = []
            for x, mine in zip(texts_, hashes):
                words = words_of(x["text"].encode())
                starts = np.flatnonzero(of_runs(np.array(x["runs"] or [], np.int64), len(words) - window + 1))
                starts = starts[flags[np.searchsorted(own, mine)]]
                edges = np.zeros(len(words) + 1, np.int32)
                np.add.at(edges, starts, 1)
                np.add.at(edges, starts + window, -1)
                gone = np.cumsum(edges)[:-1] > 0
                if gone.any():
                    kept = b" ".join([words[i] for i in np.flatnonzero(~gone).tolist()])
                    out.append({"key": x["key"], "n_removed": int(gone.sum()), "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept.decode()})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("key", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())]))

    # answers come before the texts of their batch
    back = answers.selectExpr("batch", "bucket", "bits", "NULL AS key", "NULL AS text", "NULL AS runs")
    mine = asked.where("hashes IS NULL").selectExpr("batch", "NULL AS bucket", "NULL AS bits", "key", "text", "runs")
    both = back.union(mine).repartition("batch").sortWithinPartitions("batch", "key")
    return both.mapInArrow(apply, "key long, n_removed long, kept_sha256 string, kept string")


def _by_words(batch: pa.RecordBatch):
    """Runs of rows of about ``BATCH_WORDS`` words."""
    sizes = np.cumsum([len(x) for x in utf8(batch.column(2))]) // (6 * BATCH_WORDS)
    edges = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def _whole_buckets(batches):
    held: dict = {}
    for batch in batches:
        for x in batch.to_pylist():
            if held and held["bucket"] != x["bucket"]:
                yield held
                held = {}
            held = held or {"bucket": x["bucket"], "batch": [], "hashes": [], "sure": []}
            for name in ("batch", "hashes", "sure"):
                held[name].append(x[name])
    if held:
        yield held


def _whole_batches(batches):
    held: list = []
    for batch in batches:
        for x in batch.to_pylist():
            if held and held[0]["batch"] != x["batch"]:
                yield held
                held = []
            held.append(x)
    if held:
        yield held


def without_repeats(docs: DataFrame, window: int = WINDOW, shortest: int = SHORTEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` as ``(id_col, n_words, n_removed, kept_sha256, kept)``.

    A word is removed if it lies in a window of ``window`` words whose word sequence starts anywhere else too, in the same
    text or another. ``kept`` are the other words joined by one space where words were removed and some are left, else
    null; ``kept_sha256`` is its digest in every case. Null and empty texts have no words; texts shorter than a window
    lose nothing; copies of a text lose all words if it has a window. Rows that repeat are copies. An empty table gives
    an empty result; further columns are not read.

    Level by level: windows of ``shortest`` words that repeat are extended to twice that length, and so on up to ``window``;
    a text without candidates is left behind. Below the last level each longer window is judged by the window of
    least hash inside it, about one in ten, and a hash that happens to agree only costs a later look. The last level
    compares 128-bit hashes of all windows that are left. Copies of a text are looked up once.
    """
    rows = byte_bounded(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("id", F.coalesce(F.col("id").cast("string"), F.lit("")).alias("name"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"), "text")

    def measure(batches):
        for batch in batches:
            words = [words_of(raw) for raw in utf8(batch.column(3))]
            shas = [hashlib.sha256(b" ".join(x)).hexdigest() for x in words]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(map(len, words), pa.int64()), pa.array(shas, pa.string())], names=["id", "name", "digest", "n_words", "sha"])

    kind = rows.schema["id"].dataType.simpleString()
    measured = scratch_table(rows.mapInArrow(measure, f"id {kind}, name string, digest string, n_words long, sha string"))
    # one row of each text stands for its copies; keys number the texts that are long enough
    classes = measured.where(F.col("n_words") >= window).groupBy("digest").agg(F.count("*").alias("copies"), F.min("name").alias("name"))
    classes = scratch_table(classes.withColumn("key", F.monotonically_increasing_id()))
    texts = rows.join(classes, ["name", "digest"])
    texts = texts.select("name", "digest", "key", "copies", "text", F.lit(None).cast("array<long>").alias("runs"))
    for level in lengths(window, min(shortest, (window + 1) // 2))[:-1]:
        texts = scratch_table(_level(texts, classes, window, level))
    # a text that stands in several equal rows comes several times; its copies are removed whole in any case
    removed = scratch_table(_removed(texts, window)).join(classes.where("copies = 1").select("key", "digest"), "key").drop("key")
    copies = classes.where("copies > 1").select("digest", F.lit(True).alias("copied"))
    out = measured.join(copies, "digest", "left").join(removed, "digest", "left")
    copied, lost = F.col("copied").isNotNull(), F.col("n_removed").isNotNull()
    return out.select(
        F.col("id").alias(id_col),
        "n_words",
        F.when(copied, F.col("n_words")).when(lost, F.col("n_removed")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(copied, F.sha2(F.lit(""), 256)).when(lost, F.col("kept_sha256")).otherwise(F.col("sha")).alias("kept_sha256"),
        F.when(~copied, F.col("kept")).alias("kept"),
    )
