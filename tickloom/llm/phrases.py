"""Phrase collocations by Toivonen's method: a sample proposes phrases, full passes count them, their negative border and what its failures ask for."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.llm.sketch import Filter, filter_of
from tickloom.llm.text import byte_bounded, mixed, utf8
from tickloom.session import scratch_table

#: Words of the longest phrase.
LONGEST = 5
#: Occurrences a phrase needs.
LEAST = 100
#: One text in so many is in the sample.
SAMPLE_EVERY = 8
#: A phrase is proposed if the sample has as many as its share of ``LEAST``, less so many standard deviations.
SLACK = 0.5
#: Phrases of a language in the report.
TOP = 2000
#: Words a task counts together.
BLOCK_WORDS = 1_500_000
#: Counts that a task holds, and their bytes, to join those of equal phrases of its blocks.
HELD_COUNTS, HELD_BYTES = 1 << 20, 64 << 20
#: Bytes of a text that are split into words together.
SPLIT_BYTES = 1 << 20

#: A-Z to a-z, the marks that end a piece to line ends, tabs to spaces.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\x0d\x09", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n ")
_MULT = np.uint64(0x9E3779B97F4A7C15)
_END, _NONE = 0, 1  # ids of the end of a piece and of what is between two spaces


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self)
        return found


class Words:
    """The words of a block of texts as ids, equal for equal words."""

    def __init__(self):
        self.ids = _Ids({b"\n": _END, b"": _NONE})
        self.blocks: list[np.ndarray] = []
        self.size = 0

    def add(self, raw: bytes) -> int:
        """The words of a text; a piece ends at its marks and at the end of the text. Returns their number."""
        plain = raw.translate(_PLAIN)
        at, n = 0, 0
        while at < len(plain):
            end = plain.find(b" ", at + SPLIT_BYTES)
            end = len(plain) if end < 0 else end
            tokens = plain[at:end].replace(b"\n", b" \n ").split(b" ")
            found = np.fromiter(map(self.ids.__getitem__, tokens), np.int64, len(tokens))
            found = found[found != _NONE]
            self.blocks.append(found)
            n += len(found)
            at = end
        self.blocks.append(np.array([_END]))
        self.size += n
        return n

    def taken(self) -> tuple[np.ndarray, list[bytes]]:
        """Ids of all words in order, and the words by id."""
        return np.concatenate(self.blocks), list(self.ids)


def seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode(), 7)


def word_hashes(words: list[bytes], lang: str) -> np.ndarray:
    own = seed(lang)
    return np.array([xxhash.xxh64_intdigest(w, own) for w in words], np.uint64)


def longer(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of phrases with one more word."""
    return mixed(hashes * _MULT + words)


def counted(tokens: np.ndarray, words: list[bytes], lang: str, longest: int, wanted: Filter | None = None, frequent: Filter | None = None):
    """``(length, places, counts, hashes)`` of the different phrases of each length that a pass counts; a place is where one begins.

    The first pass counts what is ``wanted`` (None is all) and its border: words, and phrases all of whose parts are wanted.
    The last one knows which of these are ``frequent``. It counts them, and also phrases that the first did not count though no part of them was found rare; so a phrase around a border phrase that proved frequent is counted, and so are those around it, whatever their length.
    Ids are exact: a phrase is known by the id of the phrase without its last word and by that word.
    """
    by_word = word_hashes(words, lang)[tokens]
    at = np.flatnonzero(tokens != _END)
    ids, hashes, had = tokens[at], by_word[at], np.ones(len(at), bool)
    for length in range(1, longest + 1):
        if length > 1:
            # a phrase is two shorter ones, of which the second begins a word later
            pair = np.flatnonzero(at[1:] == at[:-1] + 1)
            if wanted is not None:
                known = wanted.has(hashes)
                if frequent is None:
                    pair = pair[known[pair] & known[pair + 1]]
                else:
                    known &= had
                    had = known[pair] & known[pair + 1]
            at, ids, hashes = at[pair], ids[pair], hashes[pair]
            last = at + length - 1
            ids, hashes = ids * np.int64(len(words)) + tokens[last], longer(hashes, by_word[last])
        if frequent is not None:
            alive = ~had | frequent.has(hashes)
            at, ids, hashes, had = at[alive], ids[alive], hashes[alive], had[alive]
        if not len(at):
            return
        ids, found = pd.factorize(ids)
        first = np.empty(len(found), np.int64)
        first[ids[::-1]] = np.arange(len(ids) - 1, -1, -1)
        yield length, at[first], np.bincount(ids, minlength=len(found)), hashes[first]


def _blocks(batches) -> Iterator[tuple[str, int, np.ndarray, list[bytes]]]:
    """``(lang, number of words, ids, words)`` of many texts at once, from batches of languages and texts."""
    held: dict[str, Words] = {}
    size = 0
    for batch in batches:
        for lang, raw in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
            if lang not in held:
                held[lang] = Words()
            size += held[lang].add(raw)
            if size >= BLOCK_WORDS:
                yield from _taken(held)
                size = 0
    yield from _taken(held)


def _taken(held: dict[str, Words]) -> Iterator[tuple[str, int, np.ndarray, list[bytes]]]:
    for name in list(held):
        own = held.pop(name)
        tokens, words = own.taken()
        yield name, int(np.count_nonzero(tokens != _END)), tokens, words


def hashed_counts(rows: DataFrame, longest: int, wanted: Filter | None, least: int) -> DataFrame:
    """``hash`` of the phrases that a pass finds ``least`` times; equal hashes of different phrases only find too much."""
    shared = rows.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        for lang, _, tokens, words in _blocks(batches):
            for _, _, n, hashes in counted(tokens, words, lang, longest, shared.value):
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n.astype(np.int64))], names=["hash", "n"])

    found = rows.select("lang", "text").mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    return scratch_table(found.where(F.col("n") >= least).select("hash"))


def exact_counts(rows: DataFrame, longest: int, wanted: Filter, found: Filter, least: int) -> DataFrame:
    """``(lang, length, phrase, f)`` of all phrases that occur ``least`` times, counted by their words; the phrase of no words counts all words."""
    shared = rows.sparkSession.sparkContext.broadcast((wanted, found))

    def counts_of(batches):
        for lang, total, tokens, words in _blocks(batches):
            text = pa.array(words, pa.binary())
            yield _counts(lang, pa.array([b""], pa.binary()), np.array([total]))
            for length, at, n, _ in counted(tokens, words, lang, longest, *shared.value):
                for lo in range(0, len(at), 1 << 18):
                    own = at[lo : lo + (1 << 18)]
                    parts = [text.take(pa.array(tokens[own + k])) for k in range(length)]
                    yield _counts(lang, parts[0] if length == 1 else pc.binary_join_element_wise(*parts, b" "), n[lo : lo + (1 << 18)])

    run = lambda batches: joined_counts(counts_of(batches))
    counts = rows.select("lang", "text").mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
    length = F.when(F.col("phrase") == "", 0).otherwise(F.length("phrase") - F.length(F.translate("phrase", " ", "")) + 1)
    return scratch_table(counts.where(F.col("f") >= least).select("lang", length.alias("length"), "phrase", "f"))


def _counts(lang: str, phrases: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([lang] * len(n), pa.string()), phrases.cast(pa.string(), safe=False), pa.array(n.astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "n"])


def joined_counts(counts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts with those of equal phrases added up, as far as what is held allows: a frequent phrase leaves a task once, not once a block."""
    held: list[pa.RecordBatch] = []
    for batch in counts:
        held.append(batch)
        if _full(held, 1):
            held = _added(held)
            if _full(held, 2):  # mostly different phrases: holding on would add up the same ones again and again
                yield from held
                held = []
    if held:
        yield from _added(held)


def _full(held: list[pa.RecordBatch], share: int) -> bool:
    return share * sum(b.num_rows for b in held) >= HELD_COUNTS or share * sum(b.nbytes for b in held) >= HELD_BYTES


def _added(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    found = pa.Table.from_batches(held).group_by(["lang", "phrase"], use_threads=False).aggregate([("n", "sum")])
    return found.select(["lang", "phrase", "n_sum"]).rename_columns(["lang", "phrase", "n"]).to_batches(max_chunksize=1 << 18)


def frequent(rows: DataFrame, longest: int, least: int, every: int, slack: float) -> DataFrame:
    """``(lang, length, phrase, f)`` of all phrases that occur ``least`` times.

    A sample proposes phrases. The first pass counts these and their negative border, the phrases that are not proposed though all their parts are, by hashes. The second is the expansion: it counts
    by words what the first found frequent, and the phrases around border phrases that proved frequent. All parts of a frequent phrase are frequent, so the first pass
    has found those that it counted, and the second counts the phrase: after it none is left.
    """
    share = least / every
    sample = rows.where(F.pmod(F.xxhash64("lang", "text", "id"), F.lit(every)) == 0)
    wanted = filter_of(hashed_counts(sample, longest, None, max(1, int(share - slack * share**0.5))))
    found = filter_of(hashed_counts(rows, longest, wanted, least))
    return exact_counts(rows, longest, wanted, found, least)


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    id_col: str = "doc_id",
    longest: int = LONGEST,
    least: int = LEAST,
    absorb_percent: int = 100,
    top: int | None = TOP,
    every: int = SAMPLE_EVERY,
    slack: float = SLACK,
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the phrases whose weakest cut is strongest, for each language.

    Texts are lower-cased (A-Z) and split at marks and line ends into pieces; phrases are 2 to ``longest`` neighbouring words of a piece with ``a >= least``
    occurrences, overlaps included. ``n`` counts all words of the language; a cut into parts that occur ``l`` and ``r`` times scores
    ``floor(1000 a n / (l r))`` in whole numbers of up to 38 digits, and the least cut counts, ties to the first. Phrases inside a longer one with ``absorb_percent`` of their occurrences
    are left out. Ranks go by score, occurrences and phrase; ``top`` of None returns all. Null languages are ``und``, null texts empty. Rows that
    repeat count each time. An empty table gives no rows; further columns are not read.
    """
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    rows = byte_bounded(docs).select(lang.alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(id_col).alias("id"))
    known = frequent(rows, longest, least, every, slack)
    totals = known.where("length = 0").select("lang", F.col("f").alias("n"))
    long = known.where("length > 1")
    inside = long.select(
        "lang", F.col("f").alias("more"), F.explode(F.array(F.expr("substring_index(phrase, ' ', length - 1)"), F.expr("substring_index(phrase, ' ', 1 - length)"))).alias("phrase")
    )
    inside = inside.groupBy("lang", "phrase").agg(F.max("more").alias("more"))
    kept = long.join(inside, ["lang", "phrase"], "left").where(F.col("more").isNull() | (100 * F.col("more") < absorb_percent * F.col("f"))).drop("more")
    cuts = kept.select("*", F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k"))
    cuts = cuts.select("*", F.expr("substring_index(phrase, ' ', k)").alias("head"), F.expr("substring_index(phrase, ' ', k - length)").alias("tail"))
    side = lambda part, name: known.select("lang", F.col("phrase").alias(part), F.col("f").alias(name))
    cuts = cuts.join(side("head", "l"), ["lang", "head"]).join(side("tail", "r"), ["lang", "tail"]).join(totals, "lang")
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    over = (whole("f") * whole("n")).cast("decimal(35,0)") * F.lit(1000).cast("decimal(4,0)")
    cuts = cuts.withColumn("score", F.call_function("div", over.cast("decimal(38,0)"), (whole("l") * whole("r")).cast("decimal(38,0)")))
    best = cuts.groupBy("lang", "phrase", "f", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    best = best.select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order).cast("long"))
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

