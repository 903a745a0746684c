"""Collocations against plain counts of all phrases."""

import random
import re
from collections import Counter

import pytest

from tickloom.llm import phrases, sketch

UPPER = {i: i + 32 for i in range(65, 91)}


def plain_collocations(rows, least, percent=100, top=None, longest=5):
    found, words = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(UPPER)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            words[lang] += len(w)
            own = found.setdefault(lang, Counter())
            for k in range(1, longest + 1):
                own.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in found.items():
        known = {p for p, n in f.items() if n >= least}
        covered = {q for p in known if len(p) > 1 for i in range(len(p)) for j in range(i + 1, len(p) + 1) if j - i < len(p) for q in [p[i:j]] if 100 * f[p] >= percent * f[q]}
        rows = []
        for p in known - covered:
            if len(p) > 1:
                n = words[lang]
                score, _, l, r = min((1000 * f[p] * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -f[p], " ".join(p).encode(), l, r, n))
        for rank, (score, a, p, l, r, n) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n, -score))
    return set(out)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["Étude", "ß", "naïve x", "a\x1cb"]
    weights = [1 / (i + 1) for i in range(len(words))]
    pick = lambda n: rng.choices(words, weights, k=n)
    fixed = ["once upon a time there", "New York City", "of the people", "very very very"]
    rows = []
    for i in range(400):
        parts = pick(rng.randrange(0, 40))
        for _ in range(rng.randrange(0, 4)):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(fixed))
        for _ in range(rng.randrange(0, 5)):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice([".", ",", "; ", "!?", "\n", "\r\n", "\t", "  "]))
        rows.append((rng.choice(["en", "en", "de", None]), " ".join(parts)))
    rows += [("en", "the same text again and again")] * 120
    rows += [("fr", None), (None, None), ("fr", ""), ("fr", " \t\n.,"), ("it", "uno due tre")]
    rows.append(("en", "bla bla blub " * 20_000 + "x" * 3_000_000))
    return rows


@pytest.mark.parametrize("least, every, slack, bits", [(30, 8, 1.5, (16, 28)), (30, 50, 0.0, (16, 28)), (30, 10**9, 0.0, (16, 28)), (12, 8, 1.5, (6, 8))])
def test_collocations(spark, monkeypatch, texts, least, every, slack, bits):
    """Whatever the sample proposes, and however full the filter is."""
    monkeypatch.setattr(sketch, "FILTER_BITS", bits)
    monkeypatch.setattr(phrases, "BLOCK_WORDS", 5000)
    table = spark.createDataFrame([(i, t, x, "?", 1, "?", 2) for i, (x, t) in enumerate(texts)], "doc_id long, text string, lang string, phrase string, n int, hash string, length int").repartition(5)
    got = phrases.collocations(table, least=least, every=every, slack=slack, top=40)
    assert {tuple(r) for r in got.collect()} == plain_collocations(texts, least, top=40)
    assert phrases.collocations(table.limit(0)).count() == 0


def test_border_failures_are_expanded(spark, texts):
    """An empty sample proposes nothing, so all but single words hang on the expansion; a full one leaves nothing to it."""
    table = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(texts)], "id long, text string, lang string").where("lang IS NOT NULL AND text IS NOT NULL")
    few = phrases.frequent(table.select("lang", "text", "id"), 5, 30, 10**9, 0.0)
    full = phrases.frequent(table.select("lang", "text", "id"), 5, 30, 1, 0.0)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, full.collect()))
    assert few.where("length = 5").count() > 0


def test_absorbed_by_share(spark, texts):
    table = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(texts)], "doc_id long, text string, lang string")
    got = phrases.collocations(table, least=20, absorb_percent=60, top=None, longest=4)
    assert {tuple(r) for r in got.collect()} == plain_collocations(texts, 20, 60, longest=4)


def test_scores_beyond_64_bits(spark):
    rows = [("en", "a b " * 60_000 + ". " + "c " * 150_000)]
    table = spark.createDataFrame([(0, rows[0][1], "en")], "doc_id long, text string, lang string")
    got = {tuple(r) for r in phrases.collocations(table, least=100).collect()}
    assert got == plain_collocations(rows, 100) and len(got) > 2


def test_counts_of_a_task_are_joined(monkeypatch):
    """Equal phrases of several blocks leave the task as one row; what is held is bounded, and nothing is lost."""
    import numpy as np
    import pyarrow as pa

    blocks = [phrases._counts(lang, pa.array([b"a b", b"c", f"own {i}".encode()], pa.binary()), np.array([2, 3, 1])) for i in range(50) for lang in ("en", "de")]
    rows = lambda found: [tuple(r.values()) for b in found for r in b.to_pylist()]
    whole = rows(phrases.joined_counts(iter(blocks)))
    assert len(whole) == 2 * 52 and ("en", "a b", 100) in whole and ("de", "c", 150) in whole
    monkeypatch.setattr(phrases, "HELD_COUNTS", 20)
    total = Counter()
    for lang, phrase, n in rows(phrases.joined_counts(iter(blocks))):
        total[lang, phrase] += n
    assert sorted((*k, n) for k, n in total.items()) == sorted(whole)
    assert list(phrases.joined_counts([])) == []


def test_a_frequent_phrase_leaves_a_task_once(spark, monkeypatch, texts):
    """However many blocks a task has."""
    monkeypatch.setattr(phrases, "BLOCK_WORDS", 2000)
    table = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(texts)], "id long, text string, lang string").where("lang = 'en' AND text IS NOT NULL").repartition(1)
    added = phrases.joined_counts
    counted = spark.sparkContext.accumulator(0)

    def noted(counts):
        for batch in added(counts):
            counted.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(phrases, "joined_counts", noted)
    found = sketch.filter_of(phrases.hashed_counts(table, 1, None, 30))
    made = phrases.exact_counts(table, 1, found, found, 1)
    assert counted.value == made.count() > 30
