"""Near copies of the pipeline against brute-force Jaccard similarity."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_texts import UPPER

import corpus_pipeline
from tickloom.llm import overlap, simhash

SF_DIR = "/root/testdata/sf0.01"


def plain_groups(rows):
    """(id, smallest id of its group) by comparing all pairs."""
    sets = {}
    for i, x in rows:
        w = [x for x in (x or "").translate(UPPER).replace("\t", " ").replace("\n", " ").split(" ") if x]
        sets.setdefault(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset(), []).append(i)
    every = list(sets)
    group = list(range(len(every)))

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    for i, x in enumerate(every):
        for j, y in enumerate(every[:i]):
            if 4 * max(len(x), len(y)) <= 5 * min(len(x), len(y)):
                both = len(x & y)
                if both and 5 * both >= 4 * (len(x) + len(y) - both):
                    group[root(i)] = root(j)
    best = {}
    for k, x in enumerate(every):
        ids = [i for i in [*sets[x], best.get(root(k))] if i is not None]
        best[root(k)] = min(ids, default=None)
    return Counter((i, best[root(k)]) for k, x in enumerate(every) for i in sets[x])


@pytest.fixture(scope="session")
def edited():
    """Copies of texts with up to a fifth of the shingles changed, on both sides of the limit, and heaps of such."""
    rng = random.Random(11)
    words = [f"v{i}" for i in range(400)]
    line = " ".join(rng.choice(words) for _ in range(30))
    rows = []
    for length in (1, 4, 5, 6, 9, 30, 90, 200, 700):
        for _ in range(3):
            text = [rng.choice(words) for _ in range(length)]
            for _ in range(8):
                own = list(text)
                for k in rng.sample(range(length), min(length, rng.randrange(0, 3 + length // 40))):
                    own[k] = "x" + rng.choice(words)
                rows.append((len(rows), " ".join(own) + (f" {line}" if rng.random() < 0.3 else "")))
    return rows


@pytest.mark.parametrize("every, slot_rows, bits", [(16, 1000, (64, 1 << 16)), (1, 5, (64, 128))])
def test_near_copies(docs_of, sample, edited, monkeypatch, every, slot_rows, bits):
    """Whatever is known of common shingles, with buckets in slots and images that are too small."""
    monkeypatch.setattr(overlap, "SAMPLE_EVERY", every)
    monkeypatch.setattr(overlap, "SLOT_ROWS", slot_rows)
    monkeypatch.setattr(overlap, "IMAGE_BITS", bits)
    rows = sample + [(None if i is None else 1000 + i, x) for i, x in edited]
    want = plain_groups(rows)
    got = Counter(tuple(r) for r in overlap.near_copies(docs_of(rows)).collect())
    assert got == want
    assert 20 < len({g for _, g in want}) < len(rows) - 60
    assert overlap.near_copies(docs_of([])).count() == 0


def test_pipeline_keeps_one_of_each_group(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = {g for _, g in plain_groups(rows)}
    assert {r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, SF_DIR).collect()} == want
    # the groups of op1 are others
    assert want != {r.component_id for r in simhash.near_duplicates(docs).collect()}


def test_pipeline_checks_the_groups_of_op1(spark, monkeypatch):
    """The fingerprint join is a step of the stage, and what it links is checked by whole sets."""
    near = " ".join(f"w{i}" for i in range(60))
    texts = [near, near + " more", "w0 w1", "w1 w0 other words altogether", None, ""]
    docs = spark.createDataFrame([(i, x, "en", "s", 1) for i, x in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    joined, linked = [], simhash.near_duplicates

    def one_group(*args):
        groups = linked(*args)
        joined.append({r.row.doc_id for r in groups.collect()})
        return groups.withColumn("component_id", F.lit(0))

    monkeypatch.setattr(simhash, "near_duplicates", one_group)
    kept = {r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, "").collect()}
    assert joined == [set(range(6))]
    assert kept == {0, 2, 3, 4}


def test_pipeline_keeps_rows_that_differ_by_what_is_null(spark):
    """Rows of one id and of different texts stay, also where one has in a column what the other has as its text."""
    plain = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "one", None, "s", 3), (1, None, "one", "s", 3), (None, "some other text", None, "s", 3), (None, None, "some other text", "s", 3), (2, "two", None, None, 3), (2, "two", None, None, 3)]
    kept = Counter((r.doc_id, r.text) for r in corpus_pipeline.one_of_each(spark, spark.createDataFrame(rows, plain), "").collect())
    # a row without an id gives way to the other one without words
    assert kept == Counter([(1, "one"), (1, None), (None, "some other text"), (2, "two")])


def test_members_of_op1_groups_are_joined_without_their_leader(docs_of, spark):
    """Of a given group, members that are similar to each other, and not to the one they are compared with first, are joined too."""
    rng = random.Random(3)
    words = [f"v{i}" for i in range(500)]
    rows = []
    for _ in range(12):
        text = [rng.choice(words) for _ in range(rng.randrange(20, 90))]
        for k in range(4):
            rows.append((len(rows), " ".join(text[: len(text) - k])))
    given = spark.createDataFrame([(i, 0) for i, _ in rows], "id long, g long")
    got = Counter(tuple(r) for r in overlap.near_copies(docs_of(rows), groups=given).collect())
    assert got == plain_groups(rows) and len({g for _, g in got}) == 12


def test_given_groups_lead(docs_of, sample, spark):
    """Pairs of given groups are compared even where nothing else makes a pair; the groups stay those of the similarity."""
    text = lambda *w: " ".join(w)
    base = [f"w{i}" for i in range(100)]
    rows = [(1, text(*base)), (2, text(*base[:95])), (3, text("other", "words", "here"))]
    sketches = overlap._sketches(docs_of(rows).select(F.col("doc_id").alias("id"), "text"), overlap.SHINGLE)
    pairs = overlap._named(sketches, spark.createDataFrame([(1, 7), (2, 7), (3, 7), (9, 7)], "id long, g long"))
    key = {r.id: r.key for r in sketches.collect()}
    assert {tuple(r) for r in pairs.collect()} <= {tuple(sorted((key[a], key[b]))) for a, b in ((1, 2), (1, 3), (2, 3))}
    given = spark.createDataFrame([(i, 0) for i, _ in sample if i is not None], "id long, g long")
    assert Counter(tuple(r) for r in overlap.near_copies(docs_of(sample), groups=given).collect()) == plain_groups(sample)
