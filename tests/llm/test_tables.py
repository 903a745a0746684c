"""Token counts, packing, quality, top-k, archives and the pipeline."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F
from test_overlap import plain_groups
from test_texts import UPPER

import corpus_pipeline
from tickloom.llm import packing, quality, queries, secrets, tokens, topk, warc

SF_DIR = "/root/testdata/sf0.001"
ODD = ["a", " a", "a ", "  a", "a  b", "\n \nb", "x \n", "a▁ b", "▁", "a b\t c", "<|endoftext|> hi", "é ü  ", "<s> a</s>", "it's  we'll\n\n  ok", "  ", "日本 語", "x\x0b \x0cq", "a\x85 b", "b\x1c c d", "t \n t"]


def test_token_counts(docs_of, sample):
    model = public_tokenizers.path("piece_bpe_32k.model")
    rows = sample + [(1000 + i, x) for i, x in enumerate(ODD)]
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    want = Counter()
    for i, x in rows:
        n = len(library.encode(x or ""))
        want[(i, len((x or "").encode()), n, n > 100)] += 1
    got = tokens.token_counts(docs_of(rows), model, limit=100)
    assert Counter(tuple(r) for r in got.collect()) == want
    assert tokens.token_counts(docs_of([]), model).count() == 0


def test_long_runs_of_spaces_are_cut_safely(monkeypatch):
    monkeypatch.setattr(tokens, "LONG_PART", 20)
    counter = tokens.PieceCounter(public_tokenizers.path("piece_bpe_32k.model"))
    texts = [("word  and some   more words " * 30) + "▁ end", " ".join(["a  b"] * 100)]
    assert counter.counts(texts) == [len(x) for x in counter.model.encode(texts)]


@pytest.mark.parametrize("task_pieces", [packing.TASK_PIECES, 25])
def test_packing(docs_of, sample, task_pieces):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = sample + [(1000 + i, x) for i, x in enumerate(ODD)]
    library = tokenizers.Tokenizer.from_file(path)
    got = packing.packed(docs_of(rows), path, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, capacity=128, task_pieces=task_pieces).collect()
    want = Counter()
    for i, x in rows:
        ids = np.array(library.encode(x or "", add_special_tokens=False).ids + [2], "<u4")
        for k, (at, n) in enumerate(packing.cut(len(ids), 128)):
            want[(i, k, at, n, zlib.crc32(ids[at : at + n].tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 128
    total = sum(r.length for r in got)
    assert len(sequences) <= (1.05 if task_pieces > 25 else 1.3) * total / 128 + 1
    assert packing.packed(docs_of([]), path).count() == 0


def test_sum_of_squares_rule():
    """Every placement is among the best by the plain definition."""
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 33, 300)
    sequence, offset = packing.sum_of_squares(lengths, 32)
    fill = {}
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])

        def squares(after):
            return sum(n * n for g, n in Counter(32 - x for x in after.values()).items() if g)

        options = {s: squares(fill | {s: x + size}) for s, x in fill.items() if x + size <= 32}
        if options:
            assert options[int(sequence[i])] == min(options.values())
        else:
            assert int(sequence[i]) not in fill
        assert offset[i] == fill.get(int(sequence[i]), 0)
        fill[int(sequence[i])] = fill.get(int(sequence[i]), 0) + size


def test_ids_are_the_library_s_over_a_whole_table(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("text").collect()]
    path = public_tokenizers.path("byte_bpe_50k.json")
    model = tokens.BytePairIds(path, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    want = [np.array(x.ids, "<u4").tobytes() for x in model.model.encode_batch_fast(texts, add_special_tokens=False)]
    assert model.ids(texts) == want
    assert tokens.BytePairIds(path).ids(texts[:20]) == want[:20]


def test_quality(spark):
    rows = queries.QUERIES["op3_quality"](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = rows.join(labels, "doc_id").where("held_out").selectExpr("avg(IF(predicted = quality, 1, 0)) AS a", "min(score)", "max(score)").first()
    assert judged.a > 0.95 and 0 <= judged[1] and judged[2] <= 1
    held = rows.select("doc_id", "held_out").where("doc_id < 50").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in held)


def test_quality_edge_cases(spark, docs_of, sample, monkeypatch):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)] * 2 + [(None, 1, 0), (3, None, 0), (4, 7, 0)], "doc_id long, quality int, toxic int")
    got = quality.scores(docs_of(sample), labels)
    assert got.count() == len(sample) and got.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    empty = {r.score for r in got.where("doc_id IN (202, 203, 204)").collect()}
    assert len(empty) == 1
    assert {r.score for r in quality.scores(docs_of(sample), labels.limit(0)).collect()} == {0.5}
    assert quality.scores(docs_of([]), labels).count() == 0
    monkeypatch.setattr(quality, "BROADCAST_LABELS", 0)
    dealt = {(r.doc_id, r.text): r.score for r in quality.scores(docs_of(sample), labels).collect()}
    assert all(abs(dealt[r.doc_id, r.text] - r.score) < 1e-9 for r in got.collect())


def test_dual_descent_reaches_the_optimum():
    """Primal and dual objectives meet."""
    rng = np.random.default_rng(0)
    found = [np.unique(rng.integers(0, 40, 8)) for _ in range(120)]
    labels = np.array([int(3 in x or 7 in x) for x in found])
    ratios = rng.normal(size=40)
    weights = quality.descend(found, labels, ratios, 1.0, 400)
    signs, n, positive = np.where(labels == 1, 1, -1), len(labels), labels.sum()
    most = np.where(labels == 1, n / (2 * positive), n / (2 * (n - positive)))
    margins = np.array([weights[x] @ quality.scaled(x, ratios) + weights[-1] for x in found])
    primal = weights @ weights / 2 + (most * np.maximum(0, 1 - signs * margins)).sum()
    short = quality.descend(found, labels, ratios, 1.0, 2000)
    margins = np.array([short[x] @ quality.scaled(x, ratios) + short[-1] for x in found])
    assert primal <= 1.01 * (short @ short / 2 + (most * np.maximum(0, 1 - signs * margins)).sum())


def plain_top_k(rows, k, every):
    v = sorted({(i, tuple(int(np.floor(64 * float(x))) for x in e)) for i, e in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)})
    first = {}
    for i, x in v:
        first.setdefault(i, x)
    out = set()
    for q, x in first.items():
        if q % every == 0:
            found = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in v if i != q)[:k]
            out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(found, 1)}
    return out


@pytest.mark.parametrize("shard_rows", [topk.SHARD_ROWS, 90])
def test_top_k(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(topk, "LEAF_ROWS", 8)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).round(2).tolist()) for i in range(400)]
    rows += [(1000 + i, [0.5] * 6) for i in range(120)]
    rows += [(7, rows[7][1]), (20, [0.1] * 6), (2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2002, [float("nan")] * 6), (2003, [float("inf")] * 6), (None, [9.0] * 6), (2020, [1.0, 2.0]), (2040, [])]
    table = spark.createDataFrame([(i, e, 1, "?") for i, e in rows], "vec_id long, embedding array<float>, label int, score string")
    got = topk.top_k(table, 20, 20, shard_rows=shard_rows)
    assert {tuple(r) for r in got.collect()} == plain_top_k([(i, e and [None if x is None else np.float32(x) for x in e]) for i, e in rows], 20, 20)
    assert topk.top_k(table.limit(0)).count() == 0
    few = topk.top_k(table.where("vec_id IN (20, 21, 22)"))
    assert few.count() == 2


@pytest.mark.parametrize("largest", [1e6, 1e12, 3e38, 1e200, 1.7e308])
def test_top_k_of_large_components(spark, monkeypatch, largest):
    """Scores beyond what doubles hold are ranked exactly; some differ by one in the last place."""
    monkeypatch.setattr(topk, "LEAF_ROWS", 8)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=5).round(2).tolist()) for i in range(150)]
    rows += [(200 + i, [largest, float(i), -largest / 3, 1.5, 0.0]) for i in range(30)]
    rows += [(300 + i, [largest, 0.0, -largest / 3, 1.5, i / 64]) for i in range(10)]
    rows += [(400, [-largest] * 5), (420, [2.0**53 + 2, 1.0, 0.0, 0.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(table, 20, 20, shard_rows=60).collect()}
    most = np.finfo(float).max
    ints = [(i, [int(min(max(64 * v, -most), most)) if abs(v) >= 2**53 else int(np.floor(64 * v)) for v in x]) for i, x in rows]
    for q, x in ints:
        if q % 20 == 0:
            best = sorted((-sum(map(int.__mul__, x, y)), i) for i, y in ints if i != q)[:20]
            want = [(i, min(max(-score, -(2**63)), 2**63 - 1)) for score, i in best]
            assert [got[(q, rank)] for rank in range(1, 21)] == want, q


def test_bounds_of_another_shard_save_scores():
    rng = np.random.default_rng(6)
    points = np.floor(64 * rng.normal(size=(4000, 3)))
    names, asked = np.arange(4000), points[:50]
    trees = topk.BallTree(points[:2000], 16), topk.BallTree(points[2000:], 16)
    none = np.full(50, -np.inf)
    q, score, _ = topk.search(trees[0], points[:2000], names[:2000], asked, names[:50], none, 20)
    kth = np.array([np.sort(score[q == i])[-20] for i in range(50)], float)
    alone, told = [], []
    topk.search(trees[1], points[2000:], names[2000:], asked, names[:50], none, 20, scored=alone)
    topk.search(trees[1], points[2000:], names[2000:], asked, names[:50], kth, 20, scored=told)
    assert sum(told) < 0.8 * sum(alone)


def test_archives(spark, tmp_path):
    pages = [(i, f"http://a/{i}", f"<p>é{i % 7}</p>") for i in range(40)] + [(50, None, None), (51, "u", ""), (52, "u\r\nX: y", "\r\n\r\n"), (53, "v", "twice"), (53, "v", "twice"), (53, "w", "twice"), (None, "n", "none"), (None, "n2", "<p>é1</p>")]
    table = spark.createDataFrame([(*x, "?", 1) for x in pages], "page_id long, url string, html string, digest string, offset int").repartition(3)
    got = warc.round_trip(table).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == Counter(
        (i, len((x or "").encode()), base64.b32encode(hashlib.sha1((x or "").encode()).digest()).decode()) for i, _, x in pages
    )
    best, responses = {}, Counter(r.payload_digest for r in got if r.record_type == "response")
    for i, _, x in pages:
        best[x or ""] = max(best.get(x or "", -1), -1 if i is None else i)
    assert set(responses.values()) == {1} and len(responses) == len(best)
    digests = {base64.b32encode(hashlib.sha1(x.encode()).digest()).decode(): i for x, i in best.items()}
    for r in got:
        target = None if digests[r.payload_digest] == -1 else digests[r.payload_digest]
        assert r.refers_to == (target if r.record_type == "revisit" else None)
        assert r.record_type == "revisit" or r.page_id == target
    assert warc.round_trip(table, least_bytes=6).where("payload_bytes < 6 AND record_type = 'revisit'").count() == 0
    assert warc.round_trip(table.limit(0)).count() == 0


def test_archives_of_odd_ids_and_long_payloads(spark):
    """Text ids that could end a header line, and a payload of many megabytes."""
    ids = ["a\r\nX-Other: b", "c d+e%20", "", "ü:1", "plain"]
    rows = [(x, "u", f"page of {x}") for x in ids] + [("long", "v", "<p>é</p>" * 1_500_000)]
    table = spark.createDataFrame(rows, "page_id string, url string, html string")
    got = {r.page_id: r for r in warc.round_trip(table).collect()}
    assert set(got) == {x or None for x, _, _ in rows}
    assert all(got[x or None].payload_bytes == len(html.encode()) and got[x or None].record_type == "response" for x, _, html in rows)


def test_selected_records_are_read_alone(spark, tmp_path):
    table = spark.createDataFrame([(i, f"http://a/{i}", f"page {i} " * 50) for i in range(200)], "page_id long, url string, html string")
    index = warc.write_archives(table, f"{tmp_path}/w", archive_bytes=4000)
    assert index.select("path").distinct().count() > 3
    some = warc.read_records(index.where("url IN ('http://a/7', 'http://a/150')"), f"{tmp_path}/w").collect()
    assert {(r.url, bytes(r.payload).decode()) for r in some} == {(f"http://a/{i}", f"page {i} " * 50) for i in (7, 150)}
    runs = list(warc.coalesced([{"offset": 0, "length": 10}, {"offset": 12, "length": 5}, {"offset": 100, "length": 5}], gap=4))
    assert [(a, b, len(x)) for a, b, x in runs] == [(0, 17, 2), (100, 105, 1)]


def plain_quality(docs, labels):
    """Decision and score of each text, from plain counts over all labelled rows."""
    marks = {(i, y) for i, y in labels if i is not None and y in (0, 1) and zlib.crc32(str(i).encode()) % 3 != 1}
    texts = {i: quality.features((x or "").encode()) for i, x in docs}
    rows = sorted((i, y) for i, y in marks if i in texts)
    counts = [Counter(), Counter()]
    for i, y in rows:
        counts[y].update(texts[i].tolist())
    size = 1 << quality.BITS
    totals = [sum(c.values()) + size for c in counts]
    ratios = np.array([np.log((counts[1][f] + 1) / totals[1]) - np.log((counts[0][f] + 1) / totals[0]) for f in range(size)])
    weights = quality.descend([texts[i] for i, _ in rows], np.array([y for _, y in rows]), ratios, quality.COST, 60)
    return {i: 1 / (1 + np.exp(-quality.SLOPE * (weights[x] @ quality.scaled(x, ratios) + weights[-1]))) for i, x in texts.items()}


def test_pipeline(spark):
    """Each stage against a plain version of itself, on its own input."""
    read = lambda name: spark.read.parquet(f"{SF_DIR}/{name}.parquet")
    docs = read("documents")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(stage(spark, kept[-1], SF_DIR).cache())
        assert kept[-1].columns == docs.columns
    texts = [{r.doc_id: r.text for r in x.collect()} for x in kept]
    assert all(len(x) == y.count() for x, y in zip(texts, kept))

    scores = plain_quality(texts[0].items(), [(r.doc_id, r.quality) for r in read("labels").collect()])
    sure = {i: s >= 0.5 for i, s in scores.items() if abs(s - 0.5) > 0.03}
    assert len(sure) > 0.9 * len(scores) and all((i in texts[1]) == good for i, good in sure.items())

    assert set(texts[2]) == {least for _, least in plain_groups(list(texts[1].items()))} and len(texts[2]) < len(texts[1])

    find = lambda x: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (x or "").translate(UPPER))
    windows = {tuple(w[k : k + 10]) for w in (find(r.text) for r in read("benchmark").collect()) if w for k in range(max(1, len(w) - 9))}
    lengths = {len(x) for x in windows}
    dirty = {i for i, x in texts[2].items() for w in [find(x)] for n in lengths for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows}
    assert dirty and set(texts[3]) == set(texts[2]) - dirty
    assert all(texts[3][i] == x for i, x in texts[0].items() if i in texts[3])

    assert texts[4] == {i: secrets.redact(x or "", secrets.all_spans(x or "")[1]) for i, x in texts[3].items()}
    # the table itself has no secrets: some are put into every tenth text
    key = base64.b64encode(b"password = hunter2222").decode()
    planted = docs.withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit(f"api_key=0123456789 {key} "), "text")).otherwise(F.col("text")))
    cleaned = {r.doc_id: r.text for r in corpus_pipeline.without_secrets(spark, planted, SF_DIR).collect()}
    assert cleaned == {i: f"[SECRET] [SECRET] {x}" if i % 10 == 0 else x for i, x in texts[0].items()}

    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = Counter()
    for i, x in texts[4].items():
        ids = np.array(library.encode(x, add_special_tokens=False).ids + [2], "<u4")
        for k, (at, n) in enumerate(packing.cut(len(ids), 1024)):
            pieces[(i, k, at, n, zlib.crc32(ids[at : at + n].tobytes()))] += 1
    last = corpus_pipeline.run(spark, SF_DIR).collect()
    assert Counter(tuple(r)[:5] for r in last) == pieces
    ends = defaultdict(list)
    for r in last:
        ends[r.sequence_id].append((r.offset, r.offset + r.length))
    for parts in ends.values():
        parts.sort()
        assert [0, *(b for _, b in parts)][:-1] == [a for a, _ in parts] and parts[-1][1] <= 1024
    assert len(ends) <= 1.02 * sum(r.length for r in last) / 1024 + 1


CLASHING = "row string, key string, copies int, digest string, id int, fp string, score string, label string, hits int, spans int, sequence_id int"


def test_pipeline_stages_take_odd_tables(spark):
    plain = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, "en", "s", 0), (None, "", None, None, None), (2, "same text here", "en", "s", 1), (2, "same text here", "en", "s", 1), (2, "same text here", "de", None, 1)]
    rows.append((3, "long " * 200_000 + "z" * 1_000_000, "en", "s", 1))
    docs = spark.createDataFrame(rows, plain)
    wide = spark.createDataFrame([(*x, "?", "?", 7, "?", 7, "?", "?", "?", 7, 7, 7) for x in rows], f"{plain}, {CLASHING}")
    for name, stage in corpus_pipeline.STAGES:
        got = [Counter(map(repr, stage(spark, x, SF_DIR).collect())) for x in (docs, wide)]
        if name == "packing":  # ties between equal rows may change places
            assert got[0].total() == got[1].total() >= len(rows)
        else:
            assert got[0] == got[1] and stage(spark, wide, SF_DIR).columns == docs.columns
        assert stage(spark, wide.limit(0), SF_DIR).count() == 0
    # null and empty texts have the same fingerprint, so do the copies
    assert {r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, SF_DIR).collect()} == {1, 2, 3}
    assert corpus_pipeline.one_of_each(spark, docs, SF_DIR).count() == 3
    assert {r.doc_id for r in corpus_pipeline.clean_of_benchmark(spark, docs, SF_DIR).collect()} == {1, 2, 3, None}
    assert {r.text for r in corpus_pipeline.without_secrets(spark, docs.where("doc_id IS NULL OR doc_id = 1"), SF_DIR).collect()} == {""}
