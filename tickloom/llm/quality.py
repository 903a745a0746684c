"""Quality classifier: a linear hinge-loss model over n-gram indicators scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.text import blocks, byte_bounded, utf8, words_of

#: Hashed n-grams: bits of a feature number. All tables of the model have this size, whatever the input.
BITS = 18
#: Labelled rows that the hinge-loss model is fitted on, at most; the log-count ratios use every labelled row.
FIT_ROWS = 20_000
#: Labels up to which they are sent to the texts; more labels and the texts are both dealt by id.
BROADCAST_LABELS = 1_000_000
#: N-grams of at most so many words.
ORDER = 2
#: Added to each class count.
SMOOTH = 1.0
#: Loss weight of a training row, and passes over the training rows.
COST, PASSES = 1.0, 12
#: Slope of the logistic that turns a margin into a score.
SLOPE = 2.0


def features(raw: bytes, bits: int = BITS, order: int = ORDER) -> np.ndarray:
    """The numbers of the n-grams that a text has, each once, sorted."""
    words, out = words_of(raw.lower()), []
    for n in range(1, order + 1):
        if len(words) >= n:
            for _, joined in blocks(words, n - 1):
                out.append((joined.hashes(n) * np.uint64(2 * n + 1)) >> np.uint64(64 - bits))
    return np.unique(np.concatenate(out)).astype(np.int32) if out else np.zeros(0, np.int32)


def marks_of(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """``(id, label)`` to learn from, neither null nor held out; a label is 0 or 1, repeated labels count once."""
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    return marks.where("label IN (0, 1) AND id IS NOT NULL").where(~held_out(F.col("id"))).distinct()


def labelled(docs: DataFrame, marks: DataFrame, id_col: str, text_col: str, most: int) -> DataFrame:
    """``(id, text, label)``; up to ``most`` labels are sent to the texts, so that these stay where they are."""
    if marks.count() <= most:
        marks = F.broadcast(marks)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(marks, "id")


def held_out(id_):
    """Rows kept from learning: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def log_count_ratios(rows: DataFrame, bits: int = BITS, order: int = ORDER, smooth: float = SMOOTH) -> np.ndarray:
    """For each feature the log of its share in rows of label 1 over its share in rows of label 0.

    Every row counts. Each task sums its own rows into two tables of fixed size and returns them in slices, which
    Spark adds up slice by slice.
    """
    size = 1 << bits
    slices = 64

    def count(batches):
        sums = np.zeros((2, size), np.int64)
        for batch in batches:
            for raw, label in zip(utf8(batch.column(0)), batch.column(1).to_pylist()):
                sums[label][features(raw, bits, order)] += 1
        for label in (0, 1):
            if sums[label].any():
                parts = pa.array(list(sums[label].reshape(slices, -1)), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([label] * slices), pa.array(range(slices)), parts], names=["label", "slice", "counts"])

    def add(batches):
        sums = {}
        for batch in batches:
            for label, part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                counts = counts.values.to_numpy()
                sums[label, part] = sums[label, part] + counts if (label, part) in sums else counts
        for (label, part), counts in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([label]), pa.array([part]), pa.array([counts], pa.list_(pa.int64()))], names=["label", "slice", "counts"])

    kinds = "label long, slice long, counts array<long>"
    counted = byte_bounded(rows).select("text", "label").mapInArrow(count, kinds)
    total = np.full((2, slices, size // slices), smooth)
    for x in counted.repartition("slice").mapInArrow(add, kinds).collect():  # the size of the model
        total[x["label"], x["slice"]] += x["counts"]
    total = total.reshape(2, size)
    return np.log(total[1] / total[1].sum()) - np.log(total[0] / total[0].sum())


def fit(docs: DataFrame, marks: DataFrame, ratios: np.ndarray, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, order: int = ORDER, fit_rows: int = FIT_ROWS, cost: float = COST, passes: int = PASSES) -> np.ndarray:
    """Weights of the features and, last, the bias, by dual coordinate descent in one task over ``fit_rows`` rows at most.

    Labels are taken by the least hash of id and label, so the same input gives the same model. Rows of either class weigh
    the same in sum. Without rows of both classes the weights are zero, and the bias says which class there is.
    """
    chosen = marks.orderBy(F.xxhash64("id", "label"), "id", "label").limit(fit_rows)
    hashed = F.xxhash64("id", "label")
    rows = labelled(docs, chosen, id_col, text_col, fit_rows).orderBy(hashed, "id", "label", "text").limit(fit_rows)  # an id may have several texts
    shared = rows.sparkSession.sparkContext.broadcast(ratios)

    def train(batches):
        found, labels = [], []
        for batch in batches:
            found += [features(raw, bits, order) for raw in utf8(batch.column(0))]
            labels += batch.column(1).to_pylist()
        weights = descend(found, np.array(labels), shared.value, cost, passes)
        yield pa.RecordBatch.from_arrays([pa.array([weights], pa.list_(pa.float64()))], names=["weights"])

    rows = byte_bounded(rows).repartition(1).sortWithinPartitions(F.xxhash64("id", "label"), "id", "label", "text").select("text", "label")
    made = rows.mapInArrow(train, "weights array<double>").first()
    return np.zeros(len(ratios) + 1) if made is None else np.array(made["weights"])


def descend(found: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, cost: float, passes: int) -> np.ndarray:
    """Dual coordinate descent for the hinge loss; rows are scaled to length one, and have a constant feature."""
    weights = np.zeros(len(ratios) + 1)
    n, positive = len(labels), int((labels == 1).sum())
    if positive in (0, n):
        weights[-1] = 0.0 if not n else 1.0 if positive else -1.0
        return weights
    rows = [scaled(x, ratios) for x in found]
    signs = np.where(labels == 1, 1.0, -1.0)
    most = cost * np.where(labels == 1, n / (2 * positive), n / (2 * (n - positive)))
    dual = np.zeros(n)
    rng = np.random.default_rng(0)
    for _ in range(passes):
        for i in rng.permutation(n).tolist():
            at, values = found[i], rows[i]
            gradient = signs[i] * (weights[at] @ values + weights[-1]) - 1
            new = min(max(dual[i] - gradient / (1.0 + bool(len(at))), 0.0), most[i])  # squared length: values and constant
            if new != dual[i]:
                step = (new - dual[i]) * signs[i]
                weights[at] += step * values
                weights[-1] += step
                dual[i] = new
    return weights


def scaled(at: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    values = ratios[at]
    length = np.sqrt(values @ values)
    return values / length if length else values


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", bits: int = BITS, order: int = ORDER, fit_rows: int = FIT_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Ratios and weights learned from the labelled rows that are not held out (see :func:`held_out`).

    Ratios are counted over all of them; the hinge-loss model is fitted on at most ``fit_rows``. Nothing but the text is read.
    """
    marks = marks_of(labels, id_col, label_col)
    ratios = log_count_ratios(labelled(docs, marks, id_col, text_col, BROADCAST_LABELS), bits, order)
    return ratios, fit(docs, marks, ratios, id_col, text_col, bits, order, fit_rows)


def rated(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """Rows of ``docs`` as ``(id_col, text_col, score)``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    bits = len(model[0]).bit_length() - 1

    def run(batches):
        ratios, weights = shared.value
        for batch in batches:
            margins = []
            for raw in utf8(batch.column(1)):
                at = features(raw, bits, order)
                margins.append(weights[at] @ scaled(at, ratios) + weights[-1])
            score = 1 / (1 + np.exp(-SLOPE * np.array(margins, float)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], names=["id", "text", "score"])

    rows = byte_bounded(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string, score double")
    return out.select(F.col("id").alias(id_col), F.col("text").alias(text_col), "score")


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **choices) -> DataFrame:
    """Rows of ``docs`` as ``(id_col, text_col, held_out, score, predicted)``; label 1 is likelier at a higher score.

    Null and empty texts have no n-grams and get the score of the bias. Rows that repeat get equal scores; a null id is not
    held out and has no label; an empty table gives an empty result, a table without labels a score of 0.5 throughout.
    Further columns are not read.
    """
    out = rated(docs, train(docs, labels, id_col, text_col, **choices), id_col, text_col, choices.get("order", ORDER))
    return out.select(id_col, text_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
