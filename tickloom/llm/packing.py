"""Best-fit packing of tokenized documents by the sum-of-squares rule."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.text import byte_bounded, utf8
from tickloom.llm.tokens import BytePairIds, groups_by_bytes, loaded
from tickloom.session import scratch_table

#: Pieces that one task packs; the sequences left open at a task's end are the only price of more tasks.
TASK_PIECES = 100_000

PIECE = "piece int, start long, length long, ids_crc32 long"


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of a document's pieces; only the first may be shorter than the capacity."""
    head = length if length <= capacity else length % capacity or capacity
    return [(0, head), *((start, capacity) for start in range(head, length, capacity))]


def token_pieces(docs: DataFrame, model_path: str, ranks: str | None, pattern: str | None, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of each row's token ids with ``end_id`` at their end: ``(id_col, piece, start, length, ids_crc32)``."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        model = loaded(BytePairIds, model_path, ranks, pattern)
        for batch in batches:
            texts = utf8(batch.column(1))
            rows, piece, start, length, crc = [], [], [], [], []
            for group in groups_by_bytes(texts):
                for i, ids in zip(group, model.ids([texts[i].decode() for i in group])):
                    ids += end
                    for k, (at, n) in enumerate(cut(len(ids) // 4, capacity)):
                        rows.append(i), piece.append(k), start.append(at), length.append(n)
                        crc.append(zlib.crc32(ids[4 * at : 4 * (at + n)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                names=["id", "piece", "start", "length", "ids_crc32"],
            )

    rows = byte_bounded(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {PIECE}").withColumnRenamed("id", id_col)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece, placed one after another, the largest first.

    Where ``n[g]`` open sequences have a gap of ``g``, a piece goes where the sum of ``n[g]**2`` over all open gaps
    becomes smallest; of equal places the tightest. A full sequence is not open. A new sequence is begun only
    where no open one has room: the largest pieces come first, so new sequences needn't be kept ready for what follows,
    and this leaves about a fifth of the unused room that free beginnings leave.
    """
    order = np.argsort(-lengths, kind="stable")
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_ = np.zeros(capacity + 1, np.int64)
    of_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    count, none = 0, np.iinfo(np.int64).max
    for at, size in zip(order.tolist(), lengths[order].tolist()):
        gap = capacity
        if size < capacity:
            gaps = open_[size:capacity]
            change = 2 * (open_[: capacity - size] - gaps) + 2  # of the sum, by a move from gap g to g - size
            change[0] -= 1  # an exact fit leaves no new gap
            change[gaps == 0] = none
            k = int(change.argmin())
            if change[k] < none:
                gap = k + size
        if gap == capacity:
            place = count
            count += 1
        else:
            place = of_gap[gap].pop()
            open_[gap] -= 1
        left = gap - size
        if left:
            of_gap[left].append(place)
            open_[left] += 1
        sequence[at], offset[at] = place, capacity - gap
    return sequence, offset


def pack(pieces: DataFrame, capacity: int, id_col: str = "doc_id", task_pieces: int = TASK_PIECES) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; pieces are dealt evenly to tasks of about ``task_pieces``.

    Each task packs its own pieces, so sequence ids are unique and gapless within a task. ``pieces`` should be a
    written table, so that a repeated task gets the same rows.
    """
    tasks = max(1, -(-pieces.count() // task_pieces))
    names = pieces.columns

    def run(batches):
        from pyspark import TaskContext

        if batches := list(batches):
            held = pa.Table.from_batches(batches)
            first = TaskContext.get().partitionId() << 40
            sequence, offset = sum_of_squares(held.column("length").to_numpy(), capacity)
            held = held.append_column("sequence_id", pa.array(sequence + first)).append_column("offset", pa.array(offset))
            yield from held.to_batches(max_chunksize=50_000)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields)
    dealt = pieces.repartition(tasks).sortWithinPartitions(F.col("length").desc(), id_col, "piece", "start", "ids_crc32")
    return dealt.select(*names).mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def packed(docs: DataFrame, model_path: str, ranks: str | None = None, pattern: str | None = None, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", task_pieces: int = TASK_PIECES) -> DataFrame:
    """All rows of ``docs``, tokenized, cut and packed into sequences of at most ``capacity`` tokens.

    One row a piece: ``(id_col, piece, start, length, ids_crc32, sequence_id, offset)``. Null and empty texts are the
    end token alone. Rows that repeat and rows with a null id are packed like any other. Equal lengths are placed
    in the order of id and piece. An empty table gives an empty result; further columns are not read.
    """
    pieces = scratch_table(token_pieces(docs, model_path, ranks, pattern, capacity, end_id, id_col, text_col).withColumnRenamed(id_col, "id"))
    return pack(pieces, capacity, "id", task_pieces).withColumnRenamed("id", id_col)
