"""Exact top-k inner products: ball trees over shards, searched by bounds."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.session import scratch_table

#: Vectors of a shard, about: each task builds the tree of its shard in memory.
SHARD_ROWS = 32_768
#: Doubles hold whole numbers up to this exactly.
EXACT = 2.0**53
#: Vectors of a leaf.
LEAF_ROWS = 128
#: Queries that walk a tree together.
QUERY_ROWS = 256


class BallTree:
    """Balls around halves of halves; a node has a centre, a radius and a range of rows."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF_ROWS):
        self.order = np.arange(len(vectors))
        self.centres, self.radii, self.ranges, self.children = [], [], [], []
        work = [(0, len(vectors), -1, 0)]
        while work:
            first, last, parent, side = work.pop()
            at = self.order[first:last]
            points = vectors[at]
            centre = points.mean(axis=0)
            node = len(self.ranges)
            self.centres.append(centre)
            self.radii.append(float(np.sqrt(((points - centre) ** 2).sum(axis=1).max())))
            self.ranges.append((first, last))
            self.children.append([-1, -1])
            if parent >= 0:
                self.children[parent][side] = node
            if last - first > leaf:
                # halves along the line between two far points
                far = points[((points - points[0]) ** 2).sum(axis=1).argmax()]
                other = points[((points - far) ** 2).sum(axis=1).argmax()]
                half = (last - first) // 2
                self.order[first:last] = at[np.argpartition(points @ (other - far), half)]
                work += [(first, first + half, node, 0), (first + half, last, node, 1)]
        self.centres = np.array(self.centres)
        self.radii = np.array(self.radii)

    def bounds(self, queries: np.ndarray, lengths: np.ndarray, node: int) -> np.ndarray:
        """The highest inner product that each query can have below a node; rounding is allowed for."""
        highest = queries @ self.centres[node] + lengths * self.radii[node]
        return highest + 1e-9 * (np.abs(highest) + lengths * (np.abs(self.centres[node]).sum() + self.radii[node]) + 1)


class Best:
    """The k best of each query so far, and the score that a newcomer must reach."""

    def __init__(self, rows: int, k: int, bounds: np.ndarray):
        self.k, self.bounds, self.held = k, bounds.copy(), 0
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, query: np.ndarray, score: np.ndarray, name: np.ndarray) -> None:
        self.parts.append((query, score, name))
        self.held += len(query)
        if self.held > 4 * self.k * len(self.bounds):
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return tuple(np.zeros(0, np.int64) for _ in range(3))
        query, score, name = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((name, -score, query))
        query, score, name = query[order], score[order], name[order]
        begins = np.searchsorted(query, query)
        place = np.arange(len(query)) - begins
        keep = place < self.k
        last = place == self.k - 1
        self.bounds[query[last]] = np.maximum(self.bounds[query[last]], score[last])
        self.parts = [(query[keep], score[keep], name[keep])]
        self.held = int(keep.sum())
        return self.parts[0]


class WideBest:
    """The k best of each query where scores are beyond what doubles hold: whole numbers of any length, one heap a query.

    ``bounds`` are doubles a little below the kth scores, in units of ``unit``.
    """

    def __init__(self, k: int, bounds: np.ndarray, unit: int):
        self.k, self.bounds, self.unit = k, bounds.copy(), unit
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in bounds]

    def add(self, query: int, score: int, name: int) -> None:
        heap = self.heaps[query]
        (heapq.heappush if len(heap) < self.k else heapq.heappushpop)(heap, (score, -name))
        if len(heap) == self.k:
            self.bounds[query] = max(self.bounds[query], below(heap[0][0], self.unit))

    def settle(self) -> list[tuple[int, int, int]]:
        return [(q, score, -name) for q, heap in enumerate(self.heaps) for score, name in heap]


def below(score: int, unit: int) -> float:
    """A double that is not above the score."""
    x = score / unit
    return x - abs(x) * 1e-12 - 1e-300


def search(tree: BallTree, vectors: np.ndarray, names: np.ndarray, queries: np.ndarray, own: np.ndarray, bounds: np.ndarray, k: int, wide: Wide | None = None, scored: list[int] | None = None):
    """``(query, score, name)`` of each query's best rows of one shard, among those that reach its bound.

    Nodes are opened in the order of the highest inner product any waiting query may have there; a query
    enters a node only if its bound there reaches its current kth score, which every leaf may raise. ``wide`` has the whole numbers of rows and queries where doubles
    only come near them: then doubles choose what is scored in whole numbers. ``scored`` takes the number of rows scored in each leaf.
    """
    best = Best(len(queries), k, bounds) if wide is None else WideBest(k, bounds, wide.unit)
    lengths = np.sqrt((queries * queries).sum(axis=1))
    every = np.arange(len(queries))
    heap = [(-np.inf, 0, 0, every, tree.bounds(queries, lengths, 0))]
    count = 1
    while heap:
        _, _, node, active, highest = heapq.heappop(heap)
        open_ = highest >= best.bounds[active]
        active, highest = active[open_], highest[open_]
        if not len(active):
            continue
        left, right = tree.children[node]
        if left < 0:
            at = tree.order[slice(*tree.ranges[node])]
            score = queries[active] @ vectors[at].T
            if scored is not None:
                scored.append(score.size)
            if wide is not None:
                score += 1e-12 * (np.abs(queries[active]) @ np.abs(vectors[at]).T) + 1e-300
            q, c = np.nonzero(score >= best.bounds[active][:, None])
            other = names[at[c]] != own[active[q]]
            q, c = q[other], c[other]
            if wide is None:
                best.add(active[q], score[q, c].astype(np.int64), names[at[c]])
                best.settle()
                continue
            for i, j, top in zip(active[q].tolist(), at[c].tolist(), score[q, c].tolist()):
                if top >= best.bounds[i]:
                    best.add(i, sum(map(int.__mul__, wide.queries[i], wide.points[j])), int(names[j]))
        else:
            for child in (left, right):
                highest = tree.bounds(queries[active], lengths[active], child)
                heapq.heappush(heap, (-float(highest.max()), count, child, active, highest))
                count += 1
    return best.settle()


class Wide:
    """Rows and queries as whole numbers, and the doubles that stand for them, shrunk so that no product leaves their range."""

    def __init__(self, points: np.ndarray, queries: np.ndarray, shrink: int):
        self.unit = 1 << (2 * shrink)
        self.points, self.queries = ([list(map(int, x)) for x in y.tolist()] for y in (points, queries))


def scaled_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``(id, x)`` with x the components times ``scale``, rounded down, as doubles; equal rows once.

    Rows without an id or a vector, or with a component that is null or not finite, take no part. A multiple beyond the
    range of doubles counts as the last one.
    """
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    out = rows.where(F.col(id_col).isNotNull() & x.isNotNull()).where(finite)
    most = F.lit(np.finfo(float).max.item())
    whole = lambda v: F.when(F.abs(v) < EXACT, F.floor(v * scale).cast("double")).otherwise(F.least(F.greatest(v * scale, -most), most))
    return out.select(F.col(id_col).cast("long").alias("id"), F.transform(x, whole).alias("x"))


def top_k(rows: DataFrame, k: int = 20, every: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` highest inner products of each row whose id is divisible by ``every``.

    All rows are candidates but those of the query's own id; ties go to the smaller id. Equal rows count once; one id
    with several vectors is several candidates and is a query by its smallest vector. A shorter vector is filled up
    with zeros. Rows that take no part: see :func:`scaled_vectors`. Scores are exact: beyond what doubles hold (2^53) they are computed and ranked as whole numbers of any
    length; a score beyond 64 bits is given as the last one of 64 bits. No rows give no result.

    Candidates are dealt to shards by a hash of their id. Every query first visits one shard; its kth score there is its bound in all the others.
    A task keeps the tree of one shard and raises the bounds as it goes; shards return only rows that reach the bound, and of these the best ``k``.
    """
    vectors = scratch_table(scaled_vectors(rows, id_col, vector_col, scale).distinct())
    count, width, largest = vectors.agg(F.count("*"), F.max(F.size("x")), F.max(F.expr("aggregate(x, 0D, (a, v) -> greatest(a, abs(v)))"))).first()
    width, largest = width or 0, largest or 0.0
    wide = largest > 0 and 2 * math.log2(largest) + math.log2(width) >= 53
    shrink = max(0, int(math.log2(largest)) - 400) if wide else 0
    bits = (2 * int(math.log2(largest)) + int(math.log2(width)) + 4) if wide else 0
    queries = vectors.where(F.col("id") % every == 0).groupBy("id").agg(F.min("x").alias("x"))
    shards = max(1, -(-count // shard_rows), min(count // 4096, vectors.sparkSession.sparkContext.defaultParallelism))

    def run(batches):
        for shard, candidates, blocks in whole_shards(batches, width):
            names, points = distinct_best(*candidates, k)
            if not len(names):
                continue
            tree = BallTree(np.ldexp(points, -shrink))
            for own, asked, bounds in blocks:
                bounds = np.where(np.isnan(bounds), -np.inf, bounds)
                if wide:
                    found = search(tree, np.ldexp(points, -shrink), names, np.ldexp(asked, -shrink), own, bounds, k, Wide(points, asked, shrink))
                    yield wide_batch(found, own, bits, shrink)
                else:
                    q, score, name = search(tree, points, names, asked, own, bounds, k)
                    yield pa.RecordBatch.from_arrays([pa.array(own[q]), pa.array(name), pa.array(score), pa.array(score.astype(float))], names=["query_id", "vec_id", "score", "low"])

    schema = "query_id long, vec_id long, score long, low double" + (", whole binary" if wide else "")
    order = F.col("whole" if wide else "score").desc()
    base = vectors.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "id", "x", F.lit(None).cast("double").alias("bound"))

    def visit(asked: DataFrame) -> DataFrame:
        dealt = base.unionByName(asked.select("shard", F.lit(1).alias("kind"), "id", "x", "bound"))
        return dealt.repartition(shards, "shard").sortWithinPartitions("shard", "kind", "id").mapInArrow(run, schema)

    rank = F.row_number().over(W.partitionBy("query_id").orderBy(order, "vec_id"))
    home = F.pmod(F.xxhash64("id", F.lit("first")), F.lit(shards)).cast("int")
    found = visit(queries.select(home.alias("shard"), "id", "x", F.lit(None).cast("double").alias("bound")))
    if shards > 1:
        found = scratch_table(found)
        known = found.withColumn("rank", rank).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("low").alias("bound"))
        rest = queries.join(known, "id", "left").select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "id", "x", "bound")
        found = found.unionByName(visit(rest.where(F.col("shard") != home)))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def wide_batch(found: list[tuple[int, int, int]], own: np.ndarray, bits: int, shrink: int) -> pa.RecordBatch:
    """Scores as the nearest of 64 bits, as a double from below, and whole, as bytes in the order of the numbers."""
    top = (1 << 63) - 1
    columns = [
        pa.array([int(own[q]) for q, _, _ in found], pa.int64()),
        pa.array([name for _, _, name in found], pa.int64()),
        pa.array([min(max(score, -top - 1), top) for _, score, _ in found], pa.int64()),
        pa.array([below(score, 1 << (2 * shrink)) for _, score, _ in found], pa.float64()),
        pa.array([(score + (1 << bits)).to_bytes(bits // 8 + 1, "big") for _, score, _ in found], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "score", "low", "whole"])


def distinct_best(names: np.ndarray, points: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of equal vectors only the ``k + 1`` of smallest id can be among a query's best; names are sorted."""
    if not len(names):
        return names, points
    _, group = np.unique(points, axis=0, return_inverse=True)
    order = np.argsort(group.ravel(), kind="stable")
    group = group.ravel()[order]
    place = np.arange(len(group)) - np.searchsorted(group, group)
    keep = np.sort(order[place <= k])
    return names[keep], points[keep]


def whole_shards(batches, width: int):
    """For each shard its candidates, and its queries with their bounds in blocks as they come in."""

    def rows():
        for batch in batches:
            flat = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(float)
            sizes = np.diff(batch.column(3).offsets.to_numpy())
            if (sizes == width).all():
                points = flat.reshape(-1, width)
            else:
                points = np.zeros((len(sizes), width))
                points[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
            label = batch.column(0).to_numpy().astype(np.int64) * 2 + batch.column(1).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(label)) + 1).tolist(), len(label)]
            names, bounds = batch.column(2).to_numpy(), batch.column(4).to_numpy(zero_copy_only=False).astype(float)
            for a, b in zip(edges, edges[1:]):
                if b > a:
                    yield int(label[a]), names[a:b], points[a:b], bounds[a:b]

    stream = rows()
    part = next(stream, None)
    while part is not None:
        shard, held = part[0] // 2, []
        while part is not None and part[0] == 2 * shard:
            held.append(part[1:3])
            part = next(stream, None)
        names = np.concatenate([x for x, _ in held]) if held else np.zeros(0, np.int64)
        points = np.concatenate([x for _, x in held]) if held else np.zeros((0, width))

        def blocks():
            nonlocal part
            while part is not None and part[0] == 2 * shard + 1:
                for first in range(0, len(part[1]), QUERY_ROWS):
                    yield tuple(x[first : first + QUERY_ROWS] for x in part[1:])
                part = next(stream, None)

        own = blocks()
        yield shard, (names, points), own
        for _ in own:  # what a caller has left
            pass
