"""Approximate nearest neighbours: a forest of random-projection trees and exact reranking.

Trees are fitted on a bounded sample: a node splits its points at the median along a random direction. Every row of the
table is indexed in every tree. A query walks all trees through one priority queue, ordered by the largest margin on
the way to a branch, until the leaves that it reached hold BUDGET of the rows; then the rows of those leaves, and no
others, are compared exactly, in double precision.

Vectors are never shuffled. Queries are dealt to groups of about QUERIES; a group, with the leaves that its queries
reached, is broadcast, and every task reranks those of its rows that stand in a reached leaf, tile by tile. Each task
sends the k best for a query, and these are merged in two stages.

The budget is a share of the rows because nothing less is right for vectors without structure: see the README for the
recall that was measured.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, materialize

#: Vectors that the trees are fitted on, at most (about), trees, and fewest sample vectors that are split further.
SAMPLE, TREES, LEAF = 8192, 16, 64
#: Share of the rows, counted as often as they are met, that a query's leaves must hold.
BUDGET = 1.8
#: Rows compared at a time; queries broadcast at a time, about (each some 1.5 kB at 64 dimensions); stages of the merge.
BLOCK, QUERIES, MERGE, SEED = 8192, 8192, 64, 11


@dataclass
class Tree:
    """Nodes in arrays: direction, threshold, children; a child below zero is the leaf ~child."""

    w: np.ndarray
    t: np.ndarray
    kids: np.ndarray
    leaves: int

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64) if len(self.t) else np.full(len(x), -1)
        while (inner := np.flatnonzero(at >= 0)).size:
            n = at[inner]
            at[inner] = self.kids[n, (np.einsum("ij,ij->i", x[inner], self.w[n]) > self.t[n]).astype(int)]
        return ~at


def grow(x: np.ndarray, rng: np.random.Generator) -> Tree:
    """One tree over the sample x."""
    w, t, kids, leaves = [], [], [], 0
    todo = [(np.arange(len(x)), -1, 0)]
    while todo:
        rows, parent, side = todo.pop()
        d = rng.normal(size=x.shape[1])
        d /= np.linalg.norm(d)
        p = x[rows] @ d
        cut = np.median(p) if len(rows) else 0.0
        low = p <= cut
        if len(rows) < LEAF or low.all():
            me, leaves = ~leaves, leaves + 1
        else:
            me = len(t)
            w.append(d), t.append(cut), kids.append([0, 0])
            todo += [(rows[low], me, 0), (rows[~low], me, 1)]
        if parent >= 0:
            kids[parent][side] = me
    return Tree(np.array(w).reshape(-1, x.shape[1]), np.array(t), np.array(kids, np.int64).reshape(-1, 2), leaves)


def visit(trees: list[Tree], counts: list[np.ndarray], q: np.ndarray, budget: float, least: int) -> list[tuple[int, int]]:
    """Leaves (tree, leaf) in the order of the shared queue, until they hold `budget` rows and one tree's `least`."""
    sides = [tr.w @ q - tr.t for tr in trees]
    queue = [(0.0, i, 0 if len(tr.t) else -1) for i, tr in enumerate(trees)]
    heapq.heapify(queue)
    out, held, own = [], 0, [0] * len(trees)
    while queue and (held < budget or max(own) < least):
        margin, i, n = heapq.heappop(queue)
        kids, s = trees[i].kids, sides[i]
        while n >= 0:
            far = int(s[n] <= 0)
            heapq.heappush(queue, (max(margin, abs(s[n])), i, int(kids[n, far])))
            n = int(kids[n, 1 - far])
        out.append((i, ~n))
        held += int(counts[i][~n])
        own[i] += int(counts[i][~n])
    return out


def _valid(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def nearest(vectors: DataFrame, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", queries: Column | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every query (all others if fewer), by Euclidean distance.

    queries: which rows are queries, as a condition on `id`; by default those whose id is divisible by 100. Ties go to
    the smaller id. Rows that are null, zero, or hold null or non-finite components take no part, nor do rows with a null
    id. Rows of another dimension have no distance: each dimension that queries have is searched by itself. Rows that
    repeat an id are candidates like any other, also for each other, and each is a query of its own. Other columns are
    ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    named = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).alias("v"), F.monotonically_increasing_id().alias("uid"))
    rows = materialize(named.filter(F.col("id").isNotNull() & _valid(F.col("v"))), "vectors")
    wanted = F.col("id") % 100 == 0 if queries is None else queries
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(wanted, 1).otherwise(0)).alias("asked")).filter("asked > 0").orderBy("d").collect()
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for r in sizes:
        out = out.unionByName(_search(rows.filter(F.size("v") == r["d"]), r["d"], r["n"], r["asked"], k, wanted))
    return out


def _search(rows: DataFrame, dimension: int, total: int, asking: int, k: int, wanted: Column) -> DataFrame:
    """nearest() for the `total` rows of one dimension: id, v, uid."""
    spark = rows.sparkSession
    drawn = rows.filter(F.pmod(F.xxhash64(F.lit("forest"), "uid"), F.lit(1_000_000)) / 1e6 < min(1.0, SAMPLE / total)).orderBy("id", "v").select("v").toArrow()
    sample = _matrix(drawn["v"]) if drawn.num_rows else np.zeros((0, dimension))
    rng = np.random.default_rng(SEED)
    forest = spark.sparkContext.broadcast([grow(sample, rng) for _ in range(TREES)])
    first = np.cumsum([0, *(tr.leaves for tr in forest.value)])  # the number of each tree's first leaf

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1))
            leaves = np.stack([tr.leaf_of(x) + at for tr, at in zip(forest.value, first, strict=False)], 1).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, leaves.size + 1, TREES, dtype=np.int32)), pa.array(leaves.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], names=["id", "v", "uid", "leaves"])

    kind = rows.schema["v"].dataType.simpleString()
    placed = materialize(rows.mapInArrow(index, f"id long, v {kind}, uid long, leaves array<int>"), "index")
    held = np.zeros(first[-1], np.int64)
    for r in placed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect():  # at most TREES * SAMPLE / (LEAF / 2) leaves
        held[r["leaf"]] = r["count"]
    counts = [held[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
    groups = max(1, -(-asking // QUERIES))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            reached = []
            for q in _matrix(b.column(1)):
                on = np.zeros(first[-1], bool)
                on[[first[t] + leaf for t, leaf in visit(forest.value, counts, q, BUDGET * total, k + 1)]] = True
                reached.append(np.packbits(on).tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(reached, pa.binary())], names=["id", "v", "uid", "reached"])

    asked = placed.filter(wanted).select("id", "v", "uid").mapInArrow(walk, f"id long, v {kind}, uid long, reached binary")
    asked = materialize(asked.withColumn("part", F.pmod(F.xxhash64("uid"), F.lit(groups))), "queries")
    found = None
    for g in range(groups):
        some = asked.filter(F.col("part") == g).toArrow().sort_by("uid")
        if some.num_rows:
            best = placed.select("id", "v", "uid", "leaves").mapInArrow(_rerank(spark, some, first[-1], k), "asking long, query_id long, stage int, vec_id long, score double")
            best = materialize(best, "best") if groups > 1 else best
            found = best if found is None else found.unionByName(best)
    top = lambda df, *key: df.groupBy(*key).agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k).alias("top"))
    staged = top(found, "asking", "query_id", "stage").select("asking", "query_id", F.explode("top").alias("n")).select("asking", "query_id", "n.*")
    return top(staged, "asking", "query_id").select("query_id", F.posexplode("top").alias("rank", "n")).select("query_id", (F.col("rank") + 1).alias("rank"), "n.vec_id", "n.score")


def _rerank(spark: SparkSession, asked: pa.Table, leaves: int, k: int) -> Callable:
    """The task that finds the k best of its rows for each of the queries `asked`, among rows in leaves they reached."""
    reached = np.unpackbits(np.frombuffer(b"".join(asked["reached"].to_pylist()), np.uint8).reshape(asked.num_rows, -1), axis=1)[:, :leaves]
    shared = spark.sparkContext.broadcast((asked["uid"].to_numpy(), asked["id"].to_numpy(), _matrix(asked["v"]), np.packbits(reached.T, axis=1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uids, ids, q, packed = shared.value
        on = np.unpackbits(packed, axis=1)[:, : len(uids)]  # leaves x queries
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64))] * len(uids)
        bound, norm = np.full(len(uids), np.inf), (q**2).sum(1)

        def tile(held: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(held)
            names, x, own = table["id"].to_numpy(), _matrix(table["v"]), table["uid"].to_numpy()
            at_leaf = np.array(table["leaves"].combine_chunks().flatten()).reshape(len(own), -1)
            squares = (x**2).sum(1)
            for a in range(0, len(uids), 256):
                b = min(a + 256, len(uids))
                met = np.zeros((len(own), b - a), np.uint8)
                for t in range(at_leaf.shape[1]):
                    met |= on[at_leaf[:, t], a:b]
                some = np.flatnonzero(met.any(1))
                if not len(some):
                    continue
                near = squares[some][None, :] - 2 * q[a:b] @ x[some].T + norm[a:b, None]
                near[met[some].T == 0] = np.inf
                near[uids[a:b, None] == own[some][None, :]] = np.inf
                kth = np.partition(near, min(k, near.shape[1]) - 1, axis=1)[:, min(k, near.shape[1]) - 1]
                cut = np.minimum(kth, bound[a:b])
                for i in np.flatnonzero((near <= (cut + 1e-9 * (1 + np.abs(cut)))[:, None]).any(1)):
                    c = cut[i]
                    at = some[(near[i] <= c + 1e-9 * (1 + abs(c))) & (near[i] < np.inf)]  # rounding of `near` loses no tie
                    far, who = best[a + i]
                    far = np.concatenate((far, np.sqrt(((x[at] - q[a + i]) ** 2).sum(1))))
                    who = np.concatenate((who, names[at]))
                    order = np.lexsort((who, far))[:k]
                    best[a + i] = far[order], who[order]
                    if len(order) == k:
                        bound[a + i] = far[order[-1]] ** 2

        held, n = [], 0
        for b in batches:
            for i in range(0, b.num_rows, BLOCK):
                held.append(b.slice(i, BLOCK))
                n += held[-1].num_rows
                if n >= BLOCK:
                    tile(held)
                    held, n = [], 0
        if n:
            tile(held)
        size = np.array([len(w) for _, w in best])
        stage = TaskContext.get().partitionId() % MERGE
        columns = [np.repeat(uids, size), np.repeat(ids, size), np.full(size.sum(), stage, np.int32), np.concatenate([w for _, w in best]), np.concatenate([f for f, _ in best])]
        if size.sum():
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["asking", "query_id", "stage", "vec_id", "score"])

    return run


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(load(spark, sf_dir, "embeddings"))
