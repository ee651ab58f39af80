"""Approximate nearest neighbours: a forest of random-projection trees and one priority queue per query.

The largest inner product is searched as the smallest angle: vectors get one more component that brings all to the
same length. Trees are fitted on a bounded sample; every row is then put into one leaf of each tree. A query descends
all trees through one queue, nearest splits first, and the rows of the leaves it visits are scored exactly.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainscope.llm.vectors import common_size, matrix, sample, usable
from grainscope.session import save_and_reload, shared_dir

TREES = 8
DEPTH = 5                 # at most 2 ** DEPTH leaves per tree
LEAST_LEAF = 32           # rows of the sample below which a node is not split
SAMPLE = 20_000           # rows of the training sample
VISITS = 44               # leaves that one query visits, over all trees
BLOCK = 4096              # rows and queries scored at once


@dataclass
class Forest:
    """Nodes of all trees in arrays: plane, threshold, children (-1: leaf) and the number of the leaf."""

    planes: np.ndarray
    thresholds: np.ndarray
    children: np.ndarray
    leaf: np.ndarray
    roots: list[int]

    @classmethod
    def fit(cls, x: np.ndarray, seed: int = 0) -> Forest:
        rng = np.random.default_rng(seed)
        planes: list[np.ndarray] = []
        thresholds: list[float] = []
        children: list[tuple[int, int]] = []
        leaf: list[int] = []

        def grow(rows: np.ndarray, depth: int) -> int:
            node = len(children)
            planes.append(np.zeros(x.shape[1]))
            thresholds.append(0.0)
            children.append((-1, -1))
            leaf.append(-1)
            if depth and len(rows) >= 2 * LEAST_LEAF:
                for _ in range(5):                                   # equal vectors give no plane: draw again
                    a, b = x[rng.choice(rows, 2, replace=False)]
                    length = np.linalg.norm(a - b)
                    if not length:
                        continue
                    plane = (a - b) / length
                    side = x[rows] @ plane
                    cut = float(np.median(side))
                    low = side < cut
                    if low.any() and not low.all():
                        planes[node], thresholds[node] = plane, cut
                        children[node] = grow(rows[low], depth - 1), grow(rows[~low], depth - 1)
                        return node
            leaf[node] = sum(n >= 0 for n in leaf)
            return node

        roots = [grow(np.arange(len(x)), DEPTH) for _ in range(TREES)]
        return cls(np.array(planes), np.array(thresholds), np.array(children), np.array(leaf), roots)

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Signed distance of each row from the plane of each node."""
        return x @ self.planes.T - self.thresholds

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row in each tree."""
        side = self.margins(x) >= 0
        out = np.empty((len(x), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            node = np.full(len(x), root)
            while (inner := self.children[node, 0] >= 0).any():
                down = self.children[node, side[np.arange(len(x)), node].astype(int)]
                node = np.where(inner, down, node)
            out[:, t] = self.leaf[node]
        return out

    def visit(self, margins: np.ndarray, sizes: np.ndarray, visits: int, least: int) -> list[int]:
        """Leaves in the order of one queue over all trees; the priority of a node is its smallest margin so far."""
        queue = [(-np.inf, root) for root in self.roots]
        found: list[int] = []
        rows = 0
        while queue and (len(found) < visits or rows < least):
            worst, node = heapq.heappop(queue)
            low, high = self.children[node]
            if low < 0:
                found.append(int(self.leaf[node]))
                rows += int(sizes[self.leaf[node]])
                continue
            m = float(margins[node])
            heapq.heappush(queue, (max(worst, m), int(low)))
            heapq.heappush(queue, (max(worst, -m), int(high)))
        return found


def nearest(queries: pa.Table, rows: pa.Table, size: int, k: int) -> pa.Table:
    """The k rows of the largest inner product with each query, its own row excepted; ties to the smaller id."""
    q, x = matrix(queries["vector"], size), matrix(rows["vector"], size)
    qid, xid = queries["query_id"].to_numpy(), rows["vec_id"].to_numpy()
    rough = q @ x.T
    rough[qid[:, None] == xid[None, :]] = -np.inf
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in range(len(q)):
        r = rough[i]
        if len(r) > k:
            edge = np.partition(r, len(r) - k)[len(r) - k]
            at = np.flatnonzero(r >= edge - 1e-9 * (1 + abs(edge)))
        else:
            at = np.arange(len(r))
        at = at[r[at] > -np.inf]
        score = (x[at] * q[i]).sum(axis=1)                 # summed alike for equal vectors
        best = np.lexsort((xid[at], -score))[:k]
        out.append((np.full(len(best), qid[i]), xid[at][best], score[best]))
    a, b, c = (np.concatenate(v) for v in zip(*out))
    return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": c})


def search(rows: DataFrame, queries: DataFrame, k: int = 20, visits: int = VISITS, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score): up to ``k`` rows of the largest inner product for each query.

    Vectors that are NULL, zero, of an unusual size, or hold NULL or non-finite components take no part, nor do rows
    with a NULL id; equal vectors are ranked by id; other columns are ignored. A query has no row when nothing else
    takes part. The forest is fitted on about SAMPLE rows, and its size is bounded by TREES and DEPTH; all rows are
    indexed. Leaves with many rows or queries are dealt out in blocks, so no task holds a whole leaf.
    """
    spark = rows.sparkSession
    folder = shared_dir(spark)
    size = common_size(rows, vector_col)
    result = "query_id long, vec_id long, score double"
    if not size:
        return spark.createDataFrame([], result).select("query_id", F.lit(1).alias("rank"), "vec_id", "score")

    def valid(df: DataFrame) -> DataFrame:
        return df.where(F.col(id_col).isNotNull() & usable(F.col(vector_col), size)).select(
            F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))

    data, asked = valid(rows), valid(queries).withColumnRenamed("vec_id", "query_id")
    square = F.aggregate("vector", F.lit(0.0), lambda s, v: s + v * v)
    longest = data.agg(F.max(square)).first()[0]
    if longest is None:
        return spark.createDataFrame([], result).select("query_id", F.lit(1).alias("rank"), "vec_id", "score")

    def lifted(x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(longest - (x * x).sum(axis=1), 0))
        return np.concatenate([x, rest[:, None]], axis=1)

    forest = spark.sparkContext.broadcast(Forest.fit(lifted(sample(data, "vec_id", "vector", SAMPLE))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = forest.value.leaves(lifted(matrix(batch.column(1), size)))
            at = pa.array(np.repeat(np.arange(len(batch)), found.shape[1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(found.reshape(-1))],
                ["vec_id", "vector", "leaf"])

    placed = save_and_reload(data.mapInArrow(place, "vec_id long, vector array<double>, leaf long"), f"{folder}/placed")
    counts = dict(placed.groupBy("leaf").count().collect())          # one row per leaf of the bounded forest
    sizes = np.zeros(int(forest.value.leaf.max()) + 1, np.int64)
    sizes[list(counts)] = list(counts.values())

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), size)
            margins = forest.value.margins(np.concatenate([x, np.zeros((len(x), 1))], axis=1))
            found = [forest.value.visit(m, sizes, visits, 4 * k) for m in margins]
            at = pa.array(np.repeat(np.arange(len(x)), [len(f) for f in found]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate(found).astype(np.int64))],
                ["query_id", "vector", "leaf"])

    routed = save_and_reload(asked.mapInArrow(route, "query_id long, vector array<double>, leaf long"), f"{folder}/routed")
    # blocks of a leaf: its rows times its queries, each dealt out by a hash of the id
    loads = spark.createDataFrame(
        [(int(a), -(-int(n) // BLOCK)) for a, n in counts.items()], "leaf long, row_blocks int").join(
        routed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("query_blocks")), "leaf")
    loads = save_and_reload(loads, f"{folder}/loads")                # one row per leaf

    def blocks(df: DataFrame, own: str, own_id: str, other: str) -> DataFrame:
        return df.join(loads, "leaf").withColumn(
            own, F.pmod(F.xxhash64(own_id), F.col(f"{own}s")).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)))

    key = ["leaf", "row_block", "query_block"]
    left = blocks(routed, "query_block", "query_id", "row_block").select(*key, "query_id", "vector")
    right = blocks(placed, "row_block", "vec_id", "query_block").select(*key, "vec_id", "vector")

    def score(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()),
                             "score": pa.array([], pa.float64())})
        return nearest(a, b, size, k)

    scored = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(score, result)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn(
        "rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
