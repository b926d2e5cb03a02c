"""Approximate nearest neighbours by low-dimensional stable projections.

Vectors are scaled to length 1, so that the largest cosine is the smallest
distance, and projected by a Gaussian matrix (2-stable) to a few dimensions,
indexed by a kd-tree.  A query takes up the leaves in order of their projected
distance, verifies their vectors, and stops when a chi-square test holds: for a
point at true distance d, (projected distance / d)^2 is chi-square distributed,
so once F(next leaf's projected distance^2 / k-th best distance^2) reaches the
confidence, a better point is unlikely to be left.

Equal vectors are one index entry with its smallest ids, which are all that can
be among the nearest; every row is indexed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PROJECTED = 8            # even: the test's distribution function is then a finite sum
CONFIDENCE = 0.95
LEAF = 32
LEAVES_A_STEP = 32       # leaves verified between two tests
BLOCK_ROWS = 8_192       # index entries, and queries, of one block (on average)
K = 5


def chi_square(x: np.ndarray | float, degrees: int) -> np.ndarray | float:
    """Distribution function for an even number of degrees."""
    half = np.asarray(x, np.float64) / 2
    term, total = np.ones_like(half), np.ones_like(half)
    for j in range(1, degrees // 2):
        term = term * half / j
        total = total + term
    return 1 - np.exp(-half) * total


class ProjectionTree:
    """kd-tree over projected unit vectors; leaves hold about ``LEAF`` of them."""

    def __init__(self, vectors: np.ndarray, projected: int = PROJECTED, seed: int = 1) -> None:
        self.unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        self.matrix = np.random.default_rng(seed).standard_normal((vectors.shape[1], projected))
        points = self.unit @ self.matrix
        leaves, todo = [], [np.arange(len(points))]
        while todo:
            rows = todo.pop()
            if len(rows) <= LEAF:
                leaves.append(rows)
                continue
            axis = np.argmax(np.ptp(points[rows], axis=0))
            order = rows[np.argsort(points[rows, axis], kind="stable")]
            todo += [order[:len(order) // 2], order[len(order) // 2:]]
        self.leaves = leaves
        self.low = np.array([points[rows].min(axis=0) for rows in leaves])
        self.high = np.array([points[rows].max(axis=0) for rows in leaves])

    def nearest(self, query: np.ndarray, k: int, confidence: float = CONFIDENCE) -> np.ndarray:
        """Rows that hold the ``k`` nearest found, nearest first; rows as near as the last (to 1e-9) come along."""
        unit = query / np.linalg.norm(query)
        point = unit @ self.matrix
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        reach = (gap * gap).sum(axis=1)
        order = np.argsort(reach, kind="stable")
        rows, similar = np.zeros(0, np.int64), np.zeros(0)
        for at in range(0, len(order), LEAVES_A_STEP):
            if len(rows) >= k:
                best = max(2 - 2 * similar[k - 1], 1e-18)
                if chi_square(reach[order[at]] / best, len(point)) >= confidence:
                    break
            found = np.concatenate([self.leaves[n] for n in order[at:at + LEAVES_A_STEP]])
            rows, similar = np.concatenate([rows, found]), np.concatenate([similar, self.unit[found] @ unit])
            best_first = np.argsort(-similar, kind="stable")
            if len(best_first) > k:
                best_first = best_first[:max(k, int((similar >= similar[best_first[k - 1]] - 1e-9).sum()))]
            rows, similar = rows[best_first], similar[best_first]
        return rows


def cosine(a: list[float], b: list[float]) -> float:
    """In double precision, every sum rounded once, so equal pairs have equal scores."""
    return (math.fsum(x * y for x, y in zip(a, b, strict=True))
            / (math.sqrt(math.fsum(x * x for x in a)) * math.sqrt(math.fsum(y * y for y in b))))


def usable(embeddings: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id long, v array<double>`` of rows with an id and a finite vector that isn't zero; equal rows once."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (embeddings.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v"))
            .filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))
            .dropDuplicates(["vec_id", "v"]))


def search(embeddings: DataFrame, queries: DataFrame, k: int = K, confidence: float = CONFIDENCE,
           block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` nearest found by cosine.

    Both frames: ``vec_id, v`` as :func:`usable` gives them.  Ties go to the
    smaller vec_id; rows with the query's own id are no candidates, nor are
    vectors of another length.  Queries and index entries meet block by block.
    """
    by_vector = Window.partitionBy("v").orderBy("vec_id")
    ranked = embeddings.withColumn("nth", F.row_number().over(by_vector)).filter(F.col("nth") <= k + 1)
    entries = ranked.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))  # k + 1 ids at most
    n, n_queries = embeddings.count(), queries.count()
    # by rows alone, not by the session's settings: which vectors share a tree decides what is found
    blocks, query_blocks = max(1, -(-n // block_rows)), max(1, -(-n_queries // block_rows))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    index = (entries.withColumn("size", F.size("v")).withColumn("block", F.pmod(F.xxhash64("v"), F.lit(blocks)).cast("int"))
             .withColumn("part", every(query_blocks)))
    asked = (queries.withColumn("size", F.size("v")).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int"))
             .withColumn("block", every(blocks)))

    def meet(own: pa.Table, others: pa.Table) -> pa.Table:
        out: tuple[list, ...] = ([], [], [])
        if own.num_rows and others.num_rows:
            listed = sorted(zip(others.column("v").to_pylist(), others.column("ids").to_pylist(), strict=True), key=lambda r: r[1])
            tree = ProjectionTree(np.array([v for v, _ in listed]))
            for query, v in zip(own.column("vec_id").to_pylist(), own.column("v").to_pylist(), strict=True):
                # one entry may hold the query alone, so one more is looked for
                found = [(-cosine(v, listed[r][0]), i) for r in tree.nearest(np.array(v), k + 1, confidence).tolist()
                         for i in listed[r][1] if i != query]
                for score, i in sorted(found)[:k]:
                    for column, value in zip(out, (query, i, -score), strict=True):
                        column.append(value)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()),
                         "score": pa.array(out[2], pa.float64())})

    keys = ["size", "part", "block"]
    found = (asked.select(*keys, "vec_id", "v").groupBy(*keys).cogroup(index.select(*keys, "v", "ids").groupBy(*keys))
             .applyInArrow(meet, "query_id long, vec_id long, score double").dropDuplicates(["query_id", "vec_id", "score"]))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
