"""Approximate nearest neighbours by inner product: stable projections, kd-trees and a chi-square stopping test.

Largest inner product becomes smallest distance by one more coordinate: a candidate x of a block whose longest vector
has length M becomes (x, sqrt(M^2 - |x|^2)), a query q becomes (q, 0). A 2-stable (Gaussian) matrix projects these to ``dims``
coordinates, where a kd-tree indexes them. For a query the leaves come in order of their projected distance, and
all points of a leaf are verified by their true inner product. Since a squared projected distance over the squared true
distance is chi-square with ``dims`` degrees, the search stops when the next leaf is so far that a point nearer than the
k-th best so far would lie there with probability 1 - ``confidence`` at most.

Vectors are dealt into blocks of bounded size by a hash of their id, and so are queries; every block of vectors is
indexed and meets every block of queries in one task, which returns k rows a query. Identical vectors are one point of the
tree, with the smallest of their ids; all of a block's ids stay represented, as at most k of equals can be answers.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import only, stored

DIMS, LEAF, CONFIDENCE, K = 8, 32, 0.98, 20
BLOCK, QUERY_BLOCK = 16_384, 4_096
#: Rounding of an inner product, as a share of the squared lengths.
NEAR = 1e-12
#: Leaves that are verified between two tests.
STEP = 8


def chi_square_quantile(p: float, dims: int) -> float:
    """The value below which a chi-square variable with an even number of degrees lies with probability p."""
    half = dims // 2

    def below(x: float) -> float:
        term = total = 1.0
        for i in range(1, half):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


class ProjectedTree:
    """kd-tree over projected points; its leaves partition the points, with a bounding box each."""

    def __init__(self, vectors: np.ndarray, dims: int = DIMS, leaf: int = LEAF):
        norms = np.einsum("ij,ij->i", vectors, vectors)
        self.top = float(norms.max())
        self.vectors = vectors
        rest = np.sqrt(np.maximum(0.0, self.top - norms))
        rng = np.random.default_rng(vectors.shape[1])
        matrix = rng.standard_normal((vectors.shape[1] + 1, dims))
        self.matrix = matrix[:-1]
        points = vectors @ self.matrix + rest[:, None] * matrix[-1]
        self.leaves: list[np.ndarray] = []
        pending = [np.arange(len(points))]
        while pending:
            rows = pending.pop()
            if len(rows) <= leaf:
                self.leaves.append(rows)
                continue
            axis = int(np.argmax(np.ptp(points[rows], axis=0)))
            half = len(rows) // 2
            order = np.argpartition(points[rows, axis], half)
            pending += [rows[order[:half]], rows[order[half:]]]
        self.low = np.array([points[r].min(axis=0) for r in self.leaves])
        self.high = np.array([points[r].max(axis=0) for r in self.leaves])

    def search(self, query: np.ndarray, k: int, limit: float, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Rows and inner products of the best k points found; skip: a row that is not a candidate."""
        at = query @ self.matrix
        gap = np.maximum(0.0, np.maximum(self.low - at, at - self.high))
        far = np.einsum("ij,ij->i", gap, gap)
        order = np.argsort(far, kind="stable")
        length = float(query @ query) + self.top
        rows, scores = np.empty(0, np.int64), np.empty(0)
        for i in range(0, len(order), STEP):
            if len(rows) >= k and far[order[i]] >= limit * max(0.0, length - 2 * np.partition(scores, -k)[-k]):
                break
            new = np.concatenate([self.leaves[j] for j in order[i : i + STEP]])
            new = new[new != skip]
            rows, scores = np.concatenate([rows, new]), np.concatenate([scores, self.vectors[new] @ query])
            if len(rows) > k:
                best = np.argpartition(-scores, k - 1)
                keep = scores >= scores[best[k - 1]] - NEAR * length  # with all that tie with the last, but for rounding
                rows, scores = rows[keep], scores[keep]
        # A matrix product rounds by the rows around; these sums do not, so equal vectors have equal scores in every block.
        return rows, (self.vectors[rows] * query).sum(axis=1)


def _search_block(k: int, dims: int, confidence: float):
    limit = chi_square_quantile(confidence, dims)

    def run(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(queries) and len(block):
            block = block.sort_values(["vec_id", "copy"])
            ids, copies = block["vec_id"].to_numpy(np.int64), block["copy"].to_numpy(np.int64)
            every = np.array(block["v"].tolist(), np.float64)
            _, first, group = np.unique(every, axis=0, return_index=True, return_inverse=True)
            # The ids of each distinct vector, ascending.
            order = np.argsort(group.ravel(), kind="stable")
            starts = np.searchsorted(group.ravel()[order], np.arange(len(first) + 1))
            tree = ProjectedTree(every[first], dims)
            for own, copy, vector in zip(queries["vec_id"], queries["copy"], queries["v"], strict=True):
                q = np.asarray(vector, np.float64)
                # One more, as the query's own row may be among them.
                points, scores = tree.search(q, k + 1, limit)
                members = [order[starts[p] : starts[p + 1]][: k + 1] for p in points]
                at = np.concatenate(members)
                values = np.repeat(scores, [len(m) for m in members])
                other = (ids[at] != own) | (copies[at] != copy)
                at, values = at[other], values[other]
                best = np.lexsort((copies[at], ids[at], -values))[:k]
                out.append((np.full(len(best), own), np.full(len(best), copy), ids[at][best], values[best]))
        names = {"query_id": "int64", "query_copy": "int64", "vec_id": "int64", "score": "float64"}
        if not out:
            return pd.DataFrame({c: pd.Series(dtype=kind) for c, kind in names.items()})
        return pd.DataFrame({c: np.concatenate([o[i] for o in out]) for i, c in enumerate(names)})

    return run


def valid_vectors(table: DataFrame) -> DataFrame:
    """vec_id, copy, v (doubles) and size: vectors that are neither null nor zero and hold no null or non-finite component.

    Rows without vec_id are left out. Rows that share a vec_id are told apart by copy, from 1 in the order of their vectors.
    """
    rows = only(table, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(F.exists("v", bad), F.lit(True)) & F.exists("v", lambda x: x != 0))
    copy = F.row_number().over(Window.partitionBy("vec_id").orderBy("v"))
    return rows.select("vec_id", copy.cast("long").alias("copy"), "v", F.size("v").alias("size"))


def nearest(
    table: DataFrame, query: str, k: int = K, dims: int = DIMS, confidence: float = CONFIDENCE, block: int = BLOCK, query_block: int = QUERY_BLOCK
) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k nearest found, nearest first, ties to the smaller vec_id.

    table: vec_id and embedding; query: an SQL condition on vec_id that says which rows are queries. A query is no candidate
    of its own; another row with its vec_id is one. With fewer than k candidates all come. Scores are inner products in double
    precision. Vectors are compared with those of their own length. Every block of queries meets every block of vectors in a task
    of its own, so the work grows as queries x vectors / block, and a task's memory does not.
    """
    vectors = stored(valid_vectors(table), "vectors")
    queries = vectors.where(query)
    n, m = vectors.count(), queries.count()
    blocks, query_blocks = max(1, math.ceil(n / block)), max(1, math.ceil(m / query_block))
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    a = queries.select("vec_id", "copy", "v", "size", F.pmod(F.xxhash64("vec_id", "copy", F.lit(1)), F.lit(query_blocks)).cast("int").alias("qb"), each(blocks).alias("b"))
    c = vectors.select("vec_id", "copy", "v", "size", F.pmod(F.xxhash64("vec_id", "copy"), F.lit(blocks)).cast("int").alias("b"), each(query_blocks).alias("qb"))

    def run(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        return _search_block(k, dims, confidence)(queries, block)

    keys = ("size", "qb", "b")
    found = a.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInPandas(run, "query_id long, query_copy long, vec_id long, score double")
    order = Window.partitionBy("query_id", "query_copy").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
