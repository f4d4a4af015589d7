"""Exact inner-product top-k by ball trees.

Vectors are dealt into shards of bounded size; each shard is a ball tree whose
nodes (centre, radius) bound the inner product of anything below them by
q.c + |q| r. A block of queries goes through the nodes of a shard by that bound,
best first, and leaves a node alone once its bound is below the query's kth
score. That score is shared: a first round answers each query from one shard,
a second takes the kth score found there into every other shard.

Scores are products of floor(256 x), sums of integers below 2^53, so that
float64 arithmetic is exact; a node is left out only if its bound is below the
kth score by more than the bound's own rounding error.

Defined results: vectors that are null, empty or hold null or non-finite
components take no part, nor do rows without an identifier; a query meets only
vectors of its own dimension and never a row of its own identifier; repeated
rows are candidates each, told apart by nothing, so that ties may list an
identifier twice; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import session, stored

SCALE = 256
#: Vectors in a shard, queries in a block, vectors in a leaf.
SHARD, BLOCK, LEAF = 8192, 512, 64

FOUND = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, dim and q (floor(256 x) as double) of the vectors that take part."""
    x = F.col(vector_col)
    fine = x.isNotNull() & F.col(id_col).isNotNull() & (F.size(x) > 0) & F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vectors.where(fine).select(
        F.col(id_col).cast("long").alias("id"), F.size(x).alias("dim"),
        F.transform(x, lambda v: F.floor(v.cast("double") * SCALE).cast("double")).alias("q"))


class BallTree:
    """Nodes in pre-order over rows kept side by side: bounds by one product."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.lexsort((ids,))
        self.ids, self.x = ids[order], x[order]
        leaves = []
        todo = [np.arange(len(ids))]
        while todo:
            rows = todo.pop()
            if len(rows) <= LEAF:
                leaves.append(rows)
                continue
            own = self.x[rows]
            # split along the line between two far points (ties by place: equal vectors halve too)
            a = own[np.argmax(((own - own.mean(0)) ** 2).sum(1))]
            b = own[np.argmax(((own - a) ** 2).sum(1))]
            along = np.argsort(own @ (b - a), kind="stable")
            half = len(rows) // 2
            todo += [rows[along[:half]], rows[along[half:]]]
        self.leaves = leaves
        self.centre = np.array([self.x[r].mean(0) for r in leaves])
        self.radius = np.array([np.sqrt(((self.x[r] - c) ** 2).sum(1).max()) for r, c in zip(leaves, self.centre)])
        # balls of balls: the branches above the leaves
        size = 8
        self.groups = [np.arange(i, min(i + size, len(leaves))) for i in range(0, len(leaves), size)]
        self.g_centre = np.array([self.centre[g].mean(0) for g in self.groups])
        self.g_radius = np.array([(np.sqrt(((self.centre[g] - c) ** 2).sum(1)) + self.radius[g]).max()
                                  for g, c in zip(self.groups, self.g_centre)])

    def search(self, q_ids: np.ndarray, q: np.ndarray, kth: np.ndarray, k: int) -> list[tuple[int, int, int]]:
        """(query, vector, score) of each query's k best here that reach its kth score so far."""
        norm = np.sqrt((q ** 2).sum(1))
        slack = 1e-9 * (1 + norm[:, None])
        g_bound = q @ self.g_centre.T + norm[:, None] * self.g_radius[None, :]
        g_bound += np.abs(g_bound) * 1e-9 + slack
        out = []
        for i in range(len(q)):
            best_s, best_i, floor = np.empty(0), np.empty(0, np.int64), kth[i]
            for g in np.argsort(-g_bound[i], kind="stable"):
                if g_bound[i, g] < floor:
                    break
                below = self.groups[g]
                bound = self.centre[below] @ q[i] + norm[i] * self.radius[below]
                bound += np.abs(bound) * 1e-9 + slack[i]
                for j in np.argsort(-bound, kind="stable"):
                    if bound[j] < floor:
                        break
                    rows = self.leaves[below[j]]
                    s = self.x[rows] @ q[i]
                    take = (s >= floor) & (self.ids[rows] != q_ids[i])
                    if take.any():
                        best_s = np.concatenate([best_s, s[take]])
                        best_i = np.concatenate([best_i, self.ids[rows][take]])
                        if len(best_s) > k:
                            top = np.lexsort((best_i, -best_s))[:k]
                            best_s, best_i = best_s[top], best_i[top]
                        if len(best_s) == k:
                            floor = max(floor, best_s.min())
            out += [(int(q_ids[i]), int(v), int(s)) for v, s in zip(best_i, best_s)]
        return out


def _search(key, shard: pd.DataFrame, block: pd.DataFrame, k: int) -> pd.DataFrame:
    if not len(shard) or not len(block):
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
    tree = BallTree(shard["id"].to_numpy(), np.array(shard["q"].tolist(), np.float64))
    found = tree.search(block["id"].to_numpy(), np.array(block["q"].tolist(), np.float64),
                        block["kth"].to_numpy(np.float64), k)
    return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best vectors. Both frames
    are ``quantised``; ``queries`` is a stated part of the rows."""
    session(vectors)
    vectors, queries = stored(vectors, "vectors"), stored(queries.dropDuplicates(["id"]), "queries")
    n, m = vectors.count(), queries.count()
    shards, blocks = -(-n // SHARD) or 1, -(-m // BLOCK) or 1
    in_shard = vectors.withColumn("shard", F.pmod(F.xxhash64("id", "q"), F.lit(shards)).cast("int"))
    in_block = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))

    def cells(left: DataFrame, right: DataFrame) -> DataFrame:
        def run(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            return _search(key, a, b, k)
        keys = ["dim", "shard", "block"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, FOUND)

    # round 1: every query block against one shard; round 2: against the others, with the kth score found
    by_block = in_shard.withColumn("block", F.explode(F.expr(f"sequence(0, {blocks - 1})")))
    home = F.pmod(F.col("block"), F.lit(shards))
    first = stored(cells(by_block.where(F.col("shard") == home),
                         in_block.withColumn("shard", home).withColumn("kth", F.lit(float("-inf")))), "first-round")
    kth = best(first, k).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
    known = in_block.join(kth, "id", "left").withColumn(
        "kth", F.coalesce(F.col("kth").cast("double"), F.lit(float("-inf"))))
    to_all = known.withColumn("shard", F.explode(F.expr(f"sequence(0, {shards - 1})"))).where(F.col("shard") != home)
    second = cells(by_block.where(F.col("shard") != home), to_all)
    return best(first.unionByName(second), k)


def best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id,
         CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
