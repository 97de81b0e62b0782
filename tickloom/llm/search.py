"""Exact search by inner product: a ball tree in each shard of vectors, branch and bound, shared bounds.

Vectors become integers, floor(1024 * x). Shards are dealt by a hash; each task builds the ball tree of its shard
(Ram and Gray 2012) and answers blocks of queries. A node can hold no score above q.c + |q| r for its centre c and
radius r; nodes are visited in that order, and a node below the query's current kth score is skipped.
A first pass over the most promising leaf of each shard gives every query a kth score to begin with, shared by all shards.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import stage_table

SCALE = 1024
K = 10
LEAF = 64
# Vectors of a shard and queries of a block: they set the memory of a task, whatever the size of the tables.
ROWS_PER_SHARD = 20_000
QUERIES_PER_BLOCK = 1_000
# Integers up to here make exact products in 64 bits with up to 2^20 components.
SAFE = 1 << 21
# Below this doubles hold every integer; the bound on |q| |v| leaves room for its own rounding.
EXACT = 2.0**52
LIMITS = (-(1 << 63), (1 << 63) - 1)


def integer_vectors(table: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows with a whole vector: null vectors and null or non-finite components take no part.

    Components beyond 2^62 after scaling are held at that bound, so that they stay integers.
    """
    x = F.transform("embedding", lambda c: c.cast("double"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    scaled = F.transform(x, lambda c: F.floor(F.greatest(F.lit(-(2.0**62)), F.least(F.lit(2.0**62), c * SCALE))).cast("long"))
    whole = table.filter(F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(False)))
    return whole.select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("v"))


def exact_products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Integer inner products; beyond 64 bits they are computed in Python's integers and held at the limits."""
    if rows.size == 0:
        return np.zeros(len(rows), np.int64)
    if max(np.abs(rows.astype(float)).max(), np.abs(query.astype(float)).max()) <= SAFE:
        return rows @ query
    big = rows.astype(object) @ query.astype(object)
    return np.array([min(max(int(s), LIMITS[0]), LIMITS[1]) for s in big], np.int64)


class BallTree:
    """Balls over integer vectors: for each node its range of rows, centre, radius and children.

    ``rows`` and their copy in doubles, ``real``, lie in the tree's ``order``, so a leaf is a slice of both.
    """

    def __init__(self, rows: np.ndarray):
        self.real = rows.astype(float)
        self.order = np.arange(len(rows))
        self.nodes: list[tuple[int, int, np.ndarray, float, int, int]] = []
        self._grow(0, len(rows))
        self.rows, self.real = rows[self.order], self.real[self.order]
        self.longest = float(np.linalg.norm(self.real, axis=1).max(initial=0))

    def exact_in_doubles(self, queries: np.ndarray) -> np.ndarray:
        """Queries whose products with every row, partial sums included, are integers that doubles hold."""
        return np.linalg.norm(queries, axis=1) * self.longest < EXACT

    def _grow(self, first: int, last: int) -> int:
        at = self.order[first:last]
        points = self.real[at]
        centre = points.mean(axis=0)
        apart = np.linalg.norm(points - centre, axis=1)
        me = len(self.nodes)
        self.nodes.append((first, last, centre, float(apart.max()), -1, -1))
        if last - first > LEAF and apart.max() > 0:
            # Two far points; the half nearer to each makes a child, so depth stays logarithmic.
            far = points[int(apart.argmax())]
            other = points[int(np.linalg.norm(points - far, axis=1).argmax())]
            side = points @ (other - far)
            middle = (last - first) // 2
            self.order[first:last] = at[np.argpartition(side, middle)]
            left = self._grow(first, first + middle)
            right = self._grow(first + middle, last)
            self.nodes[me] = (first, last, centre, float(apart.max()), left, right)
        return me

    def leaf_products(self, first: int, last: int, query: np.ndarray, in_doubles: bool) -> np.ndarray:
        """Integer inner products of a leaf's rows."""
        if in_doubles:
            return (self.real[first:last] @ query.astype(float)).astype(np.int64)
        return exact_products(self.rows[first:last], query)

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        return np.array([n[2] for n in self.nodes]), np.array([n[3] for n in self.nodes])


def search_tree(tree: BallTree, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, floors: list[int | None], k: int, leaves: int | None) -> list[list[tuple[int, int]]]:
    """For each query its best (score, -id), best first; ``leaves`` stops after so many leaves."""
    centres, radii = tree.arrays()
    real = queries.astype(float)
    # Rounding of the bound is far below this slack; scores are exact.
    slack = 1e-9 * (1 + np.linalg.norm(real, axis=1)[:, None] * (np.linalg.norm(centres, axis=1) + radii))
    bounds = real @ centres.T + np.linalg.norm(real, axis=1)[:, None] * radii + slack
    fits = tree.exact_in_doubles(real)
    ids = ids[tree.order]
    found = []
    for i, query in enumerate(queries):
        best: list[tuple[int, int]] = []
        floor = floors[i]
        ahead = [(-bounds[i, 0], 0)]
        looked = 0
        while ahead and (leaves is None or looked < leaves):
            bound, node = heapq.heappop(ahead)
            least = best[0][0] if len(best) == k else None
            least = floor if least is None else least if floor is None else max(least, floor)
            if least is not None and -bound < least:
                break
            first, last, _, _, left, right = tree.nodes[node]
            if left >= 0:
                heapq.heappush(ahead, (-bounds[i, left], left))
                heapq.heappush(ahead, (-bounds[i, right], right))
                continue
            looked += 1
            scores = tree.leaf_products(first, last, query, bool(fits[i]))
            others = ids[first:last] != own[i]
            some = np.flatnonzero(others if least is None else others & (scores >= least))
            for score, vec in zip(scores[some].tolist(), ids[first:last][some].tolist()):
                if len(best) < k:
                    heapq.heappush(best, (score, -vec))
                elif (score, -vec) > best[0]:
                    heapq.heapreplace(best, (score, -vec))
        found.append(sorted(best, reverse=True))
    return found


def _answer(k: int, leaves: int | None) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        is_query = table.column("is_query").to_numpy(zero_copy_only=False)
        rows, asked = table.filter(pa.array(~is_query)), table.filter(pa.array(is_query))
        out: list[tuple[int, int, int]] = []
        if rows.num_rows and asked.num_rows:
            matrix = lambda t: np.array(t.column("v").to_pylist(), np.int64).reshape(t.num_rows, -1)
            own = asked.column("vec_id").to_numpy()
            tree = BallTree(matrix(rows))
            found = search_tree(tree, rows.column("vec_id").to_numpy(), matrix(asked), own, asked.column("floor").to_pylist(), k, leaves)
            out = [(q, -vec, score) for q, best in zip(own.tolist(), found) for score, vec in best]
        return pa.table([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], ["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = K, per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """The ``k`` highest inner products of each query: query_id, rank from 1, vec_id, score; ties to the smaller id.

    Both tables have vec_id and ``v`` (see ``integer_vectors``). A query meets every row but those of its own id, of vectors
    with as many components as its own. Null ids take no part. Repeated ids stay separate candidates of equal id; a repeated
    query is asked once for each number of components, with the vector that sorts first.
    """
    vectors = stage_table(vectors.filter("vec_id IS NOT NULL").withColumn("dim", F.size("v")), "vectors")
    queries = queries.filter("vec_id IS NOT NULL").groupBy("vec_id", F.size("v").alias("dim")).agg(F.min("v").alias("v"))
    queries = stage_table(queries, "queries")
    shards = max(1, -(-vectors.count() // per_shard))
    blocks = max(1, -(-queries.count() // QUERIES_PER_BLOCK))
    dealt = lambda df, n, c: df.withColumn(c, F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    columns = ["dim", "shard", "block", "is_query", "vec_id", "v", "floor"]
    # Every block of queries meets every shard: the stated queries against all rows, in blocks.
    rows = dealt(vectors, shards, "shard").withColumn("block", each(blocks)).withColumns({"is_query": F.lit(False), "floor": F.lit(None).cast("long")})

    def ask(floors: DataFrame | None, leaves: int | None) -> DataFrame:
        asked = dealt(queries, blocks, "block").withColumn("shard", each(shards)).withColumn("is_query", F.lit(True))
        if floors is None:
            asked = asked.withColumn("floor", F.lit(None).cast("long"))
        else:
            asked = asked.join(floors, "vec_id", "left")
        both = rows.select(*columns).unionByName(asked.select(*columns))
        return both.groupBy("dim", "shard", "block").applyInArrow(_answer(k, leaves), "query_id long, vec_id long, score long")

    # A shard sends k rows a query at most.
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    first = ranked(ask(None, 1))
    kth = first.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    return ranked(ask(stage_table(kth, "kth"), None)).select("query_id", "rank", "vec_id", "score")
