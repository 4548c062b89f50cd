"""Exact nearest neighbours by a block matrix join with int8 tiles."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newslab.llm.vectors import matrix, usable
from newslab.session import settle

#: Rows of a task's query block and candidate block, and of one product tile.
QUERY_BLOCK, CANDIDATE_BLOCK, TILE = 1024, 8192, 2048


class Quantised:
    """Rows as int8 times a scale each, with the norms that bound what is lost.

    The integers are held as float32 so that a product tile runs as one matrix product; products of
    int8 rows of up to 1,000 components stay below 2**24 and are exact there.
    """

    def __init__(self, rows: np.ndarray):
        self.scale = np.maximum(np.abs(rows).max(axis=1), 1e-300) / 127
        whole = np.rint(rows / self.scale[:, None])
        self.ints = whole.astype(np.float32)
        near = whole * self.scale[:, None]
        self.norm = np.linalg.norm(rows, axis=1)
        self.near_norm = np.linalg.norm(near, axis=1)
        self.lost = np.linalg.norm(rows - near, axis=1)

    def tile(self, other: Quantised, at: slice) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products and how far each may be off: ``|x||e| + |d||y'|`` and rounding."""
        rough = (self.ints.astype(np.float64) @ other.ints[at].T.astype(np.float64)
                 if self.ints.shape[1] > 1000 else self.ints @ other.ints[at].T)
        guess = rough * self.scale[:, None] * other.scale[None, at]
        off = self.norm[:, None] * (other.lost[None, at] + 1e-9 * other.norm[None, at])
        return guess, off + self.lost[:, None] * other.near_norm[None, at]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row inner products in double precision, summed in the order of the components."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def block_nearest(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray,
                  k: int) -> list[list[tuple[float, int]]]:
    """For each query a heap of its k best ``(score, -id)`` among rows with another id."""
    heaps: list[list[tuple[float, int]]] = [[] for _ in query_ids]
    left, right = Quantised(queries), Quantised(rows)
    floor = np.full(len(queries), -np.inf)
    for start in range(0, len(rows), TILE):
        at = slice(start, min(len(rows), start + TILE))
        guess, off = left.tile(right, at)
        guess[query_ids[:, None] == ids[None, at]] = -np.inf
        low = guess - off
        if low.shape[1] > k:
            floor = np.maximum(floor, np.partition(low, -k, axis=1)[:, -k])
        q, c = np.nonzero((guess + off >= floor[:, None]) & (guess > -np.inf))
        score = products(queries[q], rows[start + c])
        for i, s, name in zip(q.tolist(), score.tolist(), ids[start + c].tolist(), strict=True):
            item = (s, -name)
            if len(heaps[i]) < k:
                heapq.heappush(heaps[i], item)
            elif item > heaps[i][0]:
                heapq.heapreplace(heaps[i], item)
        floor = np.maximum(floor, [h[0][0] if len(h) == k else -np.inf for h in heaps])
    return heaps


def nearest(vectors: DataFrame, is_query: str, k: int = 20, key: str = "vec_id",
            vector: str = "embedding") -> DataFrame:
    """Rows ``(query_id, rank, vec_id, score)``: the k largest inner products of each query row.

    ``is_query`` is a condition on ``id``. Queries and rows are dealt to blocks by a hash of their id,
    and each pair of blocks meets in one task: products of int8 tiles bound each inner product, pairs
    that can't be among a query's k best by their bound are let go, the others are worked out in double
    precision and kept in a heap per query; the heaps' rows are merged by rank. All rows are compared
    (there is no index to miss any): the work is queries times rows, the traffic rows times query blocks.

    Vectors null, empty, zero, or with null or non-finite components take no part; only vectors of
    equal length are compared. A key that repeats counts once, with its smallest vector. Equal scores:
    smaller vec_id first. Fewer than k other rows: all of them. Other columns are ignored. An empty
    table or no query gives no rows.
    """
    rows = settle(usable(vectors, key, vector).withColumn("dim", F.size("v"))
                  .withColumn("asks", F.expr(is_query)), "vectors")
    n, asks = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("asks").cast("long")), F.lit(0))).first()
    query_blocks, blocks = max(1, math.ceil(asks / QUERY_BLOCK)), max(1, math.ceil(n / CANDIDATE_BLOCK))
    to = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    dealt = lambda count: F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")
    grid = (rows.select("dim", dealt(blocks).alias("block"), to(query_blocks).alias("queries"),
                        "id", "v", F.lit(False).alias("asks"))
            .union(rows.where("asks").select("dim", to(blocks), dealt(query_blocks), "id", "v", F.lit(True))))

    def tile(table: pa.Table) -> pa.Table:
        asks = table["asks"].to_numpy().astype(bool)
        ids, v = table["id"].to_numpy(), matrix(table["v"])
        heaps = block_nearest(ids[asks], v[asks], ids[~asks], v[~asks], k)
        found = [(q, -name, s) for q, heap in zip(ids[asks].tolist(), heaps, strict=True) for s, name in heap]
        columns = list(zip(*found, strict=True)) or [[], [], []]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()),
                         "score": pa.array(columns[2], pa.float64())})

    best = grid.groupBy("dim", "block", "queries").applyInArrow(tile, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
