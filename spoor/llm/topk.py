"""Exact top-k inner products by aggregation without random access.

Rows are dealt into blocks, queries into batches. In a block each dimension is a list sorted by value, read from its top
for queries with a positive weight there and from its bottom for the others. Lists are read in parallel, a part at a time.
What has been read of a row counts as it is; what has not lies between the place reached in the list and the list's end.
That gives each row a lower and an upper bound of its score, for all queries of the batch in four matrix products.
A query stops when the rows whose upper bound reaches its k-th best lower bound are few; only their scores are resolved.
The best k of all blocks are merged by Spark.

Every (block, batch) pair is a task of bounded size: rows are repeated once per batch of queries, queries once per block.

Defined results: rows whose vector is null or holds a null or non-finite component take no part, neither as queries; a
shorter vector counts as filled up with zeros; repeated rows are candidates each for itself, but no row with the query's
own id is; of several vectors of one query id the least is asked; fewer than k candidates are all returned; an empty table
gives an empty table. Ties go to the smaller id. Scores are exact as long as they fit into 63 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS, BATCH_QUERIES = 8192, 1024
DEPTHS = (0.5, 0.75, 0.9)
FEW = 64                  # candidates of a query that are resolved without reading on


def quantized(vector: str = "embedding", scale: float = 256.0) -> Column:
    """floor(scale * x) of every component; null for vectors that take no part."""
    x = F.col(vector)
    usable = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(x.isNotNull() & usable, F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long")))


def _matrix(column, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    if (size == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(size), width), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _width(column) -> int:
    return int(np.diff(column.combine_chunks().offsets.to_numpy()).max(initial=0))


def candidates(q: np.ndarray, v: np.ndarray, own: np.ndarray, k: int) -> list[np.ndarray]:
    """For every query the rows that can be among its best k; own (query, row) marks rows that may not."""
    n = len(v)
    if n <= max(FEW, k) or np.abs(q).max(initial=0).astype(float) * np.abs(v).max(initial=0) * max(1, v.shape[1]) >= 2.0**53:
        return [np.flatnonzero(~o) for o in own]
    up, down = np.maximum(q, 0).astype(float), np.minimum(q, 0).astype(float)
    values = v.astype(float)
    order = np.argsort(-v, axis=0, kind="stable")                       # the sorted lists, one a dimension
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(n)[:, None], axis=0)
    top, bottom = values.max(axis=0), values.min(axis=0)
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(q)
    waiting = np.arange(len(q))
    for depth in DEPTHS:
        m = max(1, int(n * depth))
        high = values[order[m - 1], np.arange(v.shape[1])]              # reached from the top
        low = values[order[n - m], np.arange(v.shape[1])]               # reached from the bottom
        from_top, from_bottom = place < m, place >= n - m
        a, b = up[waiting], down[waiting]
        most = a @ np.where(from_top, values, high).T + b @ np.where(from_bottom, values, low).T
        least = a @ np.where(from_top, values, bottom).T + b @ np.where(from_bottom, values, top).T
        least[own[waiting]] = -np.inf
        bar = np.partition(least, n - k, axis=1)[:, n - k]
        can = (most >= bar[:, None]) & ~own[waiting]
        done = (can.sum(axis=1) <= FEW) | (depth == DEPTHS[-1])
        for i in np.flatnonzero(done):
            out[waiting[i]] = np.flatnonzero(can[i])
        waiting = waiting[~done]
        if not len(waiting):
            break
    return out


def _best(k: int):
    def best(rows: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[list] = [[], [], []]
        if rows.num_rows and queries.num_rows:
            width = max(_width(rows.column("v")), _width(queries.column("v")))
            v, q = _matrix(rows.column("v"), width), _matrix(queries.column("v"), width)
            ids, asked = rows.column("vec_id").to_numpy(), queries.column("vec_id").to_numpy()
            for i, some in enumerate(candidates(q, v, asked[:, None] == ids[None, :], k)):
                score = v[some] @ q[i]                                  # resolved
                first = np.lexsort((ids[some], -score))[:k]
                found[0].append(np.full(len(first), asked[i]))
                found[1].append(ids[some][first])
                found[2].append(score[first])
        return pa.table({n: pa.array(np.concatenate(x) if x else [], pa.int64()) for n, x in zip(("query_id", "vec_id", "score"), found)})
    return best


def top_k(queries: DataFrame, rows: DataFrame, k: int = 5) -> DataFrame:
    """queries and rows (vec_id, v array of long) -> query_id, rank from 1, vec_id, score."""
    rows = rows.filter("v IS NOT NULL AND vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), "v")
    queries = queries.filter("v IS NOT NULL AND vec_id IS NOT NULL").groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min("v").alias("v"))
    blocks, batches = max(1, -(-rows.count() // BLOCK_ROWS)), max(1, -(-queries.count() // BATCH_QUERIES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int")).withColumn("batch", every(batches))
    queries = queries.withColumn("batch", F.pmod(F.xxhash64("vec_id"), F.lit(batches)).cast("int")).withColumn("block", every(blocks))
    found = rows.groupBy("block", "batch").cogroup(queries.groupBy("block", "batch")).applyInArrow(
        _best(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def embedding_search(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """The best k rows for each row whose id is divisible by `every`."""
    rows = vectors.select("vec_id", quantized().alias("v"))
    return top_k(rows.filter(F.col("vec_id") % every == 0), rows, k)
