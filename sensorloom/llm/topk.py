"""Exact top-k search by tiled matrix products (operator 10).

Vectors are packed into query blocks and candidate tiles of a fixed number of rows.  Each tile is
multiplied with each query block; only the best k of each query leave the product.  The tiles that one query block
meets in a task follow each other, so a task holds the lists of one block at a time, and merges them before they are
shuffled; the lists of all tasks are merged in two levels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

QUERY_ROWS = 512
TILE_ROWS = 4096
TOP = "query_id long, vec_id long, score long, place binary, part int"
#: Doubles hold every integer up to here.
EXACT = 2.0**53


def packed(vectors: DataFrame, rows: int, scale: float) -> DataFrame:
    """Blocks (dim, ids, block) of at most ``rows`` vectors scaled and floored; vectors with null or non-finite parts are left out."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}

        def block(dim: int, part: list) -> pa.RecordBatch:
            ids, values = np.array([i for i, _ in part], np.int64), np.concatenate([v for _, v in part])
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary())], names=["dim", "ids", "block"])

        for batch in batches:
            for who, vector in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = vector.values if vector.is_valid else None
                if who is None or values is None or values.null_count or not len(values):
                    continue
                v = values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(v).all():
                    continue
                waiting.setdefault(len(v), []).append((who, np.floor(v * scale)))
                if len(waiting[len(v)]) == rows:
                    yield block(len(v), waiting.pop(len(v)))
        for dim, part in waiting.items():
            yield block(dim, part)

    return vectors.mapInArrow(blocks, "dim int, ids binary, block binary")


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best of each row, ties to the smaller id, best first."""
    n = scores.shape[1]
    if n > k:
        least = np.partition(scores, n - k, axis=1)[:, n - k]
        row, column = np.nonzero(scores >= least[:, None])  # ties with the k-th, too
    else:
        row, column = np.divmod(np.arange(scores.size), n)
    order = np.lexsort((ids[column], -scores[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): of each query row its k best other rows by the inner product of floor(scale * x).

    is_query: a condition on ``vectors``.  Scores are whole numbers and exact; ties go to the smaller
    vec_id; fewer than k rows give fewer.  Ranks are by whole numbers of any size; a score beyond 64 bits is shown as the
    nearest that a long holds.  Null vectors, vectors with null or non-finite parts and rows
    without an id take no part; vectors of other lengths are not compared.  A row repeated with its id is
    a candidate each time, yet never for its own id.  Other columns are left out.  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").alias("embedding"), is_query.alias("is_query"))
    tiles = written(packed(rows.drop("is_query"), TILE_ROWS, scale).withColumn("tile", F.monotonically_increasing_id()), "tiles")
    queries = written(packed(rows.filter("is_query").drop("is_query"), QUERY_ROWS, scale), "queries")
    # every query block goes once to each of a number of parts that the tiles are dealt over: the stated
    # queries meet all rows in blocks, and nothing but blocks is repeated
    parts = max(1, min(tiles.count(), 4 * spark.sparkContext.defaultParallelism))
    left = queries.select("dim", F.col("ids").alias("q_ids"), F.col("block").alias("q_block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    right = tiles.withColumn("part", F.pmod(F.xxhash64("tile"), F.lit(parts)).cast("int"))

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId() % 64, None
        q_ids, row, found, scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

        def lists_of_block() -> pa.RecordBatch:
            whole = [int(x) for x in scores]
            clipped = [max(-(2**63), min(2**63 - 1, x)) for x in whole]
            return pa.RecordBatch.from_arrays([pa.array(q_ids[row]), pa.array(found), pa.array(clipped, pa.int64()), pa.array([sortable(x) for x in whole], pa.binary()), pa.array([part] * len(row), pa.int32())], names=["query_id", "vec_id", "score", "place", "part"])

        for batch in batches:
            for dim, of_q, q_block, ids, block in zip(*(batch.column(i) for i in range(5)), strict=True):
                dim, of_q, q_block, ids = dim.as_py(), of_q.as_py(), q_block.as_py(), np.frombuffer(ids.as_py(), np.int64)
                if (dim, of_q, q_block) != last:
                    if len(row):
                        yield lists_of_block()
                    last, q_ids = (dim, of_q, q_block), np.frombuffer(of_q, np.int64)
                    row, found, scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
                new = scores_of(np.frombuffer(q_block).reshape(-1, dim), np.frombuffer(block.as_py()).reshape(-1, dim))
                own = q_ids[:, None] == ids[None, :]
                new[own] = -np.inf
                r, c = best(new, ids, k) if new.dtype != object else best_of_objects(new, ids, k)
                good = ~own[r, c]
                r, c = r[good], c[good]
                row, found, scores = np.concatenate([row, r]), np.concatenate([found, ids[c]]), np.concatenate([scores, new[r, c]])
                order = np.lexsort((found, -scores, row)) if scores.dtype != object else np.array(sorted(range(len(row)), key=lambda i: (row[i], -scores[i], found[i])), np.int64)
                order = order[np.arange(len(order)) - np.searchsorted(row[order], row[order]) < k]
                row, found, scores = row[order], found[order], scores[order]
        if len(row):
            yield lists_of_block()

    lists = left.join(right, ["part", "dim"]).select("dim", "q_ids", "q_block", "ids", "block").mapInArrow(product, TOP)
    for keys in (["query_id", "part"], ["query_id"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("place"), "vec_id"))
        lists = lists.withColumn("rank", rank).filter(F.col("rank") <= k)
    return lists.select("query_id", "rank", "vec_id", "score")


def scores_of(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products: as doubles where these hold every sum on the way, else as whole numbers of any size."""
    if np.abs(q).max() * np.abs(c).max() * q.shape[1] < EXACT:
        return q @ c.T
    return np.array([[int(x) for x in v] for v in q], object) @ np.array([[int(x) for x in v] for v in c], object).T


def sortable(x: int) -> bytes:
    """Bytes that compare as the whole numbers do, of any size."""
    body = abs(x).to_bytes((abs(x).bit_length() + 7) // 8, "big")
    up = len(body).to_bytes(2, "big") + body
    return b"\1" + up if x >= 0 else b"\0" + bytes(255 - b for b in up)


def best_of_objects(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    pairs = [(r, c) for r in range(len(scores)) for c in sorted(range(len(ids)), key=lambda c: (-scores[r, c], ids[c]))[:k]]
    return np.array([r for r, _ in pairs], int), np.array([c for _, c in pairs], int)
