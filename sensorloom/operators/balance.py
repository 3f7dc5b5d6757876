"""Class balancing: undersampling with and without replacement, nearest neighbours and SMOTE."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .splits import first_rows, numbered, shuffled

#: Rows of a block that the search for neighbours compares at once.
BLOCK = 1_024
#: Pairs whose distances are computed at once.
SOME = 8_192


def undersample(rows: DataFrame, keys: list[str], key: str, seed: int, y: str = "y") -> DataFrame:
    """As many rows of each class as the rarer one has, chosen by an MD5 order."""
    n = rows.groupBy(*keys).agg(F.least(F.sum(F.col(y).cast("long")), F.sum(1 - F.col(y).cast("long"))).alias("least"))
    both = rows.join(n, keys) if keys else rows.crossJoin(F.broadcast(n))  # one row
    return first_rows(both, [*keys, y], [shuffled(seed, key), F.col(key)], F.col("least"), [key]).drop("place", "least")


def stratified_subset(rows: DataFrame, key: str, n: int, seed: int, y: str = "y") -> DataFrame:
    """``n`` rows, half of them positive where there are so many; fewer where a class runs out."""
    most = F.when(F.col(y) == 1, n // 2).otherwise(n - n // 2)
    return first_rows(rows, [y], [shuffled(seed, key), F.col(key)], most, [key]).drop("place")


def undersample_with_replacement(rows: DataFrame, key: str, seed: int, y: str = "y") -> DataFrame:
    """Every positive row, and as many draws from the negative ones, each row as often as it is drawn."""
    negative = numbered(rows.filter(F.col(y) == 0), key, "slot")
    n = rows.agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg")).first()
    pick = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("draw").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    draws = rows.sparkSession.range(1, n.pos + 1 if n.neg else 1).withColumnRenamed("id", "draw").withColumn("slot", F.pmod(pick, F.lit(max(n.neg, 1))))
    return rows.filter(F.col(y) == 1).withColumn("draw", F.lit(0).cast("long")).unionByName(draws.join(negative, "slot").drop("slot"))


def packed(rows: DataFrame) -> DataFrame:
    """Blocks (g, dim, ids, block, place) of at most ``BLOCK`` rows of (g, id, vector) with one group and length; ``place`` counts them."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[tuple[str, int], list] = {}
        place = TaskContext.get().partitionId()

        def block(key: tuple[str, int], part: list) -> pa.RecordBatch:
            nonlocal place
            place += 1
            ids, values = np.array([i for i, _ in part], np.int64), np.concatenate([v for _, v in part])
            return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary()), pa.array([place], pa.int64())], names=["g", "dim", "ids", "block", "place"])

        for batch in batches:
            for g, who, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                values = vector.values if vector.is_valid else None
                if g is None or who is None or values is None or values.null_count or not len(values):
                    continue
                v = values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(v).all():
                    continue
                part = waiting.setdefault((g, len(v)), [])
                part.append((who, v))
                if len(part) == BLOCK:
                    yield block((g, len(v)), waiting.pop((g, len(v))))
        for key, part in waiting.items():
            yield block(key, part)

    return rows.mapInArrow(blocks, "g string, dim int, ids binary, block binary, place long")


def nine_places(x: np.ndarray) -> np.ndarray:
    """Rounded half up by their shortest decimals, as Spark rounds."""
    each, at = np.unique(x, return_inverse=True)
    return np.array([float(Decimal(repr(float(v))).quantize(Decimal("1e-9"), ROUND_HALF_UP, Context(prec=400))) for v in each])[at]


def places_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The (row, column) places where ``a`` and ``b`` are the same; ids may repeat."""
    if not np.isin(a, b).any():
        return np.empty(0, int), np.empty(0, int)
    return np.nonzero(a[:, None] == b[None, :])


def nearest(q: np.ndarray, c: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, most: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, distance) of the k nearest ``c`` of each ``q``: a matrix product rules out what is surely farther, the rest is computed.

    ``own`` are the (row, column) places of rows that are no candidates of each other.  ``most``: for each q a distance
    beyond which no c is wanted (infinity of none).
    """
    no = np.empty(0, int), np.empty(0, np.int64), np.empty(0)
    if most is None:
        most = np.full(len(q), np.inf)
    qq, cc = (q * q).sum(axis=1), (c * c).sum(axis=1)
    about = q @ c.T
    about *= -2
    about += qq[:, None]
    about += cc
    # what the product may be wrong by
    off = (np.sqrt(qq) + np.sqrt(cc.max(initial=0))) ** 2 * (q.shape[1] + 8) * 1e-15
    about[own] = np.inf
    first = np.flatnonzero(~np.isfinite(most))
    if len(first) and c.shape[0] > k:
        high = np.partition(about[first], k - 1, axis=1)[:, k - 1] + off[first]
        most = most.copy()
        most[first] = np.sqrt(np.maximum(high, 0))
    close = ~(about > ((most + 2e-9) ** 2 + off)[:, None])  # not numbers (overflow) stay
    close[own] = False
    row, at = np.nonzero(close)
    if not len(row):
        return no
    dist = np.empty(len(row))
    for a in range(0, len(row), SOME):
        z = slice(a, a + SOME)
        dist[z] = np.sqrt(np.cumsum((q[row[z]] - c[at[z]]) ** 2, axis=1)[:, -1])
    near = ~(dist > most[row] + 4e-9)  # by the distance itself, before the slow rounding
    row, at, dist = row[near], at[near], dist[near]
    if not len(row):
        return no
    dist = nine_places(dist)
    order = np.lexsort((ids[at], dist, row))
    row, at, dist = row[order], at[order], dist[order]
    stays = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[stays], ids[at[stays]], dist[stays]


def neighbours(rows: DataFrame, k: int, key: str = "vec_id", vector: str = "v", group: str | None = None) -> DataFrame:
    """(key, other, dist, rank): the k nearest other rows by Euclid's distance, within a group where one is named; ties to the smaller key.

    Blocks of rows meet the blocks of their group, dealt over parts, so a group with most of the rows is shared
    by many tasks, and only the best k of a row leave a part.  Rows without a key or group, and vectors that are
    null, empty or have null or non-finite parts, take no part; vectors of other lengths are not compared.
    """
    spark = rows.sparkSession
    r = rows.select((F.col(group).cast("string") if group else F.lit("")).alias("g"), F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    most = r.groupBy("g").count().agg(F.max("count")).first()[0] or 0
    parts = max(1, min(-(-most // BLOCK), 4 * spark.sparkContext.defaultParallelism))
    left = packed(r).select("g", "dim", F.col("ids").alias("q_ids"), F.col("block").alias("q_block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    right = packed(r).withColumn("part", F.pmod("place", F.lit(parts)).cast("int")).drop("place")

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, q_ids, best = None, np.empty(0, np.int64), (np.empty(0, int), np.empty(0, np.int64), np.empty(0))

        def rows_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(q_ids[best[0]]), pa.array(best[1], pa.int64()), pa.array(best[2], pa.float64())], names=["id", "other", "dist"])

        for batch in batches:
            for g, dim, ids_of_q, q_block, ids, block in zip(*(batch.column(i) for i in range(6)), strict=True):
                g, dim, ids_of_q, q_block = g.as_py(), dim.as_py(), ids_of_q.as_py(), q_block.as_py()
                if (g, dim, ids_of_q, q_block) != last:  # pairs of one block follow each other in a merge join; in any order lists are merged below
                    if len(best[0]):
                        yield rows_of()
                    last, q_ids, best = (g, dim, ids_of_q, q_block), np.frombuffer(ids_of_q, np.int64), (np.empty(0, int), np.empty(0, np.int64), np.empty(0))
                ids = np.frombuffer(ids.as_py(), np.int64)
                most = np.full(len(q_ids), np.inf)  # the worst of k found so far
                full = np.flatnonzero(np.bincount(best[0], minlength=len(q_ids)) >= k)
                most[full] = best[2][np.searchsorted(best[0], full) + k - 1]
                new = nearest(np.frombuffer(q_block).reshape(-1, dim), np.frombuffer(block.as_buffer()).reshape(-1, dim), places_of(q_ids, ids), ids, k, most)
                row, other, dist = (np.concatenate(x) for x in zip(best, new, strict=True))
                order = np.lexsort((other, dist, row))
                row, other, dist = row[order], other[order], dist[order]
                stays = np.arange(len(row)) - np.searchsorted(row, row) < k
                best = row[stays], other[stays], dist[stays]
        if len(best[0]):
            yield rows_of()

    pairs = left.join(right, ["g", "dim", "part"]).select("g", "dim", "q_ids", "q_block", "ids", "block")
    near = pairs.mapInArrow(lists, "id long, other long, dist double").withColumnRenamed("id", key)
    w = Window.partitionBy(key).orderBy("dist", "other")
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def smote(rows: DataFrame, k: int, seed: int, key: str = "vec_id", vector: str = "v", group: str | None = None) -> DataFrame:
    """(key, other, lam, v): for each row a point on the way to one of its k neighbours."""
    pick = F.conv(F.substring(shuffled(seed, key), 1, 8), 16, 10).cast("long")
    lam = F.conv(F.substring(shuffled(seed + 1, key), 1, 8), 16, 10).cast("double") / 4294967296.0
    near = neighbours(rows, k, key, vector, group)
    chosen = near.withColumn("n", F.count("*").over(Window.partitionBy(key))).filter(F.col("rank") == F.pmod(pick, F.col("n")) + 1)
    a, b = rows.select(key, F.col(vector).alias("va")), rows.select(F.col(key).alias("other"), F.col(vector).alias("vb"))
    out = chosen.select(key, "other").join(a, key).join(b, "other").withColumn("lam", lam)
    return out.select(key, "other", "lam", F.expr("zip_with(va, vb, (x, y) -> x + lam * (y - x))").alias("v"))
