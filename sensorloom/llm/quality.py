"""Quality classifier: random-indexing word vectors, pooled, and a small network (operator 1).

Each token has a sparse ternary index vector that follows from its hash.  A word's vector is its index
vector plus those of the words beside it over the sample of labelled rows.  Words and word shapes are
pooled for each document, and a two-layer network with a temperature fitted on rows it did not learn from
gives probabilities.  The fit sees at most ``SAMPLE`` labelled rows; scoring covers every whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MEMORIES, crc_mod, forget_others, free_name, text_or_empty, written

MODULUS, HELD_OUT = 4, 2
#: Most labelled rows that the fit takes, by the order of a hash of their ids.
SAMPLE = 6_000
THRESHOLD = 0.7
BUCKETS, DIMENSIONS, NONZERO = 8_192, 64, 4
HIDDEN, EPOCHS, RATE, BATCH = 32, 60, 0.003, 128
MEMORY = 300_000
RUNS = [(re.compile(p), x) for p, x in (("[A-ZÀ-ÖØ-Þ]+", "X"), ("[a-zß-öø-ÿ]+", "x"), ("[0-9]+", "9"), (r"\s+", " "))]


def shape(token: str) -> str:
    """Runs of capitals, small letters and digits as one sign each; other characters stay, repeated ones once."""
    if token.isalpha():  # most tokens
        if token.islower():
            return "x"
        if token.isupper():
            return "X"
        if token[1:].islower():
            return "Xx"
    for pattern, sign in RUNS:
        token = pattern.sub(sign, token)
    return re.sub(r"(.)\1+", r"\1", token)[:12]


class Buckets(dict):
    """Word bucket times BUCKETS plus shape bucket of a token; a bounded number is remembered."""

    def __missing__(self, token: str) -> int:
        if len(self) > MEMORY:
            self.clear()
        word = crc32(token.lower().encode("utf-8", "replace")) % BUCKETS
        self[token] = found = word * BUCKETS + crc32(b"\0" + shape(token).encode("utf-8", "replace")) % BUCKETS
        return found


PLACES = Buckets()
MEMORIES["quality"] = PLACES.clear


@cache
def index_vectors() -> np.ndarray:
    """Sparse ternary vectors, NONZERO parts of each plus or minus one."""
    rng = np.random.default_rng(11)
    out = np.zeros((BUCKETS, DIMENSIONS), np.float32)
    for row in out:
        row[rng.choice(DIMENSIONS, NONZERO, replace=False)] = rng.choice([-1, 1], NONZERO)
    return out


def contexts(texts: Iterator[str]) -> np.ndarray:
    """Sums of the index vectors of the words before and after each word."""
    index = index_vectors()
    place = np.nonzero(index)[1].reshape(BUCKETS, NONZERO)
    sign = np.take_along_axis(index, place, axis=1)
    total = np.zeros(BUCKETS * DIMENSIONS)
    for text in texts:
        ids = np.array([PLACES[t] for t in text.split()], np.int64) // BUCKETS
        for a, b in ((ids[:-1], ids[1:]), (ids[1:], ids[:-1])):
            np.add.at(total, (a[:, None] * DIMENSIONS + place[b]).ravel(), sign[b].ravel())
    return total.reshape(BUCKETS, DIMENSIONS)


def word_vectors(total: np.ndarray) -> np.ndarray:
    """Index vectors plus contexts, both of length one."""
    index = index_vectors() / np.sqrt(NONZERO)
    return (index + total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1)).astype(np.float32)


def pooled(text: str, vectors: np.ndarray) -> np.ndarray:
    """Means of the vectors of words and of shapes, their lengths, and how many tokens there are and how varied."""
    out = np.zeros(2 * DIMENSIONS + 5, np.float32)
    counts = Counter(text.split())
    n = sum(counts.values())
    if n:
        words, shapes = np.divmod(np.fromiter(map(PLACES.__getitem__, counts), np.int64, len(counts)), BUCKETS)
        w = np.fromiter(counts.values(), np.float32, len(counts)) / n
        out[:DIMENSIONS] = w @ vectors[words]
        shapes = np.bincount(shapes, w)
        at = np.flatnonzero(shapes)
        out[DIMENSIONS : 2 * DIMENSIONS] = shapes[at].astype(np.float32) @ vectors[at]
        out[-5] = np.log1p(n) / 5
        out[-4] = len(counts) / n
        out[-3], out[-2] = np.linalg.norm(out[:DIMENSIONS]), np.linalg.norm(out[DIMENSIONS : 2 * DIMENSIONS])
        out[-1] = float(w.max())
    return out


class Network:
    """Two layers: tanh, then one logit; divided by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = x.mean(axis=0), x.std(axis=0) + 1e-3
        self.p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        self.temperature = 1.0
        order = rng.permutation(len(x))
        held, rest = order[: len(x) // 5], order[len(x) // 5 :]
        m, v, step = [np.zeros_like(a) for a in self.p], [np.zeros_like(a) for a in self.p], 0
        for _ in range(EPOCHS):
            rng.shuffle(rest)
            for k in range(0, len(rest), BATCH):
                step += 1
                for a, g, mi, vi in zip(self.p, self.gradient(x[rest[k : k + BATCH]], y[rest[k : k + BATCH]]), m, v, strict=True):
                    mi += 0.1 * (g - mi)
                    vi += 0.001 * (g * g - vi)
                    a -= RATE * (mi / (1 - 0.9**step)) / (np.sqrt(vi / (1 - 0.999**step)) + 1e-8)
        if len(held):  # the temperature of least loss on rows not learnt from
            z = self.logits(x[held])
            self.temperature = min(np.geomspace(0.25, 8, 61), key=lambda t: float(np.mean(np.logaddexp(0, z / t) - y[held] * z / t)))

    def gradient(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        a, b, c, d = self.p
        x = (x - self.mean) / self.spread
        h = np.tanh(x @ a + b)
        e = (1 / (1 + np.exp(-np.clip(h @ c + d, -60, 60))) - y) / len(y)
        back = np.outer(e, c) * (1 - h * h)
        return [x.T @ back + 1e-4 * a, back.sum(axis=0), h.T @ e + 1e-4 * c, np.array([e.sum()])]

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.p
        return np.tanh((x - self.mean) / self.spread @ a + b) @ c + d

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", modulus: int = MODULUS, held_out: int = HELD_OUT, sample: int = SAMPLE) -> tuple[np.ndarray, Network | float]:
    """Word vectors and network from at most ``sample`` rows of ``labels`` (doc_id, label 0 or 1) outside the held-out remainder.

    Null labels and ids are left out; of labels with one id the largest counts, of documents with one id that whose text
    has the smallest digest.  With no rows, or rows of one
    label, the constant share of label 1 (0.5 without rows) takes the network's place.
    """
    spark = docs.sparkSession
    usable = labels.select(F.col(doc_id).cast("long").alias("who"), F.col(label).cast("double").alias("y")).filter(F.col("y").isNotNull() & F.col("who").isNotNull() & (crc_mod("who", modulus) != held_out))
    chosen = usable.groupBy("who").agg(F.max("y").alias("y")).orderBy(F.xxhash64("who"), "who").limit(sample)
    rows = spark.createDataFrame(chosen.toArrow()) if sample else usable.limit(0)  # at most ``sample`` narrow rows
    whole = docs.select(F.col(f"`{doc_id}`").cast("long").alias("who"), text_or_empty(f"`{text}`").alias("text"))
    # the documents are read by as many tasks as they have parts; the sample, a table by then, in 8
    one = F.min_by(F.struct("text", "y"), F.sha2(F.encode("text", "UTF-8"), 256)).alias("row")  # combined by task, so a repeated id is not shuffled whole
    found = written(whole.join(F.broadcast(rows), "who").groupBy("who").agg(one).select("row.*"), "labelled").coalesce(8)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BUCKETS, DIMENSIONS))
        for batch in batches:
            total += contexts(t.as_py() for t in batch.column(0))
        yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["total"])

    parts = found.select("text").mapInArrow(summed, "total binary").toArrow().column(0)  # 2 MB from each of at most 8 tasks
    vectors = word_vectors(sum((np.frombuffer(p.as_py(), np.float32).reshape(BUCKETS, DIMENSIONS) for p in parts), np.zeros((BUCKETS, DIMENSIONS))))
    shared = spark.sparkContext.broadcast(vectors)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [pooled(t.as_py(), shared.value) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float32())), batch.column(1)], names=["x", "y"])

    got = found.mapInArrow(features, "x array<float>, y double").toArrow()
    y = got.column(1).to_numpy()
    if not len(y) or y.min() == y.max():
        return vectors, float(y.mean()) if len(y) else 0.5
    x = np.array(got.column(0).to_pylist(), np.float32).astype(float)
    order = np.lexsort((*x.T[:8], y))  # the same rows in the same order, however they were dealt out
    return vectors, Network(x[order], y[order])


def scores(docs: DataFrame, model: tuple[np.ndarray, Network | float], text: str = "text", column: str = "score") -> DataFrame:
    """``docs`` with a column of scores (0 to 1, higher: label 1 likelier) named ``column``; all its own columns are kept.

    Only the whole text counts.  Null and empty texts are scored as texts without tokens.  ValueError where ``docs`` has
    such a column; ``common.free_name`` finds one that is free.
    """
    if free_name(docs, column) != column:
        raise ValueError(f"the table has a column {column}")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forget_others("quality")
        vectors, network = shared.value
        for part in texts:
            if isinstance(network, float):
                yield pd.Series([network] * len(part), dtype=float)
                continue
            x = np.array([pooled(t, vectors) for t in part], np.float32).reshape(len(part), -1)
            yield pd.Series(network.score(x.astype(float)))

    return docs.withColumn(column, scored(text_or_empty(f"`{text}`")))


def quality(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs``; repeated rows each have theirs."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    model = fit(rows, labels, **options)
    held = (crc_mod("doc_id", options.get("modulus", MODULUS)) == options.get("held_out", HELD_OUT)).alias("held_out")
    return scores(rows, model).select("doc_id", held, "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
