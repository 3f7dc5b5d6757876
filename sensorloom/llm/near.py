"""Near-duplicate detection by improved consistent weighted sampling (operator 5).

Texts are weighted sets of five-word shingles: term frequency times an inverse document frequency
scaled to 0.5..1, so that a group of copies as large as the corpus still compares by its shingles.
Document frequencies come from all documents through a sketch of a fixed number of cells, whose mean
noise is taken off; where distinct shingles far outnumber the cells, rare ones weigh as if they were somewhat
commoner, alike in every text, so similarities are still of one weighting and classes do not depend on partitions.  Each of the samples draws a (shingle, level) with probability in proportion to weight;
equal bands of samples make buckets.  A bucket's members are compared with its centre, the member whose shingles are
the most common ones (the text that a large class lies around), and connected components of the verified
links make classes.  Where a bucket still holds several classes, its members are compared through their
rarest shingles (a prefix filter, which loses no link), never all with all.  Rows of a hot text, class or centre are
not gathered: their class is broadcast (``common.looked_up``), their text copied to as many salts as its pairs need.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT, MEMORIES, flagged, forget_others, looked_up, text_or_empty, written

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 10, 4
CELL_BITS = 18
MEMORY = 250_000
U = np.uint64
MIX = U(0x9E3779B97F4A7C15)


class Hashes(dict):
    """64-bit hashes of words, a bounded number of them remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) > MEMORY:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))
        return h


HASHES = Hashes()
MEMORIES["near"] = HASHES.clear


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(31))) * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(29))


def shingles(text: str, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of lower-cased words, ascending, and their counts; a shorter text is one shingle."""
    words = text.lower().split()
    if not words:
        return np.empty(0, U), np.empty(0, np.int64)
    w = np.fromiter(map(HASHES.__getitem__, words), U, len(words))
    width = min(width, len(w))
    h = np.zeros(len(w) - width + 1, U)
    for i in range(width):
        h = (h + w[i : len(w) - width + 1 + i]) * MIX
        h ^= h >> U(32)
    return np.unique(mixed(h), return_counts=True)


@cache
def draws(samples: int) -> tuple[np.ndarray, ...]:
    """Tables of 65,536 draws: r and ln c of Gamma(2, 1), beta uniform; and a multiplier of each sample."""
    rng = np.random.default_rng(20240101)
    r = rng.gamma(2.0, 1.0, 65536).astype(np.float32)
    c = np.log(rng.gamma(2.0, 1.0, 65536)).astype(np.float32)
    beta = rng.random(65536, dtype=np.float32)
    odd = rng.integers(2**63, 2**64 - 1, samples, dtype=U) | U(1)
    return r, (1 / r).astype(np.float32), (c - r + r * beta).astype(np.float32), beta, odd


def signature(h: np.ndarray, weight: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band: hashes of its samples (shingle, level)."""
    k = bands * rows
    r, inverse, start, beta, odd = draws(k)
    least = np.full(k, np.inf, np.float32)
    drawn = np.zeros(k, U)
    for at in range(0, len(h), 2048):  # long texts in parts that fit in the cache
        part, lw = h[at : at + 2048], np.log(weight[at : at + 2048]).astype(np.float32)
        t = ((part[None, :] ^ (part[None, :] >> U(32))) * odd[:, None] >> U(48)).astype(np.int32)
        level = np.floor(lw[None, :] * inverse[t] + beta[t])
        key = start[t] - r[t] * level  # ln c - r (level - beta) - r
        best = key.argmin(axis=1)
        each = np.arange(k)
        value = key[each, best]
        better = value < least
        least[better] = value[better]
        drawn[better] = mixed(part[best] + level[each, best].astype(np.int64).view(U) * MIX)[better]
    out = np.zeros(bands, U)
    for i in range(rows):
        out = mixed((out + drawn.reshape(bands, rows)[:, i]) * MIX)
    return out


def weights(h: np.ndarray, count: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return count * scale[(h >> U(64 - CELL_BITS)).astype(np.int64)]


def similarity(a: tuple, b: tuple, scale: np.ndarray) -> float:
    """Weighted Jaccard similarity of two results of shingles()."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    s = scale[(both >> U(64 - CELL_BITS)).astype(np.int64)]
    least = float((np.minimum(a[1][i], b[1][j]) * s).sum())
    total = float(weights(*a, scale).sum() + weights(*b, scale).sum()) - least
    return least / total if total else 1.0


def scaled_idf(docs: DataFrame) -> np.ndarray:
    """For each cell of the sketch (1 + ln(N / df) / ln N) / 2, with df over all rows of ``docs`` (a text column)."""
    cells = 1 << CELL_BITS

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others("near")
        total, rows = np.zeros(cells, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            waiting, size = [], 0
            for text in batch.column(0):
                waiting.append((shingles(text.as_py())[0] >> U(64 - CELL_BITS)).astype(np.int64))
                size += len(waiting[-1])
                if size > 1_000_000:
                    total += np.bincount(np.concatenate(waiting), minlength=cells)
                    waiting, size = [], 0
            if waiting:
                total += np.bincount(np.concatenate(waiting), minlength=cells)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(total[at], rows))], names=["cell", "n"])

    sums = docs.mapInArrow(counted, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most one row for each cell
    cell, n = sums.column(0).to_numpy(), sums.column(1).to_numpy()
    documents = int(n[cell == -1].sum())
    df = np.zeros(cells)
    df[cell[cell >= 0]] = n[cell >= 0]
    df = np.maximum(df - (df.sum() - df) / (cells - 1), 1)  # less what other shingles add to a cell on average
    if documents < 2:
        return np.ones(cells)
    return np.clip((1 + np.log(documents / df) / np.log(documents)) / 2, 0.5, 1)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): connected components of undirected ``edges`` (a, b).

    In each round every node moves to its smallest neighbour and edges inside the moved nodes go, so that
    large classes shrink at once; the moves are then followed from the last round back.
    """
    moves, left = [], edges
    while True:
        near = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        move = written(near.groupBy("a").agg(F.least("a", F.min("b")).alias("to"), F.count("*").alias("n")).withColumnRenamed("a", "node"), "moves")
        moves.append(move.drop("n"))
        ends = 2 * left.count()
        moved = left.select("a", "b")
        for side in ("a", "b"):
            of = move.select(F.col("node").alias(side), F.col("to").alias(f"{side}_to"), "n")
            moved = looked_up(moved, of, side, "n", ends).drop("n")
        left = written(moved.filter("a_to != b_to").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(), "edges")
        if left.isEmpty():
            break
    labels = moves.pop().withColumnRenamed("to", "component")
    for move in reversed(moves):
        then = labels.select(F.col("node").alias("to"), "component").join(move.groupBy("to").agg(F.count("*").alias("n")), "to")
        labels = written(looked_up(move, then, "to", "n", move.count(), "left").select("node", F.coalesce("component", "to").alias("component")), "labels")
    return labels


#: Pairs that one copy of a text meets, at least, before the text is copied.
FEW = 256


def beside(rows: DataFrame, pairs: DataFrame, total: int, texts: DataFrame, side: str, other: str) -> DataFrame:
    """``rows`` (the ``total`` ``pairs``, and more columns) with the text of ``side`` in a column side_text.

    A text of very many pairs is copied, a copy for each share of them: fewer than 2 * HOT copies in all.
    """
    share = max(total / HOT, FEW)
    hot = F.broadcast(pairs.groupBy(side).agg(F.count("*").alias("n")).filter(F.col("n") > share).select(side, F.ceil(F.col("n") / share).cast("int").alias("salts")))
    salts = F.coalesce("salts", F.lit(1))
    dealt = rows.join(hot, side, "left").withColumn("salt", F.pmod(F.xxhash64(other), salts).cast("int")).drop("salts")
    copies = texts.select(F.col("node").alias(side), F.col("text").alias(f"{side}_text")).join(hot, side, "left")
    return dealt.join(copies.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts"), [side, "salt"]).drop("salt")


def verified(pairs: DataFrame, texts: DataFrame, scale, least: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose ``texts`` (node, text) have a weighted Jaccard similarity of ``least`` or more."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, None
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                y = y.as_py()
                if y != last:
                    last, known = y, shingles(y)
                good.append(similarity(shingles(x.as_py()), known, scale.value) >= least)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(good, pa.bool_())], names=["a", "b", "linked"])

    both, total = pairs, pairs.count()
    for side, other in (("a", "b"), ("b", "a")):
        both = beside(both, pairs, total, texts, side, other)
    return both.select("a", "b", "a_text", "b_text").mapInArrow(compared, "a long, b long, linked boolean")


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, class_id, class_size, kept, text_sha256): a row for each row of ``docs``.

    Classes are the connected components of pairs of similarity ``least`` or more; class_id is the smallest
    doc_id of the class (null ids count as the largest) and its row is the one kept; of rows repeated with
    the same id and text one is kept.  Equal texts are one class, and so are texts of equal words.  Null
    texts count as empty; empty texts are equal to each other; texts under five words are one shingle.
    Other columns are left out.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    sha = F.sha2(F.encode("text", "UTF-8"), 256)
    whole = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_or_empty(f"`{text}`").alias("text")).withColumn("sha", sha)
    scale = spark.sparkContext.broadcast(scaled_idf(whole.select("text")).astype(np.float64))  # a fixed number of cells

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, mean = [], []
            for t in batch.column(3):
                h, n = shingles(t.as_py())
                w = weights(h, n, scale.value)
                keys.append(signature(h, w, bands, rows).view(np.int64) if len(h) else None)
                mean.append(float(w.sum() / n.sum()) if len(h) else 1.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(mean, pa.float64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "sha", "row_id", "rare", "keys"])

    numbered = whole.select("doc_id", "sha", F.monotonically_increasing_id().alias("row_id"), "text")
    table = written(numbered.mapInArrow(signed, "doc_id long, sha string, row_id long, rare double, keys array<long>"), "near-rows")
    # one node for each distinct text, however many rows hold it
    nodes, total = written(table.groupBy("sha").agg(F.min("row_id").alias("node"), F.count("*").alias("n")), "near-nodes"), table.count()
    single = table.join(nodes, (table["sha"] == nodes["sha"]) & (table["row_id"] == nodes["node"])).select("node", "rare", F.posexplode_outer("keys").alias("band", "key"))
    places = single.filter("key is not null").select("node", F.xxhash64("band", "key").alias("bucket"), F.struct("rare", F.xxhash64("node").alias("tie"), "node").alias("order"))
    buckets = places.groupBy("bucket").agg(F.count("*").alias("size"), F.min("order")["node"].alias("centre")).filter("size > 1")
    members = written(looked_up(places.drop("order"), buckets, "bucket", "size", bands * nodes.count()), "near-members")
    stars = written(ordered(members.filter("node != centre").select(F.col("node").alias("a"), F.col("centre").alias("b"))), "near-stars")
    involved = written(members.select("node").distinct().join(table.select(F.col("row_id").alias("node"), "doc_id", "sha"), "node").withColumnRenamed("doc_id", "id"), "near-involved")
    # only the texts of bucket members are shuffled, by one plan at every size
    name = lambda who: F.concat_ws("/", "sha", F.coalesce(F.col(who).cast("string"), F.lit("")))
    named = involved.select(name("id").alias("name"), "node")
    maybe = flagged(whole.select(name("doc_id").alias("name"), "text"), F.col("name"), named.select("name"), "maybe").filter("maybe")
    texts = written(maybe.groupBy("name").agg(F.max("text").alias("text")).join(named, "name").select("node", "text"), "near-texts")
    tested = written(verified(stars, texts, scale, least), "near-tested")
    links = tested.filter("linked").select("a", "b")
    classes = components(links)
    # buckets of three or more that hold several classes: their members meet through rare shingles
    named = members.filter("size > 2").join(classes, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    mixed_buckets = named.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high").select("bucket")
    rest = written(named.join(mixed_buckets, "bucket"), "near-rest")
    if not rest.isEmpty():
        more = written(rarest(rest, texts, scale, least).join(tested, ["a", "b"], "left_anti"), "near-more")
        found = written(verified(more, texts, scale, least).filter("linked").select("a", "b"), "near-found")
        if not found.isEmpty():
            classes = components(links.unionByName(found))
    known = nodes.join(classes, "node", "left").select("sha", "n", F.coalesce("component", "node").alias("component"))
    member = written(looked_up(table.select("doc_id", "row_id", "sha"), known, "sha", "n", total).drop("n"), "near-result")
    last = F.coalesce("doc_id", F.lit(2**63 - 1))
    heads = member.groupBy("component").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"), F.min_by("row_id", last).alias("head"))
    return looked_up(member, heads, "component", "class_size", total).select("doc_id", "class_id", "class_size", (F.col("row_id") == F.col("head")).alias("kept"), F.col("sha").alias("text_sha256"))


def rarest(rest: DataFrame, texts: DataFrame, scale, least: float) -> DataFrame:
    """Pairs (a, b) of nodes of different components of ``rest`` (bucket, node, component) that may be similar enough.

    Shingles that one component alone holds are weight that two texts of a pair cannot share.  The others are
    ordered by how many nodes hold them, counted exactly, then by hash.  A text's first ones, as long as what goes
    before them and its unshared weight stay within (1 - least) of its weight, meet those of any text that is similar
    enough; a meeting counts only if what comes after it on both sides would still do.  The first common shingle of
    two similar texts always counts, so no pair is lost.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, component, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                h, n = shingles(text.as_py())
                w = weights(h, n, scale.value)
                k = len(h)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, node)), pa.array(np.full(k, component)), pa.array(h.view(np.int64)), pa.array(w), pa.array(np.full(k, w.sum()))], names=["node", "component", "shingle", "w", "total"])

    needed = rest.select("node", "component").distinct().join(texts, "node").select("node", "component", "text")
    every = written(needed.mapInArrow(listed, "node long, component long, shingle long, w double, total double"), "near-shingles")
    held = every.groupBy("shingle").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
    shared = every.join(held.filter("low != high").select("shingle", "n"), "shingle")
    node = Window.partitionBy("node")
    before = F.sum("w").over(node.orderBy("n", "shingle").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("w")
    lost = F.col("total") - F.sum("w").over(node) + before  # weight without a partner if this shingle is the first common one
    first = shared.withColumn("lost", lost).filter(F.col("lost") <= (1 - least) * F.col("total") + 1e-9)
    first = written(first.select("shingle", "node", "component", "total", (F.col("total") - F.col("lost")).alias("left")), "near-prefixes")
    a = first.select("shingle", F.col("node").alias("a"), F.col("component").alias("ac"), F.col("left").alias("al"), F.col("total").alias("at"))
    b = first.select("shingle", F.col("node").alias("b"), F.col("component").alias("bc"), F.col("left").alias("bl"), F.col("total").alias("bt"))
    enough = (1 + least) * F.least("al", "bl") >= least * (F.col("at") + F.col("bt")) - 1e-9
    return a.join(b, "shingle").filter(F.expr("a < b and ac != bc") & enough).select("a", "b").distinct()
