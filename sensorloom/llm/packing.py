"""Best-fit packing by minimum bin slack (operator 8).

Only longer documents are cut, so every piece has a length from 1 to the capacity and the whole
problem is a histogram of at most ``capacity`` rows, at any size of the input.  On it, for each bin
the largest length left is placed and a bitset subset-sum over the lengths still there finds the
fullest combination; that combination is removed as often as the histogram allows.  Each removal
uses up a length, so there are at most ``capacity`` of them for each and the plan has a bound that
does not depend on the data.  Pieces then find their place by their rank among equal lengths; full
pieces, of which long documents make most, are sequences of their own and need no rank and no shuffle.
"""

from __future__ import annotations

import os
import sys
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import ODD_SPACE
from .common import MEMORIES, forget_others, text_or_empty, written

CAPACITY = 2048
#: Parts into which the pieces of one length are dealt for ranking.
SALTS = 64
MEMORY = 1_500_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def fullest(counts: dict[int, int], room: int) -> tuple[list[int], int]:
    """Lengths (largest first, each at most counts[length] times) whose sum is the largest that fits in ``room``."""
    full, reach, steps = 1 << room, 1, []
    mask = (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if counts[x] and x <= room), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left:  # copies in powers of two
            k = min(k, left)
            left -= k
            steps.append((length, k, reach))
            reach |= reach << (length * k) & mask
            k *= 2
            if reach & full:
                break
        if reach & full:
            break
    best, chosen = reach.bit_length() - 1, []
    rest = best
    for length, k, before in reversed(steps):
        if not before >> rest & 1:
            chosen += [length] * k
            rest -= length * k
    return sorted(chosen, reverse=True), best


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths of one bin, number of such bins), by minimum bin slack; uses up the histogram."""
    counts, made = {x: n for x, n in histogram.items() if n}, []
    while counts:
        first = max(counts)
        counts[first] -= 1
        more, _ = fullest(counts, capacity - first) if first < capacity else ([], 0)
        counts[first] += 1
        lengths = [first, *more]
        times = min(counts[x] // n for x, n in Counter(lengths).items())
        for x, n in Counter(lengths).items():
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]
        made.append((lengths, times))
    return made


def slots(made: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """Of each length, rows (first rank, first bin, copies in a bin, offset of the first copy), by first rank."""
    ranks: Counter = Counter()
    out: dict[int, list] = {}
    bins = 0
    for lengths, times in made:
        offset = 0
        for x in dict.fromkeys(lengths):
            n = lengths.count(x)
            out.setdefault(x, []).append((ranks[x], bins, n, offset))
            ranks[x] += n * times
            offset += n * x
        bins += times
    return {x: np.array(rows, dtype=np.int64) for x, rows in out.items()}


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit bytes; chunks between white space are remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.new: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        return np.array(self.encoder.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for text in texts:
            if "<|" in text or ODD_SPACE.search(text):
                yield self.ids(text)
                continue
            words = text.split()
            missing = list(set(words).difference(self.new))
            if missing:
                if len(self.new) > MEMORY:
                    self.new = {}
                    missing = list(set(words))
                for w, e in zip(missing, self.encoder.encode_batch(missing, add_special_tokens=False), strict=True):
                    self.new[w] = array("I", e.ids).tobytes() if sys.byteorder == "little" else np.array(e.ids, dtype="<u4").tobytes()
            yield b"".join(map(self.new.__getitem__, words))


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


MEMORIES["packing"] = encoder.cache_clear


def cut_pieces(docs: DataFrame, vocabulary: str, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): a document's ids and id 0, cut only where longer than ``capacity``."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others("packing")
        encode = encoder(vocabulary).encode
        step = 4 * capacity
        for batch in batches:
            rows = []
            for who, ids in zip(batch.column(0).to_pylist(), encode(t.as_py() for t in batch.column(1)), strict=True):
                ids += b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append((who, k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(f"`{doc_id}`").cast("long"), text_or_empty(f"`{text}`")).mapInArrow(pieces, PIECES)


def pack(docs: DataFrame, vocabulary: str, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece with its sequence_id and offset; sequences hold at most ``capacity`` ids, without gaps.

    Sequences of one full piece have numbers below 0, others from 0.

    Null and empty texts are one piece of the single id 0.  Repeated rows are packed one by one.
    Other columns are left out.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)).cast("int")
    # the only pass over the texts; ranks need the rows twice and must see the same ones
    pieces = written(cut_pieces(docs, vocabulary, text, doc_id, capacity).withColumn("salt", salt), "pieces")
    shorter = pieces.filter(F.col("length") < capacity)
    dealt = {(r.length, r.salt): r.n for r in shorter.groupBy("length", "salt").agg(F.count("*").alias("n")).collect()}  # capacity x SALTS rows at most
    histogram: Counter = Counter()
    first = np.zeros((capacity + 1, SALTS), dtype=np.int64)  # rank at which a salt's pieces begin
    for (length, s), n in sorted(dealt.items()):
        first[length, s] = histogram[length]
        histogram[length] += n
    plan = spark.sparkContext.broadcast((first, slots(patterns(histogram, capacity))))
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, where = plan.value
        for batch in batches:
            length, s, r = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5, 6))
            r = r.astype(np.int64) - 1 + first[length, s]
            sequence, offset = np.empty(len(r), np.int64), np.empty(len(r), np.int64)
            for x in np.unique(length):
                rows, at = where[int(x)], np.flatnonzero(length == x)
                row = rows[np.searchsorted(rows[:, 0], r[at], side="right") - 1]
                inside = r[at] - row[:, 0]
                sequence[at] = row[:, 1] + inside // row[:, 2]
                offset[at] = row[:, 3] + inside % row[:, 2] * x
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    # full pieces take the numbers below 0
    full = pieces.filter(F.col("length") == capacity).drop("salt").withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return shorter.withColumn("rank", rank).mapInArrow(place, PIECES + ", sequence_id long, offset long").unionByName(full)
