"""Language-model scoring by a subword lattice (operator 2).

The pieces of an existing vocabulary are the edges of each word's lattice, with their scores as first
weights.  Expectation maximisation over all training words turns the scores into piece probabilities
(pieces are taken as they are; none is added).  The log-space forward recursion sums over all
segmentations of a word.  A word of the training texts has one more edge, over the whole word: its count
less an absolute discount; the discounted mass is what the pieces share, so the lattice alone carries
unseen words and probabilities still add up to one.  A document is the product over its words and its end,
hence the marginal over all its segmentations.  The marginal over the pieces alone, without whole-word edges,
is returned beside it.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, text_or_empty, written

MODULUS, HELD_OUT = 7, 2
ROUNDS = 3
#: Added to each piece's expected count.
PRIOR = 0.1
SPACE = "▁"
LONG = 64
SLAB = 65_536
U = np.uint64
BASE = U(0x100000001B3)
START = U(0xCBF29CE484222325)
MULTIPLY = U(0x9E3779B97F4A7C15)
END = b""
#: No token holds a space.
NOTES = b" notes"
#: A use of a word: the document's place in its slab, and how often.
USE = np.dtype([("doc", "<u2"), ("n", "<u4")])
SLAB_DOCS = 8_192
#: Uses that a task sums at once.
HELD = 1_500_000


class Pieces:
    """Pieces by their bytes: those that begin a word, and those inside (with one for each byte)."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.first: dict[bytes, int] = {}
        self.inner: dict[bytes, int] = {}
        self.byte = np.full(256, -1, np.int64)
        scores = []
        for piece, score in pieces:
            if len(piece) == 6 and piece.startswith("<0x"):
                self.byte[int(piece[3:5], 16)] = len(scores)
            elif piece.startswith(SPACE) and SPACE not in piece[1:]:
                self.first[piece[1:].encode()] = len(scores)
            elif SPACE not in piece and not piece.startswith("<"):
                self.inner[piece.encode()] = len(scores)
            else:
                continue
            scores.append(score)
        for b in np.flatnonzero(self.byte < 0):  # any text has a segmentation
            self.byte[b] = len(scores)
            scores.append(min(scores))
        if b"" not in self.first:
            self.first[b""] = len(scores)
            scores.append(max(scores))
        self.scores = np.array(scores)
        self.size = len(scores)
        self.most = max(map(len, [*self.first, *self.inner]))
        # the last id is of an edge that does not exist
        self.first_table, self.inner_table = hashed(self.first, START), hashed(self.inner, U(0))
        self.power = np.cumprod(np.concatenate([[U(1)], np.full(self.most, BASE)]), dtype=U)

    def start(self) -> np.ndarray:
        """Log probabilities from the vocabulary's scores; scores that are ranks (BPE) weigh as 1 / rank."""
        s = self.scores
        s = s if s.min() > -50 else -np.log(2.0 + np.maximum(0, -s))
        p = np.exp(s - s.max())
        return np.log(p / p.sum())


def rolling(part: np.ndarray, seed: np.uint64) -> np.ndarray:
    """Hashes of the prefixes of each row of bytes, that of no byte first."""
    h = np.empty((part.shape[0], part.shape[1] + 1), U)
    h[:, 0] = seed
    for i in range(part.shape[1]):
        h[:, i + 1] = h[:, i] * BASE + part[:, i] + U(1)
    return h


def hashed(ids: dict[bytes, int], seed: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Keys and ids in the slots of an open table of two probes."""
    keys = np.array([rolling(np.frombuffer(p, np.uint8).reshape(1, -1).astype(U), seed)[0, -1] for p in ids], U)
    bits = 20
    slot_keys, slot_ids = np.zeros(1 << bits, U), np.full(1 << bits, -1, np.int32)
    for k, i in zip(keys, ids.values(), strict=True):
        for turn in range(100):  # who is in the way moves to its other slot
            mixed = int(k) * int(MULTIPLY) % (1 << 64)
            places = [(mixed >> shift) & ((1 << bits) - 1) for shift in (64 - bits, 64 - 2 * bits)]
            at = next((x for x in places if slot_ids[x] < 0), places[turn % 2])
            (k, slot_keys[at]), (i, slot_ids[at]) = (slot_keys[at], k), (slot_ids[at], i)
            if i < 0:
                break
        else:
            raise ValueError("the table of pieces is too small")
    return slot_keys, slot_ids


def piece_ids(h: np.ndarray, table: tuple, missing: int) -> np.ndarray:
    keys, ids = table
    m = h * MULTIPLY
    a, b = (m >> U(44)).astype(np.int64), ((m >> U(24)) & U(0xFFFFF)).astype(np.int64)
    return np.where((keys[a] == h) & (ids[a] >= 0), ids[a], np.where((keys[b] == h) & (ids[b] >= 0), ids[b], missing))


class Ids(dict):
    """Numbers words in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = i = len(self)
        return i


def log_sum(parts: list[np.ndarray]) -> np.ndarray:
    x = np.stack(parts)
    top = x.max(axis=0)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis=0)) + top


def edges(part: np.ndarray, pieces: Pieces) -> tuple[list[np.ndarray], dict[tuple[int, int], np.ndarray]]:
    """Ids of the first piece up to each place, and of the pieces between places (i, j)."""
    n, missing = part.shape[1], pieces.size
    wide = part.astype(U)
    h = rolling(wide, START)
    begin = [piece_ids(h[:, j], pieces.first_table, missing) if j <= pieces.most else np.full(len(part), missing) for j in range(n + 1)]
    h = rolling(wide, U(0))
    inner = {(i, j): piece_ids(h[:, j] - h[:, i] * pieces.power[j - i], pieces.inner_table, missing) for j in range(1, n + 1) for i in range(max(0, j - pieces.most), j)}
    return begin, inner


def forward(part: np.ndarray, begin: list, inner: dict, log_p: np.ndarray, pieces: Pieces) -> list[np.ndarray]:
    """Log probability of each prefix over all its segmentations."""
    alpha = []
    for j in range(part.shape[1] + 1):
        ways = [log_p[begin[j]]]
        if j:
            ways.append(alpha[j - 1] + log_p[pieces.byte[part[:, j - 1]]])
            ways += [alpha[i] + log_p[inner[i, j]] for i in range(max(0, j - pieces.most), j)]
        alpha.append(log_sum(ways))
    return alpha


def expected(part: np.ndarray, count: np.ndarray, log_p: np.ndarray, pieces: Pieces, total: np.ndarray) -> None:
    """Adds the expected uses of each piece in the words ``part`` that occur ``count`` times."""
    begin, inner = edges(part, pieces)
    alpha = forward(part, begin, inner, log_p, pieces)
    n = part.shape[1]
    beta: list = [None] * (n + 1)
    beta[n] = np.zeros(len(part))
    for i in range(n - 1, -1, -1):
        ways = [log_p[pieces.byte[part[:, i]]] + beta[i + 1]]
        ways += [log_p[inner[i, j]] + beta[j] for j in range(i + 1, min(n, i + pieces.most) + 1)]
        beta[i] = log_sum(ways)

    ids, ways = [], []
    for j in range(n + 1):
        ids.append(begin[j])
        ways.append(log_p[begin[j]] + beta[j])
        if j:
            b = pieces.byte[part[:, j - 1]]
            ids.append(b)
            ways.append(alpha[j - 1] + log_p[b] + beta[j])
            for i in range(max(0, j - pieces.most), j):
                ids.append(inner[i, j])
                ways.append(alpha[i] + log_p[inner[i, j]] + beta[j])
    w = np.exp(np.stack(ways) - alpha[n]) * count
    total += np.bincount(np.stack(ids).ravel(), w.ravel(), minlength=pieces.size + 1)


def long_word(word: bytes, log_p: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, list]:
    """Prefix log probabilities of one long word, and its edges (i, j, id); i is -1 for first pieces."""
    n = len(word)
    alpha, found = np.full(n + 1, -np.inf), []
    for j in range(n + 1):
        ways = []
        if j <= pieces.most and word[:j] in pieces.first:
            found.append((-1, j, pieces.first[word[:j]]))
            ways.append(log_p[found[-1][2]])
        if j:
            found.append((j - 1, j, int(pieces.byte[word[j - 1]])))
            ways.append(alpha[j - 1] + log_p[found[-1][2]])
        for i in range(max(0, j - pieces.most), j):
            if (p := pieces.inner.get(word[i:j])) is not None:
                found.append((i, j, p))
                ways.append(alpha[i] + log_p[p])
        alpha[j] = np.logaddexp.reduce(ways)
    return alpha, found


def by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, bytes of the words there) for each length up to LONG."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    for n in np.unique(sizes[sizes <= LONG]):
        at = order[np.searchsorted(sizes[order], n) : np.searchsorted(sizes[order], n, side="right")]
        step = max(256, 400_000 // (int(n) * min(int(n), 16) + 1))
        for k in range(0, len(at), step):
            some = at[k : k + step]
            yield some, np.frombuffer(b"".join(words[i] for i in some), np.uint8).reshape(len(some), int(n))


def word_log10(words: list[bytes], log_p: np.ndarray, pieces: Pieces) -> np.ndarray:
    """log10 probability of each word over all segmentations."""
    out = np.empty(len(words))
    for at, part in by_length(words):
        out[at] = forward(part, *edges(part, pieces), log_p, pieces)[-1]
    for i, w in enumerate(words):
        if len(w) > LONG:
            out[i] = long_word(w, log_p, pieces)[0][-1]
    return out / np.log(10)


def word_expected(words: list[bytes], counts: np.ndarray, log_p: np.ndarray, pieces: Pieces) -> np.ndarray:
    total = np.zeros(pieces.size + 1)
    for at, part in by_length(words):
        expected(part, counts[at], log_p, pieces, total)
    for w, c in zip(words, counts, strict=True):
        if len(w) > LONG:
            alpha, found = long_word(w, log_p, pieces)
            beta = np.full(len(w) + 1, -np.inf)
            beta[len(w)] = 0
            for i, j, p in sorted(found, key=lambda e: -e[0]):
                if i >= 0:
                    beta[i] = np.logaddexp(beta[i], log_p[p] + beta[j])
            for i, j, p in found:
                total[p] += c * np.exp((alpha[i] if i >= 0 else 0.0) + log_p[p] + beta[j] - alpha[-1])
    return total[:-1]


def slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of word tables in parts of about SLAB."""
    kept: list = []
    for batch in batches:
        kept.append(batch)
        if sum(b.num_rows for b in kept) >= SLAB:
            yield pa.Table.from_batches(kept)
            kept = []
    if kept:
        yield pa.Table.from_batches(kept)


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece model, without its control pieces."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(m.id_to_piece(i), m.get_score(i) if not m.is_byte(i) else -float(m.get_piece_size())) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i))]


def lm_scores(docs: DataFrame, model: str, text: str = "text", doc_id: str = "doc_id", modulus: int = MODULUS, held_out: int = HELD_OUT, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, lattice_score): a row for each row of ``docs``.

    score is the marginal over pieces and whole-word edges, lattice_score that over the pieces alone (an end has the share
    that ends have of the training tokens, words the rest).

    model: path of a sentencepiece model on the driver.  Rows whose crc32 of the id modulo ``modulus`` is
    ``held_out`` are scored but not learnt from.  Letters A-Z are lowered; tokens are words between ASCII
    white space and one end of the text.  Null and empty texts have the end alone; null ids hash as an
    empty text; repeated rows count each time; other columns are left out.  Without training rows the
    vocabulary's own scores hold.  An empty table gives no rows.
    """
    spark = docs.sparkSession

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slab = TaskContext.get().partitionId() << 24

        def rows(words: Ids, notes: list, ids: list, times: list) -> pa.RecordBatch:
            sizes = [len(x) for x in ids]
            word, n = np.concatenate(ids), np.concatenate(times)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            taught = np.array([not held for _, held, _ in notes], float)[doc]
            train = np.bincount(word, n * taught, minlength=len(words)).astype(np.int64)
            order = np.argsort(word, kind="stable")
            uses = np.empty(len(word), USE)
            uses["doc"], uses["n"] = doc[order], n[order]
            ends = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(words)))]) * USE.itemsize
            packed = pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(uses.tobytes())]).cast(pa.binary())
            columns = [pa.array([*words, NOTES], pa.binary()), pa.array([slab] * (len(words) + 1), pa.int64()), pa.array(np.append(train, 0)), pa.concat_arrays([packed, pa.array([noted(notes)], pa.binary())])]
            return pa.RecordBatch.from_arrays(columns, names=["word", "slab", "train", "uses"])

        words, notes, ids, times, size = Ids(), [], [], [], 0
        for batch in batches:
            texts = batch.column(2).cast(pa.large_binary() if pa.types.is_large_string(batch.column(2).type) else pa.binary())
            for who, held, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
                found = Counter(t.as_py().lower().split())
                found[END] = 1
                times.append(np.fromiter(found.values(), np.uint32, len(found)))
                ids.append(np.fromiter(map(words.__getitem__, found), np.int64, len(found)))
                notes.append((who, held, int(times[-1].sum())))
                size += len(found)
                if size > 1_500_000 or len(notes) == SLAB_DOCS:
                    yield rows(words, notes, ids, times)
                    words, notes, ids, times, size = Ids(), [], [], [], 0
                    slab += 1
        if notes:
            yield rows(words, notes, ids, times)

    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), (crc_mod(f"`{doc_id}`", modulus) == held_out).alias("held_out"), text_or_empty(f"`{text}`").alias("text"))
    # each word's uses by slabs of documents: the only pass over the texts
    postings = written(source.mapInArrow(counted, "word binary, slab long, train long, uses binary"), "postings")
    notes = postings.filter(F.col("word") == F.lit(NOTES))
    uses = postings.filter(F.col("word") != F.lit(NOTES))
    words = written(uses.groupBy("word").agg(F.sum("train").alias("c")), "words")
    of_count = [F.count_if(F.col("c") == k) for k in (1, 2)]
    total = words.agg(F.sum("c"), F.count_if(F.col("c") > 0), *of_count, F.max(F.when(F.col("word") == F.lit(END), F.col("c")))).first()
    n_train, distinct, once, twice, n_ends = (int(x or 0) for x in total)
    end_share = (n_ends + 0.5) / (n_train + 1)  # a half without training rows
    discount = once / (once + 2 * twice) if once and twice else 0.5
    pieces = Pieces(vocabulary(model))
    log_p = learnt(words, pieces, rounds)
    shared = spark.sparkContext.broadcast((pieces, log_p))  # as large as the vocabulary

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, log_p = shared.value
        for part in slabs(batches):
            w, c = part.column("word").to_pylist(), part.column("c").to_numpy()
            lp = word_log10(w, log_p, pieces)
            ends = [i for i, x in enumerate(w) if x == END]
            pure = lp + np.log10(1 - end_share)
            pure[ends] = np.log10(end_share)
            if n_train:
                lp[ends] = -np.inf
                with np.errstate(divide="ignore"):
                    whole = np.log(np.maximum(c - discount, 0) / n_train)
                lp = np.logaddexp(whole, lp * np.log(10) + np.log(discount * distinct / n_train)) / np.log(10)
            else:  # half a document's probability mass is its end's
                lp[ends] = 0
                lp -= np.log10(2)
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), pa.array(c), pa.array(lp), pa.array(pure)], names=["word", "c", "lp", "pure"])

    each = words.mapInArrow(scored, "word binary, c long, lp double, pure double")
    least = float(n_train + distinct + 1)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of documents' known tokens and log probabilities over the words of this task: a row for each slab, with the places it has."""
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def rows() -> pa.RecordBatch:
            key, *values = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            sums = [np.add.reduceat(v[order], first) for v in values]
            slab, place = np.divmod(key[first], SLAB_DOCS)
            begin = np.flatnonzero(np.diff(slab, prepend=-1))
            ends = np.append(begin, len(slab))

            def cut(x: np.ndarray) -> pa.Array:
                """The parts of ``x`` between ``ends``, as bytes."""
                return pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer((ends * x.itemsize).astype(np.int64)), pa.py_buffer(x.tobytes())]).cast(pa.binary())

            return pa.RecordBatch.from_arrays([pa.array(slab[begin]), pa.nulls(len(begin), pa.binary()), cut(place.astype("<u2")), *map(cut, sums)], names=["slab", "notes", "place", "known", "base", "score", "lattice"])

        for batch in batches:
            every = np.cumsum(pc.binary_length(batch.column(1)).to_numpy() // USE.itemsize)
            begin = 0
            while begin < batch.num_rows:  # parts of a batch of at most HELD uses, or one row
                end = max(begin + 1, int(np.searchsorted(every, (every[begin - 1] if begin else 0) + HELD, side="right")))
                slab, c, lp, pure = (batch.column(i).to_numpy()[begin:end] for i in (0, 2, 3, 4))
                sizes = np.diff(every[begin:end], prepend=every[begin - 1] if begin else 0)
                u = np.frombuffer(b"".join(batch.column(1).slice(begin, end - begin).to_pylist()), USE)
                n = u["n"].astype(np.float64)
                held.append((np.repeat(slab * SLAB_DOCS, sizes) + u["doc"], *(np.repeat(x, sizes) * n for x in (c > 0, np.log10((c + 1) / least), lp, pure))))
                size, begin = size + len(u), end
                if size > HELD:
                    yield rows()
                    held, size = [], 0
        if size:
            yield rows()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of each slab's parts, which follow one another, beside the notes on its documents."""

        def rows(notes: list, known: np.ndarray, *sums: np.ndarray) -> pa.RecordBatch:
            k = len(notes)
            columns = [[x[i] for x in notes] for i in range(3)]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.bool_()), pa.array(columns[2], pa.int64()), pa.array(np.rint(known[:k]).astype(np.int64)), pa.array([n_train] * k, pa.int64()), *(pa.array(x[:k]) for x in sums)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "lattice_score"])

        now, notes, sums = None, None, None
        for batch in batches:
            for slab, note, place, *parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if slab != now:
                    if now is not None:
                        yield rows(notes, *sums)
                    now, notes, sums = slab, None, [np.zeros(SLAB_DOCS) for _ in range(4)]
                if note is not None:
                    notes = read_notes(note)
                else:
                    at = np.frombuffer(place, "<u2")
                    for x, p in zip(sums, parts, strict=True):
                        x[at] += np.frombuffer(p)
        if now is not None:
            yield rows(notes, *sums)

    empty = F.lit(None).cast("binary")
    # a word has one row on the right and one for each slab on the left, so Spark can split the tasks of frequent words
    sums = uses.join(each, "word").select("slab", "uses", "c", "lp", "pure").mapInArrow(summed, "slab long, notes binary, place binary, known binary, base binary, score binary, lattice binary")
    both = sums.unionByName(notes.select("slab", F.col("uses").alias("notes"), *[empty.alias(c) for c in ("place", "known", "base", "score", "lattice")]))
    return both.repartition("slab").sortWithinPartitions("slab").mapInArrow(joined, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, lattice_score double")


def noted(rows: list[tuple]) -> bytes:
    """(id or null, held out, tokens) of documents, as JSON."""
    return json.dumps([[a, int(b), c] for a, b, c in rows]).encode()


def read_notes(text: bytes) -> list[tuple]:
    return [(a, bool(b), c) for a, b, c in json.loads(text)]


def learnt(words: DataFrame, pieces: Pieces, rounds: int) -> np.ndarray:
    """Log probability of each piece and, last, minus infinity for edges that do not exist.

    Each distinct training word counts once: the pieces are for words that were not seen.
    """
    log_p = np.append(pieces.start(), -np.inf)
    train = words.filter("c > 0 and length(word) > 0").select("word")
    for _ in range(rounds):
        shared = words.sparkSession.sparkContext.broadcast((pieces, log_p))

        def counted(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            pieces, log_p = shared.value
            total = np.zeros(pieces.size)
            for part in slabs(batches):
                total += word_expected(part.column("word").to_pylist(), np.ones(part.num_rows), log_p, pieces)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["piece", "n"])

        sums = train.mapInArrow(counted, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()  # a row for each piece at most
        if not sums.num_rows:
            break
        n = np.full(pieces.size, PRIOR)
        n[sums.column(0).to_numpy()] += sums.column(1).to_numpy()
        log_p = np.append(np.log(n / n.sum()), -np.inf)
    return log_p
