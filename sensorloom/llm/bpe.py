"""Token counts by heap-and-linked-list byte-pair merging (operator 3).

Adjacent pairs of a word's symbols wait in a heap by merge rank, then place; the lowest is popped,
checked against the linked list of live symbols and merged.  A word's count is its first number of
symbols less the merges made; no identifier is looked up.

White space never falls inside a token of this vocabulary's pre-tokenizer, so counts are remembered
for each white-space-separated chunk.  The memory is bounded: when it is full the older half goes.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

LIMIT = 2048
#: Chunks remembered in each of the two generations.
MEMORY = 500_000
#: str.split() takes these for white space, the tokenizer does not.
ODD_SPACE = re.compile("[\x1c-\x1f]")

# Where the library's tables of Unicode differ from those here.  Small letters of two capitals; code
# points that are letters here only, at the same three places of four blocks that have no characters.
SMALL = {0xA7CB: 0x264, 0xA7DC: 0x19B}
BLOCKS, PLACES = (0x32000, 0x3D000, 0x3E000, 0x3F000), (0x808, 0x85C, 0x988)
#: What stands for these when words are found: a code point for private use.
STANDS = {block + place: 0xE000 for block in BLOCKS for place in PLACES}
STRANGE = re.compile("[" + "".join(map(chr, STANDS)) + "]")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stays, the rest moves up from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    moved = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    return [chr(moved.get(b, b)) for b in range(256)]


def merge_count(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left after all merges."""
    n = left = len(symbols)
    if n < 2:
        return n
    symbols, before, after = list(symbols), list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := ranks.get((a, b))) is not None]
    heapify(heap)
    while heap:
        _, i, a, b = heappop(heap)
        j = after[i]
        if j < 0 or symbols[i] != a or symbols[j] != b:
            continue
        symbols[i], symbols[j] = a + b, ""
        left -= 1
        after[i] = k = after[j]
        after[j] = -1
        if k >= 0:
            before[k] = i
            if (r := ranks.get((a + b, symbols[k]))) is not None:
                heappush(heap, (r, i, a + b, symbols[k]))
        if (h := before[i]) >= 0 and (r := ranks.get((symbols[h], a + b))) is not None:
            heappush(heap, (r, h, symbols[h], a + b))
    return left


class Counter:
    """Counts tokens as the library does for a byte-level vocabulary with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.ranks = {tuple(m): i for i, m in enumerate(spec["model"]["merges"])}
        self.end = spec["model"]["end_of_word_suffix"] or ""
        parts = spec["pre_tokenizer"]["pretokenizers"]
        self.words = regex.compile(parts[0]["pattern"]["Regex"])
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.cut = re.compile("|".join(map(re.escape, self.special)))
        self.bytes = byte_symbols()
        self.new: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def word(self, word: str) -> int:
        symbols = [self.bytes[b] for b in word.encode("utf-8", "replace")]
        symbols[-1] += self.end
        return merge_count(symbols, self.ranks)

    def chunk(self, chunk: str) -> int:
        """Tokens of a chunk without special strings."""
        # case folding is by single characters: a final sigma is lowered like any other
        chunk = chunk.lower() if chunk.isascii() else unicodedata.normalize("NFC", chunk).replace("Σ", "σ").translate(SMALL).lower()
        if STRANGE.search(chunk):
            return sum(self.word(chunk[slice(*m.span())]) for m in self.words.finditer(chunk.translate(STANDS)))
        return sum(map(self.word, self.words.findall(chunk)))

    def remembered(self, chunk: str) -> int:
        n = self.old.get(chunk)
        if n is None:
            n = self.chunk(chunk)
        if len(self.new) >= MEMORY:
            self.old, self.new = self.new, {}
        self.new[chunk] = n
        return n

    def count(self, text: str) -> int:
        total = 0
        if "<|" in text and self.cut.search(text):
            parts = self.cut.split(text)
            return len(parts) - 1 + sum(map(self.count, parts))
        if ODD_SPACE.search(text):
            return self.chunk(text)
        get = self.new.get
        for w in text.split():
            n = get(w)
            if n is None:
                n = self.remembered(w)
                get = self.new.get
            total += n
        return total


@cache
def counter(path: str) -> Counter:
    """One for each worker process, so that tasks of a worker share what it remembers."""
    return Counter(path)


def token_counts(docs: DataFrame, vocabulary: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit in place of its text.

    vocabulary: path of a tokenizers JSON file, readable on every executor.  Null and empty texts
    have 0 bytes and 0 tokens.  Repeated rows and equal texts are counted one by one; other columns
    are kept, and lose to the new ones where names clash.  An empty table gives an empty one.
    """
    kept = [c for c in docs.columns if c.lower() not in {text.lower(), "n_bytes", "n_tokens", "over_limit"}]
    schema = docs.select(*kept).withColumns({"n_bytes": F.lit(0).cast("long"), "n_tokens": F.lit(0).cast("long"), "over_limit": F.lit(True)}).schema

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary).count
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            found = [count(t.as_py()) for t in texts]
            over = pa.array([n > limit for n in found], pa.bool_())
            sizes = pa.compute.binary_length(texts.cast(pa.binary() if pa.types.is_string(texts.type) else pa.large_binary())).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], sizes, pa.array(found, pa.int64()), over], names=schema.names)

    import pyarrow.compute  # noqa: F401  (pa.compute)

    return docs.select(*[F.col(f"`{c}`") for c in kept], text_or_empty(f"`{text}`").alias("__text")).mapInArrow(counts, schema)
