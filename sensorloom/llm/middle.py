"""Fill-in-the-middle transformation by an Aho-Corasick event scan (operator 13).

One automaton finds the ASCII characters at which a unit may end and the sentinels.  Between two events the number of
units follows from the length of the gap, so the events alone say how many units a text has and where the k-th ends.
Texts are cut after two random ranks and reordered; each row stays where it is.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
#: Characters that end a unit: a line break; white space behind a word; a unit of one character needs none.
ENDS = {"line": "\n", "word": " \t\n\v\f\r", "char": ""}
#: Characters of output that a task holds before it hands them on.
HELD = 8_000_000


def scanner(unit: str) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for c in ENDS[unit]:
        a.add_word(c, False)
    for s in (PREFIX, SUFFIX, MIDDLE):
        a.add_word(s, True)
    a.make_automaton()
    return a


class Units:
    """Number and ends of the units of a text; ``marked`` where it holds a sentinel (then nothing else is known).

    Lines are ``[^\\n]*\\n|[^\\n]+``, words are ``[^\\s]*\\s+|[^\\s]+`` with ASCII white space, characters are code points.
    """

    def __init__(self, automaton: ahocorasick.Automaton, unit: str, text: str):
        self.size, self.single, self.marked = len(text), unit == "char", False
        ends: list[int] = []  # of the events; those of a run of white space count as one end, its last
        for last, sentinel in automaton.iter(text):
            if sentinel:
                self.marked = True
                return
            if unit == "word" and ends and ends[-1] == last:
                ends[-1] = last + 1
            else:
                ends.append(last + 1)
        self.ends = ends
        rest = self.size - (ends[-1] if ends else 0)
        self.n = len(ends) + (rest if self.single else int(rest > 0))

    def after(self, k: int) -> int:
        """Where the first ``k`` units end."""
        if k == 0:
            return 0
        if k <= len(self.ends):
            return self.ends[k - 1]
        return (self.ends[-1] if self.ends else 0) + k - len(self.ends) if self.single else self.size

    def rank(self, at: int) -> int:
        """How many units end at or before the code point ``at``."""
        if self.single:
            return min(at, self.size)
        whole = bisect_left(self.ends, at + 1)
        return whole + int(at >= self.size and (self.ends[-1] if self.ends else 0) < self.size)


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers of 32 bits; a null id counts as empty text."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def fill_in_middle(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", unit: str = "line", seed: int = SEED, rate: int = 100, spm: int = 50) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): a row for each row of ``docs``.

    unit: line, word or char.  Of texts, ``rate`` in a hundred are reordered, of those ``spm`` in a hundred with the suffix
    first; which ones and where they are cut depends on seed and id alone, so rows that repeat an id are cut alike where
    their texts are equal.  form is plain (the text as it is), psm or spm.  A null text counts as empty; empty texts and
    those that hold a sentinel are plain, with n the number of units all the same.  Other columns are left out.  An
    empty table gives no rows.
    """
    if unit not in ENDS:
        raise ValueError(f"unit must be one of {', '.join(ENDS)}")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = scanner(unit)
        ends_only = ahocorasick.Automaton()
        for c in ENDS[unit]:
            ends_only.add_word(c, False)
        if ENDS[unit]:
            ends_only.make_automaton()
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
        rows, held = [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

        for batch in batches:
            for who, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body = value.as_py()
                units = Units(automaton, unit, body)
                h = draws(who, seed)
                if units.marked:  # the form needs no ranks, the number of units does
                    units = Units(ends_only, unit, body) if ENDS[unit] else units
                    rows.append((who, units.n if ENDS[unit] else len(body), "plain", None, None, body))
                elif not body or h[2] % 100 >= rate:
                    rows.append((who, units.n, "plain", None, None, body))
                else:
                    first, second = sorted((h[0] % (units.n + 1), h[1] % (units.n + 1)))
                    a, z = units.after(first), units.after(second)
                    before, between, behind = body[:a], body[a:z], body[z:]
                    form = "spm" if h[3] % 100 < spm else "psm"
                    made = SUFFIX + behind + PREFIX + before + MIDDLE + between if form == "spm" else PREFIX + before + SUFFIX + behind + MIDDLE + between
                    rows.append((who, units.n, form, len(before), len(between), made))
                held += len(body)
                if held > HELD:
                    yield out()
                    rows, held = [], 0
        if rows:
            yield out()

    whole = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_or_empty(f"`{text}`").alias("text"))
    return whole.mapInArrow(cut, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(form: Column | str = "form", output: Column | str = "output") -> Column:
    """The text that was reordered into ``output``: its parts end at the first sentinels, as a reordered text holds none itself."""
    form, output = (F.col(c) if isinstance(c, str) else c for c in (form, output))
    body = F.substring(output, F.lit(len(PREFIX) + 1), F.length(output))  # behind the first sentinel
    second = F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX))
    at, end = F.locate(SUFFIX, body), F.locate(PREFIX, body)
    cut = F.when(form == "psm", at).otherwise(end)
    one = F.substring(body, F.lit(1), cut - 1)
    rest = F.substring(body, cut + F.length(second), F.length(body))
    stop = F.locate(MIDDLE, rest)
    two, three = F.substring(rest, F.lit(1), stop - 1), F.substring(rest, stop + len(MIDDLE), F.length(rest))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, three, two)).otherwise(F.concat(two, three, one))
