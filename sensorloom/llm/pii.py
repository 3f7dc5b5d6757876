"""Personal data by patterns and a linear-chain conditional random field (operator 7).

Base spans are those of fixed patterns.  A conditional random field over word-shape features, trained on the
small labelled table below, reads the tokens around digits, at signs and spelt-out ones, and adds spans that the
patterns do not see (spelt-out addresses, phone numbers without a plus, with or without a leading 0).  Tokens far from any of these signs
are outside by the model's definition.  A span is added where its digits or parts make sense and no
base span is touched.  Decoding is Viterbi, in numpy, over batches of windows of equal length.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match never begins inside a run of digits: what follows it would be the same as at the run's start
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(DIGIT.findall(text))


def emails(text: str) -> list[tuple[int, int]]:
    """Each at sign's longest local part, not before the last match's end, and domain; linear in the text."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            found.append((start, end))
        at = text.find("@", max(at + 1, end))
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    spans = [("email", a, b) for a, b in emails(text)]
    if DIGIT.search(text):
        spans += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m[0].split("."))]
        spans += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
        spans += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]
    return spans


# ---- the labelled table: [kind text] marks a span -------------------------------------------------

LABELLED = [
    "write to [email anna dot berg at mailbox dot org] before noon",
    "my address is [email tom [at] example [dot] com] thanks",
    "contact [email info (at) firm (dot) net] for a quote",
    "send it to [email l.meyer@post.example.de] today",
    "reach me under [email jane_doe99@mail.example.com] or by phone",
    "mail [email k.novak at uni dot edu] and wait",
    "schreiben sie an [email kontakt (at) haus (dot) de] bitte",
    "escriba a [email luis [at] correo [dot] es] hoy",
    "questions go to [email support@help.example.org], not here",
    "we met at 10 dot on the line",
    "the dot at the end of line 3 is missing",
    "look at page 12 and at table 7",
    "call [phone 030 1234 5678] after six",
    "phone: [phone (020) 7946-0018] office hours",
    "tel. [phone 555-0142-889] ask for Kim",
    "ring [phone +49 30 901820] or [phone 0171-2345678]",
    "fax [phone 0044 20 7946 0991] as well",
    "mobile [phone 0611.234.567.8] only",
    "telefono [phone 912 345 678] llame por favor",
    "in 1998 there were 12 of 3400 people",
    "the sum of 1,200 and 3.50 is 1203.50",
    "chapter 4.2 page 118 line 7",
    "order 20240117 contains 15 items at 3 each",
    "version 2.10.3 fixes bug 4411 in build 88213",
    "between 12:30 and 14:45 on 2023-05-01",
    "token = 24be64439e3e49cf46b2d7c90f3602a3d0b907ff is not one",
    "id 550e8400-e29b-41d4-a716-446655440000 was found",
    "server [ip 192.168.10.24] does not answer",
    "from [ip 10.0.0.1] to [ip 172.16.254.3] in 4 hops",
    "host [ip 8.8.4.4] replied in 12 ms",
    "card [card 4111 1111 1111 1111] expires 12/27",
    "pay with [card 5500-0000-0000-0004] please",
    "visa [card 4012888888881881] cvv 123",
    "isbn 978-3-16-148410-0 costs 20",
    "population 1234567 in 2011 and 1300000 in 2021",
    "a = 3 ; b = 44 ; c = 555",
    "section 7 (a) and (b) apply at 5 percent",
    "12 34 56 78 90 are even and odd",
    "serial 000123456789012345678 of batch 7",
    "temperature -12.5 to 31.2 at 2 m",
]
LABELS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
TOKEN = re.compile(r"[A-Za-zÀ-ÿ]+|[0-9]+|[^\sA-Za-zÀ-ÿ0-9]")
#: Signs around which tokens are read, and on either side the room, in characters, of how many tokens of a dozen.
SIGN = re.compile(r"[0-9@]|[\[({]\s?(?:[Aa][Tt]|[Dd][Oo][Tt])\s?[\])}]|\b[Dd][Oo][Tt]\b|\b[Aa][Tt]\b(?=\s[A-Za-z0-9-]+\s?\.\s?[A-Za-z0-9])")
REACH = 8
FEATURES = 4_096
ROUNDS, RATE, DECAY = 150, 0.1, 1e-3
WORDS = ("at", "dot", "phone", "tel", "call", "mobile", "fax", "card", "visa", "host", "server", "mail", "email")
STARTS = np.array([not x.startswith("I-") for x in LABELS])
#: An inside label follows a begin or inside label of its kind.
ALLOWED = np.array([[not b.startswith("I-") or a[2:] == b[2:] for b in LABELS] for a in LABELS])


def shape(token: str) -> str:
    c = token[0]
    if c.isdigit():
        return f"9{min(len(token), 8)}"
    if c.isalpha():
        low = token.lower()
        return "w" + low if low in WORDS else ("X" if c.isupper() else "x") + ("1" if len(token) == 1 else "")
    return c


def features(tokens: list[tuple[str, int, int]]) -> np.ndarray:
    """Hashed word-shape features of each token: its own and its neighbours', and whether white space lies between."""
    s = [shape(t) for t, _, _ in tokens]
    gap = ["|", *("_" if a[2] < b[1] else "" for a, b in zip(tokens, tokens[1:], strict=False)), "|"]
    s = ["<", "<", *s, ">", ">"]
    rows = []
    for i in range(len(tokens)):
        p, q, c, n, m = s[i : i + 5]
        names = ("c" + c, "p" + p + gap[i], "n" + gap[i + 1] + n, f"pc{p}{gap[i]}{c}", f"cn{c}{gap[i + 1]}{n}", f"pcn{p}{gap[i]}{c}{gap[i + 1]}{n}", f"q{q}{c}", f"m{c}{m}", f"pp{q}{p}{c}", "b")
        rows.append([crc32(x.encode("utf-8", "replace")) % FEATURES for x in names])
    return np.array(rows, np.int64).reshape(len(tokens), 10)


def labelled_rows() -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for line in LABELLED:
        plain, spans, at = "", [], 0
        for m in re.finditer(r"\[(email|ip|card|phone) ((?:[^\[\]]|\[(?:at|dot)\])+)\]", line):
            plain += line[at : m.start()]
            spans.append((m[1], len(plain), len(plain) + len(m[2])))
            plain += m[2]
            at = m.end()
        plain += line[at:]
        tokens = [(m[0], *m.span()) for m in TOKEN.finditer(plain)]
        y = [next((LABELS.index(("B-" if a == s else "I-") + k) for k, s, e in spans if s <= a and b <= e), 0) for _, a, b in tokens]
        out.append((features(tokens), np.array(y)))
    return out


@cache
def trained() -> tuple[np.ndarray, np.ndarray]:
    """(weights of features by label, transitions): penalised maximum likelihood, by gradient steps with momentum."""
    rows = labelled_rows()
    n = len(LABELS)
    w, t = np.zeros((FEATURES, n)), np.zeros((n, n))
    dw, dt = np.zeros_like(w), np.zeros_like(t)
    for _ in range(ROUNDS):
        gw, gt = -DECAY * w, -DECAY * t
        for x, y in rows:
            e = w[x].sum(axis=1)
            e[0, ~STARTS] = -1e9
            tr = np.where(ALLOWED, t, -1e9)
            a, b = [e[0]], [np.zeros(n)]
            for i in range(1, len(y)):
                a.append(e[i] + np.logaddexp.reduce(a[-1][:, None] + tr, axis=0))
            for i in range(len(y) - 1, 0, -1):
                b.append(np.logaddexp.reduce(tr + (e[i] + b[-1])[None, :], axis=1))
            b = b[::-1]
            z = np.logaddexp.reduce(a[-1])
            for i in range(len(y)):
                d = -np.exp(a[i] + b[i] - z)
                d[y[i]] += 1
                np.add.at(gw, x[i], d / len(rows))
                if i:
                    p = np.exp(a[i - 1][:, None] + tr + (e[i] + b[i])[None, :] - z)
                    gt -= p / len(rows)
                    gt[y[i - 1], y[i]] += 1 / len(rows)
        dw, dt = 0.9 * dw + gw, 0.9 * dt + gt
        w, t = w + RATE * dw, t + RATE * dt
    return w, np.where(ALLOWED, t, -1e9)


def viterbi(windows: list[np.ndarray], model: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """Labels of each window of features, decoded together with windows of the same length."""
    w, t = model
    out: list = [None] * len(windows)
    sizes: dict[int, list[int]] = {}
    for i, x in enumerate(windows):
        sizes.setdefault(len(x), []).append(i)
    for n, every in sizes.items():
        for k in range(0, len(every), max(1, 20_000 // n)):
            at = every[k : k + max(1, 20_000 // n)]
            e = w[np.stack([windows[i] for i in at])].sum(axis=2)
            best = np.where(STARTS, e[:, 0], -1e9)
            back = np.zeros((n, len(at), len(LABELS)), np.int8)
            for i in range(1, n):
                way = best[:, :, None] + t
                back[i] = way.argmax(axis=1)
                best = way.max(axis=1) + e[:, i]
            label = best.argmax(axis=1)
            path = np.empty((len(at), n), np.int64)
            each = np.arange(len(at))
            for i in range(n - 1, -1, -1):
                path[:, i] = label
                label = back[i][each, label]
            for i, p in zip(at, path, strict=True):
                out[i] = p
    return out


def windows(text: str) -> Iterator[list[tuple[str, int, int]]]:
    """Tokens within 12 * REACH characters of a sign; signs whose reaches meet share a window."""
    last = None
    for m in SIGN.finditer(text):
        a, b = max(0, m.start() - 12 * REACH), min(len(text), m.end() + 12 * REACH)
        if last and a <= last[1]:
            last[1] = b
        else:
            if last:
                yield from cut(text, *last)
            last = [a, b]
    if last:
        yield from cut(text, *last)


def cut(text: str, a: int, b: int) -> Iterator[list[tuple[str, int, int]]]:
    while a and text[a - 1].isalnum() and text[a].isalnum():  # not inside a word
        a -= 1
    tokens = [(m[0], *m.span()) for m in TOKEN.finditer(text, a, b)]
    if tokens:
        yield tokens


#: Ways to spell an at sign and a dot, bracketed or as a word of its own.
AT = re.compile(r"\s?(?:[\[({]\s?at\s?[\])}]|(?<![^\s])at(?![^\s])|@)\s?", re.I)
DOT = re.compile(r"\s?(?:[\[({]\s?dot\s?[\])}]|(?<![^\s])dot(?![^\s])|\.)\s?", re.I)
ADDRESS = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: With a leading 0, in any grouping; else in groups of two digits or more, the first (a country's) and last perhaps shorter.
NATIONAL = re.compile(r"^(?:\(?0[0-9]{1,4}\)?[ ./-]?[0-9]{2,4}(?:[ .-]?[0-9]{2,8}){1,3}|(?:\([0-9]{1,5}\)[ ./-]{0,2}|[0-9]{1,5}[ ./-]{1,2})(?:(?:\([0-9]{2,5}\)|[0-9]{2,8})[ ./-]{1,2}){0,4}[0-9]{1,8})$")
DATE = re.compile(r"^(?:(?:1[89]|20)[0-9]{2}([ ./-])[01]?[0-9]\1[0-3]?[0-9]|[0-3]?[0-9]([ ./-])[01]?[0-9]\2(?:1[89]|20)[0-9]{2}|(?:1[89]|20)[0-9]{2} ?[/-] ?(?:1[89]|20)[0-9]{2})$")


def sensible(kind: str, piece: str) -> bool:
    """Whether a span that the field proposes has the parts that its kind needs."""
    digits = digits_of(piece)
    if kind == "email":
        return ADDRESS.fullmatch(DOT.sub(".", AT.sub("@", piece))) is not None
    if kind == "phone":
        return 8 <= len(digits) <= 15 and bool(NATIONAL.match(piece)) and not DATE.match(piece)
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return bool(re.fullmatch(r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}", piece)) and all(int(p) < 256 for p in piece.split("."))


class Taken:
    """The stretches that spans cover, merged and in order; new ones are looked for by halving and come behind the last new one."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        self.starts, self.ends, self.last = [], [], -1
        for a, b in sorted(s[1:] for s in spans):  # base spans of several kinds may overlap
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def free(self, a: int, b: int) -> bool:
        """Whether a stretch touches none; if so, it is taken."""
        k = bisect_left(self.starts, b) - 1  # the last that begins before b
        if a < self.last or k >= 0 and self.ends[k] > a:
            return False
        self.last = b
        return True


def spans_of(texts: list[str], model: tuple[np.ndarray, np.ndarray]) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text."""
    base = [base_spans(t) for t in texts]
    read = [(i, tokens) for i, t in enumerate(texts) for tokens in windows(t)]
    every = [list(b) for b in base]
    taken = [Taken(b) for b in base]
    for (i, tokens), path in zip(read, viterbi([features(t) for _, t in read], model), strict=True):
        k = 0
        while k < len(tokens):
            label = LABELS[path[k]]
            end = k + 1
            if label[0] == "B":
                while end < len(tokens) and LABELS[path[end]] == "I" + label[1:]:
                    end += 1
                a, b = tokens[k][1], tokens[end - 1][2]
                if sensible(label[2:], texts[i][a:b]) and taken[i].free(a, b):
                    every[i].append((label[2:], a, b))
            k = end
    return [(b, sorted(e, key=lambda s: (KINDS.index(s[0]), s[1]))) for b, e in zip(base, every, strict=True)]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans): a row for each row of ``docs``.

    Counts are of all spans; base_sha256 is the digest of the base ones; spans are kind:start:end in code
    points, end exclusive, by kind, then start.  Null and empty texts have none; repeated rows each have theirs;
    null ids are kept; other columns are left out.
    """

    shared = docs.sparkSession.sparkContext.broadcast(trained())  # of a fixed size

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                some = batch.slice(k, 500)
                found = spans_of(some.column(1).to_pylist(), shared.value)
                counts = [pa.array([sum(s[0] == kind for s in e) for _, e in found], pa.int64()) for kind in KINDS]
                shas = [hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found]
                yield pa.RecordBatch.from_arrays([some.column(0), *counts, pa.array(shas), pa.array([joined(e) for _, e in found], pa.string())], names=[x.split()[0] for x in FOUND.split(", ")])

    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_or_empty(f"`{text}`").alias("text")).mapInArrow(rows, FOUND)


def redact(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with each span of its text replaced by its kind in angle brackets; other columns are kept."""

    shared = docs.sparkSession.sparkContext.broadcast(trained())

    @F.pandas_udf("string")
    def clean(values: pd.Series) -> pd.Series:
        cleaned = []
        for value, (_, spans) in zip(values, spans_of(list(values), shared.value), strict=True):
            out, end = [], 0
            for kind, a, b in sorted(spans, key=lambda s: s[1]):
                if a >= end:
                    out.append(value[end:a] + f"<{kind}>")
                    end = b
            cleaned.append("".join(out) + value[end:])
        return pd.Series(cleaned, dtype=object)

    return docs.withColumn(text, F.when(F.col(f"`{text}`").isNotNull(), clean(text_or_empty(f"`{text}`"))))
