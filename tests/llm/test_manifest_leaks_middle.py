"""Operators 11 to 13 against brute force on rows of every awkward kind."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from sensorloom.llm import decontaminate, merkle, middle

H = lambda s: hashlib.sha256(s.encode()).hexdigest()
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


# ---- 11 ----------------------------------------------------------------------------------------------


def leaf(row, small=False):
    text = row[4] if row[4] is None or not small else re.sub("[A-Z]", lambda m: m[0].lower(), row[4])
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def tree(hashes, fanout):
    """Levels from the hashes up, until one is left."""
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([H("".join(levels[-1][k : k + fanout])) for k in range(0, len(levels[-1]), fanout)])
    return levels


def way(levels, at, fanout):
    """(left, right) siblings of each level below the last."""
    out = []
    for level in levels[:-1]:
        run = at // fanout * fanout
        out.append(("".join(level[run:at]), "".join(level[at + 1 : run + fanout])))
        at //= fanout
    return out


def brute_manifest(rows, fanout):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    of = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (-(2**63) if r[0] is None else r[0], leaf(r))) for s in sources}
    trees = {s: tree([leaf(r) for r in of[s]], fanout) for s in sources}
    above = tree([trees[s][-1][0] for s in sources], fanout)
    root, out = above[-1][0], []
    for k, s in enumerate(sources):
        for at, r in enumerate(of[s]):
            path = way(trees[s], at, fanout) + way(above, k, fanout)
            h = leaf(r, zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 5 == 0)
            for a, b in path:
                h = H(a + h + b)
            out.append((r[0], leaf(r), trees[s][-1][0], root, H("".join(a + b for a, b in path)), h, h == root))
    return sorted(out, key=str)


def manifest_rows(spark, rows, fanout=16):
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("g", "leaf", "M", "digits", "path", "root"):
        df = df.withColumn(c, F.lit("z"))
    text = F.col("text")
    small = F.when(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0, F.translate(text, decontaminate.CAPITALS, decontaminate.SMALL)).otherwise(text)
    return sorted([tuple(r) for r in merkle.verified(merkle.manifest(df, now={"text": small}, fanout=fanout)).collect()], key=str)


@pytest.mark.parametrize("fanout", [2, 16])
def test_manifest(spark, monkeypatch, fanout):
    monkeypatch.setattr(merkle, "CHUNK", 3)  # equal rows are made in several places
    rng = random.Random(fanout)
    ids = [rng.choice([i, i * 65_536, -i * 2**40, 2**62 + i]) for i in range(120)]
    rows = [(i, rng.choice(["a", "b", "é", "Z", ""]), "en", 3, f"Text {i} É") for i in ids] + [(7, "a", None, None, None)] * 8 + [(9, "b", "x", 1, f"V {k}") for k in range(40)]
    rows += [(None, None, None, None, None), (None, None, "de", 1, "Ab"), (5, "lone", "", -1, ""), (-(2**63), None, "q", 0, "y" * 70_000)]
    assert manifest_rows(spark, rows, fanout) == brute_manifest(rows, fanout)


def test_manifest_of_one_row_one_source_and_none(spark):
    for rows in ([(1, "s", "l", 1, "A")], [(k, "s", "l", 1, "A") for k in range(17)], [(1, s, None, 1, "A") for s in ("x", None)]):
        assert manifest_rows(spark, rows) == brute_manifest(rows, 16)
    assert manifest_rows(spark, []) == []


def test_ranks_of_any_number_of_runs(spark):
    rows = [(k * 3, "s", "l", 1, "A") for k in range(300)]  # 19 runs, two of 16 above them, one on top
    assert manifest_rows(spark, rows) == brute_manifest(rows, 16)


# ---- 12 ----------------------------------------------------------------------------------------------


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_hits(docs, items, window):
    out, wins = [], {}
    for i, t in items:
        w = words(t)
        for k in range(max(len(w) - window, 0) + 1 if w else 0):
            wins.setdefault(tuple(w[k : k + window]), set()).add("" if i is None else str(i))
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit.update(range(k, k + n))
                    found |= wins[tuple(w[k : k + n])]
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def hits(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    for c in ("row_id", "words", "Shingle", "at", "n_words", "items", "start"):
        d = d.withColumn(c, F.lit("z"))
    got = decontaminate.contaminated(d, spark.createDataFrame(items, "item_id long, text string"), **more)
    return sorted([(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got.collect()], key=str)


@pytest.mark.parametrize("seed,window,shingle", [(1, 10, 5), (2, 4, 3), (3, 3, 5)])
def test_decontaminate(spark, seed, window, shingle):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice(["a", "B", "é", "Éa", "c7", "İ", "日本"]) for _ in range(n))
    items = [(k, text(rng.choice([1, 2, 3, 5, 12, 30]))) for k in range(12)] + [(3, "a b, c7"), (None, "only here it is"), (50, None), (51, " .,- "), (None, "only here it is")]
    docs = [(k, text(rng.choice([0, 1, 4, 40]))) for k in range(60)]
    docs += [(None, None), (61, ""), (62, "x only here, IT is. y"), (62, "x only here, IT is. y"), (63, "pre " + (items[5][1] + " ") * 300), (64, items[9][1].lower())]
    assert hits(spark, docs, items, window=window, shingle=shingle) == brute_hits(docs, items, window)


def test_decontaminate_of_nothing(spark):
    docs = [(1, "a b c"), (2, None)]
    assert hits(spark, docs, []) == [(1, 3, 0, []), (2, 0, 0, [])] and hits(spark, docs, [(1, "")]) == [(1, 3, 0, []), (2, 0, 0, [])]
    assert hits(spark, [], [(1, "a b")]) == []


def test_decontaminate_says_where(spark):
    d, b = spark.createDataFrame([(1, "x a b c a b c y")], "doc_id long, text string"), spark.createDataFrame([(1, "A b C")], "item_id long, text string")
    assert [tuple(s) for s in decontaminate.contaminated(d, b).first().spans] == [(1, 4), (4, 7)]


def test_decontaminate_runs_no_python(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = decontaminate.contaminated(docs, docs.withColumnRenamed("doc_id", "item_id"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# ---- 13 ----------------------------------------------------------------------------------------------

PATTERN = {"line": r"[^\n]*\n|[^\n]+", "word": r"[^\x20\x09-\x0D]*[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+", "char": r"(?s)."}


def brute_middle(doc_id, text, unit, rate=100, spm=50, seed=7):
    text = text or ""
    units = re.findall(PATTERN[unit], text)
    h = H(f"{seed}:{'' if doc_id is None else doc_id}")
    h = [int(h[k : k + 8], 16) for k in (0, 8, 16, 24)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return (doc_id, len(units), "plain", None, None, text)
    a, z = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:z]), "".join(units[z:])
    form = "spm" if h[3] % 100 < spm else "psm"
    return (doc_id, len(units), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}")


def middle_texts():
    rng = random.Random(4)
    rows = [(k, "".join(rng.choice("ab\n\r 日é<PSM>\t𝄞") for _ in range(rng.randint(0, 40)))) for k in range(300)]
    return rows + [(None, None), (1, ""), (2, "\n\n\n"), (3, "x<P>\ny"), (4, "<" * 9), (5, "a<S\n>b\nc"), (5, "a<S\n>b\nc"), (6, "line é\n" * 20_000), (7, "<M>\n\n"), (8, "no end")]


@pytest.mark.parametrize("unit,rate", [("line", 100), ("word", 100), ("char", 60)])
def test_fill_in_middle(spark, monkeypatch, unit, rate):
    monkeypatch.setattr(middle, "HELD", 1_000)
    rows = middle_texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"output": F.lit("z"), "N": F.lit(1), "form": F.lit("q")})
    got = middle.fill_in_middle(df, unit=unit, rate=rate).withColumn("again", middle.restored()).collect()
    assert sorted([tuple(r)[:6] for r in got], key=str) == sorted((brute_middle(i, t, unit, rate) for i, t in rows), key=str)
    assert sorted(r.again for r in got) == sorted(t or "" for _, t in rows)
    assert middle.fill_in_middle(df.limit(0)).count() == 0


def test_ranks_of_units():
    for unit, pattern in PATTERN.items():
        automaton = middle.scanner(unit)
        for _, text in middle_texts():
            units = middle.Units(automaton, unit, text or "")
            if not units.marked and len(text or "") < 100:
                sizes = [len(u) for u in re.findall(pattern, text or "")]
                ends = [sum(sizes[:k]) for k in range(len(sizes) + 1)]
                assert units.n == len(sizes) and [units.after(k) for k in range(len(sizes) + 1)] == ends
                assert all(units.rank(at) == sum(e <= at for e in ends[1:]) for at in range(len(text or "") + 1))
    with pytest.raises(ValueError):
        middle.fill_in_middle(None, unit="page")
