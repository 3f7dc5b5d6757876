import collections
import gzip
import hashlib
import itertools
import math
import random
import re
import threading
import zlib

import numpy as np
import public_tokenizers
import pytest
from oracle import same
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sensorloom.llm import bpe, exact, lattice, mixing, near, packing, pii, quality, queries, topk, warc

SF = "/root/testdata/sf0.001"
BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
ROWS = [(1, "The quick brown fox"), (2, None), (3, ""), (4, "The quick brown fox"), (4, "The quick brown fox"), (None, "x " * 5000), (5, "don't <|endoftext|> İ \x1c a\x1cb " + "y" * 3000), (6, "mail a.b@c.org +1 (555) 123-4567, 10.0.0.1")]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    for c in ("Score", "kept", "n_tokens", "sha", "digest", "node", "bucket_", "word"):  # extra columns with clashing names
        df = df.withColumn(c, F.lit("z"))
    return df.withColumn("lang", F.lit("en")).withColumn("quality", F.lit("q"))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 0), (4, 1, None), (None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    same(spark, SF, queries.queries()[name], queries.oracle_sql()[name])


def test_token_counts(spark, docs):
    t = Tokenizer.from_file(BPE)
    got = bpe.token_counts(docs, BPE).collect()
    assert sorted(r.n_tokens for r in got) == sorted(len(t.encode(x or "", add_special_tokens=False).ids) for _, x in ROWS)
    assert sorted(r.n_bytes for r in got) == sorted(len((x or "").encode()) for _, x in ROWS) and "lang" in got[0]
    whole = queries.op3_token_counts(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(r.n_tokens == len(t.encode(texts[r.doc_id], add_special_tokens=False).ids) for r in whole) and len(whole) == len(texts)
    assert bpe.token_counts(docs.limit(0), BPE).count() == 0


@pytest.mark.parametrize("around", ["a{}b", "!{}!", "1 {}"])
def test_token_counts_of_every_code_point(around):
    t, count = Tokenizer.from_file(BPE), bpe.Counter(BPE).count
    for k in range(0, 0x110000, 0x8000):
        texts = [around.format(chr(i)) for i in range(k, k + 0x8000) if not 0xD800 <= i < 0xE000]
        assert [x for x, e in zip(texts, t.encode_batch(texts, add_special_tokens=False), strict=True) if count(x) != len(e.ids)] == []


def test_quality(spark, docs, labels):
    got = quality.quality(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert quality.quality(docs.limit(0), labels.limit(0)).count() == 0
    q = queries.op1_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("held_out").toPandas()
    p, r = q.quality == 1, q.score.rank()
    assert (r[p].sum() - p.sum() * (p.sum() + 1) / 2) / (p.sum() * (~p).sum()) > 0.95


def test_quality_learns_one_row_of_an_id(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "Network", lambda x, y: seen.append((len(x), y.sum())) or 0.5)
    df = spark.createDataFrame([(1, f"copy {i} of one id") for i in range(300)] + [(i, f"text {i}") for i in range(2, 22)], "doc_id long, text string")
    quality.fit(df, spark.createDataFrame([(i, i % 2) for i in range(1, 22)], "doc_id long, quality int"), modulus=1, held_out=1)
    assert seen == [(21, 11)]


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [""]


def test_lattice(spark, docs):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in lattice.lm_scores(df, PIECES).collect()}
    texts = {r.doc_id: r.text for r in df.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    c = collections.Counter(w for i, t in texts.items() if not held[i] for w in tokens(t))
    n, v = sum(c.values()), len(c)
    for i, t in texts.items():
        w, r = tokens(t), got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w), sum(c[x] > 0 for x in w), n)
        assert abs(r.base_score - sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) < 1e-6 and r.score < 0
    assert lattice.lm_scores(docs, PIECES).count() == len(ROWS) and lattice.lm_scores(docs.limit(0), PIECES).count() == 0


def test_lattice_scores_sum_all_segmentations_of_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lattice, "vocabulary", lambda path: [("▁", -2.0), ("▁a", -1.0), ("a", -1.5), ("b", -2.0), ("ab", -2.5), ("▁ab", -3.0), ("c", -4.0)])
    texts = {1: "ab abc", 2: "", 3: "a  ba AB", 4: None, 5: "é ab", 6: "cc", 8: "ab a"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in lattice.lm_scores(df, "", rounds=2).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    c = collections.Counter(w for i, t in texts.items() if not held[i] for w in tokens(t))
    n, v = sum(c.values()), len(c)
    once, twice = (sum(x == k for x in c.values()) for k in (1, 2))
    discount = once / (once + 2 * twice) if once and twice else 0.5
    pieces = lattice.Pieces(lattice.vocabulary(""))
    p = np.exp(pieces.start())
    name = {i: b for b, i in pieces.inner.items()} | {int(i): bytes([b]) for b, i in enumerate(pieces.byte)}

    def ways(word, at=-1):
        """Every segmentation of ``word`` as lists of pieces."""
        if at < 0:
            return [[i, *rest] for b, i in pieces.first.items() if word.startswith(b) for rest in ways(word, len(b))]
        if at == len(word):
            return [[]]
        return [[i, *rest] for i, b in name.items() if word[at:].startswith(b) for rest in ways(word, at + len(b))]

    words = {w.encode(): [list(x) for x in ways(w.encode())] for t in texts.values() for w in tokens(t) if w}
    for _ in range(2):
        uses = np.full(pieces.size, lattice.PRIOR)
        for w in (w.encode() for w in c if w):
            each = np.array([np.prod(p[x]) for x in words[w]])
            for x, share in zip(words[w], each / each.sum(), strict=True):
                np.add.at(uses, x, share)
        p = uses / uses.sum()
    end = (c[""] + 0.5) / (n + 1)
    for i, t in texts.items():
        marginal = {w: sum(np.prod(p[x]) for x in words[w.encode()]) for w in tokens(t) if w}
        pure = sum(math.log10(end) if not w else math.log10((1 - end) * marginal[w]) for w in tokens(t))
        whole = sum(math.log10(max(c[w] - discount, 0) / n + (marginal[w] * discount * v / n if w else 0)) for w in tokens(t))
        assert abs(got[i].lattice_score - pure) < 1e-6 and abs(got[i].score - whole) < 1e-6


def test_lattice_of_held_out_rows_only(spark):
    df = spark.createDataFrame([(1, "the fox"), (2, ""), (3, "a the the")], "doc_id long, text string")
    got = {r.doc_id: r for r in lattice.lm_scores(df, PIECES, modulus=1, held_out=0).collect()}
    assert set(got) == {1, 2, 3}
    assert all(r.held_out and r.n_known == r.train_tokens == r.base_score == 0 and r.n_tokens == n and r.score < 0 for r, n in zip((got[1], got[2], got[3]), (3, 1, 4), strict=True))


def test_lattice_sums_all_segmentations():
    pieces = lattice.Pieces([("▁a", -1.0), ("▁", -2.0), ("a", -1.5), ("b", -2.0), ("ab", -2.5), ("▁ab", -3.0)])
    log_p = np.append(pieces.start(), -np.inf)
    name = {i: b for b, i in pieces.inner.items()}

    def ways(rest):
        if not rest:
            return 1.0
        total = np.exp(log_p[pieces.byte[rest[0]]]) * ways(rest[1:])
        return total + sum(np.exp(log_p[i]) * ways(rest[len(b) :]) for i, b in name.items() if rest.startswith(b))

    for word in (b"ab", b"aab", b"b", b"abab\xff", b"ab" * 40):
        want = sum(np.exp(log_p[i]) * ways(word[len(b) :]) for b, i in pieces.first.items() if word.startswith(b)) if len(word) < 20 else None
        short = lattice.word_log10([word], log_p, pieces)[0]
        long = lattice.long_word(word, log_p, pieces)[0][-1] / np.log(10)
        assert abs(short - long) < 1e-9 and (want is None or abs(short - np.log10(want)) < 1e-9)
    uses = lattice.word_expected([b"aab"], np.ones(1), log_p, pieces)
    assert uses[[*pieces.first.values()]].sum() == pytest.approx(1)


def test_mixing(spark, docs, labels):
    got = queries.op4_mixing(spark, "/root/testdata/sf0.01").collect()
    totals = sum(np.array(r.posterior) * r.rate * r.n_tokens for r in got)
    assert np.allclose(totals / totals.sum(), [0.2, 0.4, 0.2, 0.2], atol=1e-4) and all(r.rate >= 0 for r in got)
    rates = mixing.mix(docs, labels, {"en": 1.0})
    assert rates.count() == len(ROWS) and mixing.mixed(docs, rates).columns == docs.columns
    assert mixing.mixed(docs, rates).count() == len(ROWS)
    assert mixing.mix(docs.limit(0), labels, {"en": 1.0}).count() == 0 and mixing.mix(docs, labels.limit(0), {"en": 1.0}).filter("rate = 1").count() == len(ROWS)


def test_rates_are_those_of_a_dense_solve(spark):
    rng = np.random.default_rng(2)
    p = rng.dirichlet(np.ones(3), 60)
    n = rng.integers(1, 400, 60)
    df = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p, strict=True)], "n_tokens long, posterior array<double>")
    targets = np.array([0.6, 0.1, 0.3]) * n.sum()
    out, error = mixing.with_rates(df, targets, steps=400, tolerance=1e-9)
    got = {(r.n_tokens, tuple(r.posterior)): r.rate for r in out.collect()}
    r = np.array([got[int(a), tuple(float(x) for x in b)] for a, b in zip(n, p, strict=True)])
    a, gram = (p * n[:, None]).T, (p * n[:, None]).T @ p
    scale = 1 / np.sqrt(np.diag(gram))
    step = 1 / np.linalg.eigvalsh(scale[:, None] * gram * scale).max()
    dense = np.ones(60)
    for _ in range(20_000):
        dense = np.maximum(0, dense - step * p @ (scale**2 * (a @ dense - targets)))
    assert np.abs(a @ dense - targets).max() < 1e-6 * n.sum() and np.abs(dense - r).max() < 1e-5 and error <= 1e-9 and (r == 0).any()
    unreached, error = mixing.with_rates(spark.createDataFrame([(10, [1.0, 0.0])], "n_tokens long, posterior array<double>"), np.array([5.0, 5.0]))
    assert abs(unreached.first().rate - 0.5) < 1e-6 and abs(error - 0.5) < 1e-6


def test_mixing_learns_one_row_of_an_id(spark):
    df = spark.createDataFrame([(1, f"copy {i} of one id", "en") for i in range(300)] + [(i, f"wort {i}", "de") for i in range(2, 42)], "doc_id long, text string, lang string")
    names, _, _, log_share = mixing.fit(df, df.select("doc_id"), "lang")
    assert names == ["de", "en"] and np.exp(log_share[1]) < 0.1


def test_near(spark, docs):
    rng = random.Random(1)
    base = [[rng.choice("abcdefghij") + str(rng.randint(0, 400)) for _ in range(80)] for _ in range(30)]
    texts = [" ".join(w) for w in base]
    for w in base[:12]:
        for k in range(1, 5):
            texts.append(" ".join([*w[: 10 * k], "changed", *w[10 * k + 1 :]]))
    texts += [" ".join([*base[0][:40], *base[1][:40]]), texts[0], "one two", "one two", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scale = near.scaled_idf(df.select(F.coalesce("text", F.lit("")).alias("text")))
    sets = [near.shingles(t or "") for t in texts]
    group = list(range(len(texts)))
    for _ in range(6):
        for i in group:
            for j in range(len(texts)):
                if near.similarity(sets[i], sets[j], scale) >= 0.8:
                    group[i] = group[j] = min(group[i], group[j])
    got = near.near_groups(df).collect()
    assert {r.doc_id: r.class_id for r in got} == dict(enumerate(group))
    assert sum(r.kept for r in got) == len(set(group)) and all(r.class_size == group.count(r.class_id) for r in got)
    assert near.near_groups(docs).filter("kept").count() == len({x or "" for _, x in ROWS}) and near.near_groups(docs.limit(0)).count() == 0


def test_prefix_filter_loses_no_pair(spark):
    rng = random.Random(5)
    word = lambda: str(rng.randint(0, 99999))
    base = [word() for _ in range(120)]
    texts = []
    for _ in range(25):
        w = list(base)
        for k in rng.sample(range(120), rng.randint(0, 5)):
            w[k] = word()
        texts.append((len(texts), " ".join(w)))
    t = spark.createDataFrame(texts, "node long, text string")
    scale = spark.sparkContext.broadcast(near.scaled_idf(t.select("text")))
    rest = t.select(F.lit(1).cast("long").alias("bucket"), "node", F.col("node").alias("component"))
    got = {(r.a, r.b) for r in near.rarest(rest, t, scale, 0.8).collect()}
    sets = [near.shingles(x) for _, x in texts]
    assert {(i, j) for j in range(25) for i in range(j) if near.similarity(sets[i], sets[j], scale.value) >= 0.8} <= got


def test_warc(spark):
    rng = random.Random(3)
    pages = [(i, "http://x/\r\n", "".join(rng.choice("aé\r\n漢<>0") for _ in range(n))) for i, n in enumerate((0, 5, 99, 100, 4096, 9000, 40000))]
    pages += [(7, None, None), (8, "u", pages[5][2]), (9, "u", pages[1][2]), (None, "u", "p"), (5, "u", pages[5][2])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("value", F.lit(2))
    got = warc.archive(df, segment_bytes=1000).collect()
    assert len(got) == len(pages)
    html = {p: (h or "").encode() for p, _, h in pages}
    for r in got:
        assert r.payload_bytes == len(html[r.page_id]) and r.payload_digest == hashlib.sha256(html[r.page_id]).hexdigest()
        assert (r.record_type, r.refers_to) == (("revisit", 5) if r.page_id == 8 else ("response", None))
        assert r.payload is None or r.payload == html[r.page_id]
    assert warc.archive(df.limit(0)).count() == 0
    for bad in (b"5\r\nabc\r\n0\r\n\r\n", b"zz\r\n"):
        with pytest.raises(ValueError):
            warc.dechunked(bad)


@pytest.mark.parametrize("part", [7, 1 << 20])
def test_archives_of_any_gzip_members(monkeypatch, part):
    monkeypatch.setattr(warc, "PART", part)
    records = [(warc.record("response", "x" * n, X_Page_Id=n) + "\r\n\r\n").encode() for n in (0, 3, 900)]
    for raw in (b"".join(map(gzip.compress, records)), gzip.compress(b"".join(records)), b"".join(records)):
        assert [(h["x-page-id"], len(b)) for h, b in warc.parsed(warc.inflated(raw))] == [("0", 0), ("3", 3), ("900", 900)]
    for bad in (gzip.compress(records[2])[:-9], gzip.compress(records[2][:-6]), records[2][:9], b"HTTP/1.1\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.parsed(warc.inflated(bad)))


def brute_spans(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    find = lambda p: re.finditer(p, t)
    s = [("email", *m.span()) for m in find(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")]
    s += [("ip", *m.span()) for m in find(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)") if all(int(x) <= 255 for x in m[0].split("."))]
    s += [("card", *m.span()) for m in find(r"[0-9]([\x20-]?[0-9])+") if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return s + [("phone", *m.span()) for m in find(r"\+[0-9][\x20().0-9-]+[0-9]") if 8 <= len(digits(m[0])) <= 15]


def test_pii(spark, docs):
    rng = random.Random(6)
    for _ in range(5000):
        t = "".join(rng.choice("1230 45.6-@+()ab.@x 9") for _ in range(rng.randint(1, 40)))
        assert pii.base_spans(t) == brute_spans(t), t
    model = pii.trained()
    assert all((pii.viterbi([x], model)[0] == y).all() for x, y in pii.labelled_rows())
    (base, every), = pii.spans_of(["please write to maria dot lopez at server dot org or a@b.de now"], model)
    assert [s[0] for s in base] == ["email"] and len(every) == 2
    got = pii.find(docs).collect()
    assert len(got) == len(ROWS) and [r.spans for r in got if r.doc_id == 6] == ["email:5:14,ip:34:42,phone:15:32"]
    assert "<email>" in pii.redact(docs).filter("doc_id = 6").first().text and pii.find(docs.limit(0)).count() == 0


def test_pii_returns_every_labelled_span():
    model = pii.trained()
    for line in pii.LABELLED:
        parts = re.split(r"\[(email|ip|card|phone) ((?:[^\[\]]|\[(?:at|dot)\])+)\]", line)
        plain, want = parts[0], []
        for kind, span, after in zip(parts[1::3], parts[2::3], parts[3::3], strict=True):
            want.append((kind, len(plain), len(plain) + len(span)))
            plain += span + after
        assert sorted(pii.spans_of([plain], model)[0][1]) == sorted(want), plain
    for text, kind, span in [("call (415) 555-2671 now", "phone", "(415) 555-2671"), ("call 415-555-2671 now", "phone", "415-555-2671"), ("please write to jane at example.com today", "email", "jane at example.com"), ("mail jane.doe [At] example.com now", "email", "jane.doe [At] example.com")]:
        assert pii.spans_of([text], model)[0][1] == [(kind, text.index(span), text.index(span) + len(span))]
    for text in ("on 2023-05-01 at 12.30", "call 01.05.2023 now", "isbn 978-3-16-148410-0", "look at example.com for more"):
        assert pii.spans_of([text], model)[0][1] == []
    assert all(next(pii.windows(x), None) for x in ("jane at example.com", "jane [At] example", "a {dOT} b")) and not next(pii.windows("look at this"), None)


def test_packing(spark, docs):
    t = Tokenizer.from_file(BPE)
    got = packing.pack(docs, BPE, capacity=64).toPandas().sort_values(["sequence_id", "offset"])
    ends = got.groupby("sequence_id").length.cumsum()
    assert (ends - got.length == got.offset).all() and ends.max() <= 64
    want = sorted((len(ids[k : k + 64]), zlib.crc32(np.array(ids[k : k + 64], "<u4").tobytes())) for _, x in ROWS for ids in [[*t.encode(x or "", add_special_tokens=False).ids, 0]] for k in range(0, len(ids), 64))
    assert sorted(zip(got.length, got.ids_crc32, strict=True)) == want
    assert packing.pack(docs.limit(0), BPE).count() == 0
    rng = random.Random(8)
    for _ in range(50):
        h = collections.Counter(rng.randint(1, 30) for _ in range(rng.randint(1, 40)))
        made = packing.patterns(dict(h), 30)
        used = collections.Counter()
        for lengths, n in made:
            assert sum(lengths) <= 30
            for x in lengths:
                used[x] += n
        assert used == h
        room = rng.randint(1, 40)
        items = list(h.elements())[:10]
        sums = {sum(x for i, x in enumerate(items) if m >> i & 1) for m in range(1 << len(items))}
        assert packing.fullest(collections.Counter(items), room)[1] == max(s for s in sums if s <= room)


@pytest.mark.parametrize("digest", [None, lambda c: F.crc32(c.cast("binary")) % 2])
def test_exact(spark, docs, digest):
    got = exact.exact_groups(docs, digest=digest).collect()
    assert len(got) == len(ROWS)
    for r in got:
        text = next(x or "" for _, x in ROWS if hashlib.sha256((x or "").encode()).hexdigest() == r.text_sha256)
        own = [i for i, x in ROWS if (x or "") == text]
        assert r.group_size == len(own) and r.keep_id == max((i for i in own if i is not None), default=None)
    assert sum(r.kept for r in got) == len({x or "" for _, x in ROWS})
    kept = exact.drop_exact(docs, digest=digest)
    assert kept.columns == docs.columns and kept.count() == len({x or "" for _, x in ROWS})
    assert exact.exact_groups(docs.limit(0)).count() == 0


def test_exact_compares_equal_ids_once(spark):
    timer = threading.Timer(90, spark.sparkContext.cancelAllJobs)  # pairs of such rows would never end
    timer.start()
    try:
        df = spark.range(200_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("").alias("text"))
        assert exact.exact_groups(df).filter("kept and group_size = 200000").count() == 1
    finally:
        timer.cancel()


def test_top_k(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.integers(-3, 3, (120, 3)))]
    rows += [(200, None), (201, [1.0, None, 2.0]), (202, [1.0, float("nan"), 0.0]), (203, [1e30, 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (300, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1)).withColumn("score", F.lit(1))
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect()}
    v = {i: [math.floor(256 * x) for x in e] for i, e in rows[:120]} | {203: [math.floor(256 * 1e30), 0, 0]}
    cap = lambda x: max(-(2**63), min(2**63 - 1, x))
    for q in (0, 50, 100):
        best = sorted(((-sum(a * b for a, b in zip(v[q], e, strict=True)), i) for i, e in v.items() if i != q))[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, cap(-s)) for s, i in best]
    assert len(got) == 15 and topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_of_repeated_ids_and_sizes(spark, monkeypatch):
    monkeypatch.setattr(topk, "TILE_ROWS", 3)  # several tiles for each query block
    monkeypatch.setattr(topk, "QUERY_ROWS", 2)
    rows = [(i % 7, [float(i % 5), float(i)]) for i in range(40)] + [(50, [-(10.0**i), 1.0]) for i in (30, 31)] + [(100 + i, [10.0**i, 0.0]) for i in (20, 21)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, k=4).collect()
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    cap = lambda x: max(-(2**63), min(2**63 - 1, x))
    for q in (0, 50):  # each row of a repeated query id has its scores; the id keeps the best of all
        every = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for i, v in whole if i == q for j, w in whole if j != q)
        assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == [(j, cap(-s)) for s, j in every[:4]]
    for a, b in ((-5, 3), (-(2**80), -(2**79)), (0, 1), (-1, 0), (255, 256), (-256, -255)):
        assert topk.sortable(a) < topk.sortable(b)


def test_near_finds_all_partners_of_stated_queries(spark):
    """Rows with an id divisible by 20 against all rows: every pair of the similarity or more is in one class."""
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    of = {r.doc_id: r.class_id for r in queries.op5_near_dedup(spark, sf).collect()}
    scale = near.scaled_idf(spark.read.parquet(f"{sf}/documents.parquet").select(F.coalesce("text", F.lit("")).alias("text")))
    sets = {i: near.shingles(t) for i, t in texts.items()}
    holders = collections.defaultdict(set)
    for i, (h, _) in sets.items():
        for x in h:
            holders[x].add(i)
    pairs = {(i, j) for i in texts if i % 20 == 0 for x in sets[i][0] for j in holders[x] if j != i}
    similar = [(i, j) for i, j in pairs if near.similarity(sets[i], sets[j], scale) >= near.SIMILARITY]
    assert len(similar) >= 5 and all(of[i] == of[j] for i, j in similar)


def test_hot_texts_and_classes(spark, monkeypatch):
    """Many copies of one text, a large class around one centre, null ids: as without hot keys."""
    monkeypatch.setattr(near, "FEW", 2)
    rng = random.Random(7)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(240)]
    texts = [" ".join(base)] * 40
    for k in range(60):
        w = list(base)
        w[k] = f"x{k}"
        texts.append(" ".join(w))
    rows = [(None if i % 9 == 0 else i, t) for i, t in enumerate(texts)] + [(1000 + i, f"alone {i} " * 9) for i in range(20)]
    got = near.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert len(got) == len(rows) and sorted({r.class_size for r in got}) == [1, 100] and sum(r.kept for r in got) == 21
    # shares of a text's pairs have copies of it
    pairs = spark.createDataFrame([(0, i) for i in range(1, 30)], "a long, b long")
    t = spark.createDataFrame([(i, f"t{i}") for i in range(30)], "node long, text string")
    out = near.beside(near.beside(pairs, pairs, 29, t, "a", "b"), pairs, 29, t, "b", "a").collect()
    assert sorted((r.a, r.b, r.a_text, r.b_text) for r in out) == [(0, i, "t0", f"t{i}") for i in range(1, 30)]


def test_looked_up(spark, monkeypatch):
    from sensorloom.llm import common

    monkeypatch.setattr(common, "HOT", 4)
    rng = random.Random(8)
    rows = [(rng.choice(["a", "a", "a", "b", "c", None]), i) for i in range(100)]
    df = spark.createDataFrame(rows, "k string, hot_ long")
    n = collections.Counter(k for k, _ in rows)
    found = spark.createDataFrame([(k, n[k], k.upper()) for k in "ab"], "k string, n long, v string")
    for how in ("inner", "left"):
        got = common.looked_up(df, found, "k", "n", 100, how).collect()
        assert sorted((r.hot_, r.v) for r in got if r.v) == sorted((i, k.upper()) for k, i in rows if k in ("a", "b"))
        assert len(got) == (100 if how == "left" else n["a"] + n["b"])


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    n = len(pii.LABELS)
    w, t = rng.normal(size=(pii.FEATURES, n)), np.where(pii.ALLOWED, rng.normal(size=(n, n)), -1e9)
    for size in (1, 2, 3, 4):
        x = rng.integers(0, pii.FEATURES, (size, 10))
        e = w[x].sum(axis=1)
        best = max((p for p in itertools.product(range(n), repeat=size) if pii.STARTS[p[0]]), key=lambda p: sum(e[i, y] for i, y in enumerate(p)) + sum(t[a, b] for a, b in zip(p, p[1:], strict=False)))
        assert pii.viterbi([x, x], (w, t))[1].tolist() == list(best)


def test_spelt_addresses_of_any_length():
    assert pii.sensible("email", "a dot " * 200 + "b at example dot org") and pii.sensible("email", "x (at) y [dot] org")
    assert not pii.sensible("email", "dot" * 5000 + " at dot") and not pii.sensible("email", "a at b") and not pii.sensible("email", "data@ dot")


def test_scores_keep_a_table_s_own_columns(spark, docs, labels):
    model = quality.fit(docs, labels)
    with pytest.raises(ValueError):
        quality.scores(docs, model)
    got = quality.scores(docs, model, column="quality_score")
    assert got.drop("quality_score").columns == docs.columns
    by_text = {}
    for r in got.collect():
        assert by_text.setdefault(r.text or "", r.quality_score) == r.quality_score  # null as empty, repeated rows alike


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({c: F.lit("z") for c in ("Score", "kept", "n_tokens", "membership", "copies_")})
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "exact dedup", "near dedup", "mixing", "packing"]

    def through(name, before):
        out = corpus_pipeline.written(stages[name](spark, before, SF), "t")
        assert out.columns == docs.columns and {r.Score for r in out.collect()} == {"z"}
        return out, {r.doc_id: r.text for r in before.collect()}, collections.Counter(r.doc_id for r in out.collect())

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out, texts, left = through("quality classifier", docs)
    vectors, network = quality.fit(docs, labels)
    score = {i: float(network.score(quality.pooled(t or "", vectors)[None].astype(float))[0]) for i, t in texts.items()}
    assert set(left) == {i for i, x in score.items() if x >= quality.THRESHOLD} and set(left.values()) == {1}

    out, texts, left = through("exact dedup", out)
    last = {t: i for i, t in sorted(texts.items())}
    assert set(left) == set(last.values())

    scale = near.scaled_idf(out.select(F.coalesce("text", F.lit("")).alias("text")))
    out, texts, left = through("near dedup", out)
    sets, group = {i: near.shingles(t or "") for i, t in texts.items()}, {i: i for i in texts}
    links = [(i, j) for i in texts for j in texts if i < j and near.similarity(sets[i], sets[j], scale) >= near.SIMILARITY]
    for _ in range(len(links)):
        for i, j in links:
            group[i] = group[j] = min(group[i], group[j])
        if all(group[i] == group[j] for i, j in links):
            break
    assert links and left == collections.Counter(set(group.values()))

    rates = {r.doc_id: r.copies for r in mixing.mix(out, labels, queries.TARGETS).collect()}
    out, texts, left = through("mixing", out)
    assert left == +collections.Counter({i: n for i, n in rates.items()}) and len(set(rates.values())) > 1

    packed = stages["packing"](spark, out, SF).toPandas()
    t = Tokenizer.from_file(BPE)
    want = collections.Counter()
    for r in out.collect():
        n = len(t.encode(r.text or "", add_special_tokens=False).ids) + 1
        want += collections.Counter((r.doc_id, k, min(2048, n - k)) for k in range(0, n, 2048))
    assert collections.Counter(zip(packed.doc_id, packed.start, packed.length, strict=True)) == want
    assert packed.groupby("sequence_id").length.sum().max() <= 2048
