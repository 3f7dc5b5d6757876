"""Operator 9's state over several calls; operator 7's spans in very long texts; operator 5's recall on a larger table."""

import hashlib
import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from sensorloom.llm import exact, near, pii


def brute_groups(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def check_groups(got, rows):
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == brute_groups(rows)
    kept = [(r.doc_id, r.text_sha256) for r in got if r.kept]
    assert len(kept) == len({t or "" for _, t in rows}) and all(r.doc_id == r.keep_id for r in got if r.kept)


@pytest.mark.parametrize("digest", [None, lambda c: F.length(c) % 3])
def test_exact_state_goes_on_with_later_calls(spark, tmp_path, digest):
    calls = [
        [(1, "a"), (2, "b"), (9, "only here"), (None, None)],
        [(3, "a"), (0, "b"), (5, ""), (2, "b"), (7, "new")],  # repeats texts of the first, with larger and smaller ids
        [],
        [(4, "a"), (4, "a"), (8, "new"), (None, "only here")],
    ]
    seen = []
    for rows in calls:
        seen += rows
        df = spark.newSession().createDataFrame(rows, "doc_id long, text string").withColumn("batch", F.lit("z"))
        check_groups(exact.exact_groups(df, digest=digest, store=f"file://{tmp_path}/store").collect(), seen)
    states = sum(1 for _ in (tmp_path / "store" / "state" / "commits").glob("[0-9]*"))
    assert states >= 3  # one micro-batch at least for each call with rows, in one state


def test_new_spans_touch_no_other():
    rng = random.Random(2)
    for _ in range(500):
        base = [("ip", a, a + rng.randint(1, 6)) for a in rng.sample(range(60), 6)]
        taken, all_of = pii.Taken(base), [s[1:] for s in base]
        for a in sorted(rng.sample(range(60), 20)):
            b = a + rng.randint(1, 5)
            free = not any(s < b and a < e for s, e in all_of)
            assert taken.free(a, b) == free
            all_of += [(a, b)] * free


def test_many_spans_take_linear_time():
    model, took = pii.trained(), []
    for n in (1_000, 8_000):
        began = time.perf_counter()
        (_, spans), = pii.spans_of(["call 030 1234 5678 now or " * n], model)
        took.append(time.perf_counter() - began)
        assert len(spans) == n
    assert took[1] < 24 * took[0]


def test_near_recall_by_brute_force(spark):
    """Ids divisible by 20 against all of sf0.1: candidates by common shingles, then the similarity itself."""
    sf = "/root/testdata/sf0.1/documents.parquet"
    docs = spark.read.parquet(sf)
    classes = {r.doc_id: r.class_id for r in near.near_groups(docs).collect()}
    scale = near.scaled_idf(docs.select("text"))
    texts = dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{sf}'").fetchall())
    sets, holders = {i: near.shingles(t) for i, t in texts.items()}, {}
    for i, (h, _) in sets.items():
        for x in h.tolist():
            holders.setdefault(x, []).append(i)
    pairs = 0
    for q in (i for i in texts if i % 20 == 0):
        common = {}
        for x in sets[q][0].tolist():
            if len(holders[x]) < 3_000:
                for i in holders[x]:
                    common[i] = common.get(i, 0) + 1
        for i, n in common.items():
            if i != q and n >= 0.4 * len(sets[q][0]) and near.similarity(sets[q], sets[i], scale) >= 0.8:
                pairs += 1
                assert classes[q] == classes[i], (q, i)
    assert pairs > 200
