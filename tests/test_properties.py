import math
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.functions import signal
from sensorloom.operators import balance, labels, metrics, splits, windows
from sensorloom.plans import catalog
from sensorloom.sources import sensors
from sensorloom.streaming.labels import labelled_stream


def test_filter_coefficients_and_zero_phase():
    b, a = signal.butter(2, 1.25, 4.0)
    assert np.allclose(b, [0.418163345761899, 0.836326691523798, 0.418163345761899]) and np.allclose(a, [1, 0.462938025291041, 0.209715357756555])
    b1, a1 = signal.butter(1, 0.05, 4.0, high=True)
    assert np.allclose(b1, [0.962195245829104, -0.962195245829104]) and np.allclose(a1, [1, -0.924390491658207])
    x = np.full(50, 3.7)
    assert np.allclose(signal.zero_phase(b, a, x), x) and np.allclose(signal.zero_phase(b1, a1, x), 0)
    rng = np.random.default_rng(1)
    for c, d in ((b, a), (b1, a1)):
        for n in (10, 11, 60, 700):
            y = rng.normal(size=n) + 5
            assert np.allclose(signal.zero_phase(c, d, y), directly(c, d, y), atol=1e-10)
    assert len(signal.zero_phase(b, a, np.ones(9))) == 9


def test_filters_hand_on_their_state():
    """Parts of any lengths, single samples too, give what the whole signal gives."""
    rng = np.random.default_rng(3)
    for b, a in (signal.butter(2, 1.25, 4.0), signal.butter(1, 0.05, 4.0, high=True), signal.butter(2, 0.02, 4.0)):
        c = signal.Carried(b, a)
        for n in (10, 60, 700, 5_000):
            x = rng.normal(size=n) + 5
            for cuts in ([], [1, 2, 3], list(range(1, min(n, 700))), sorted(set(rng.integers(1, n, 7).tolist()))):
                parts = np.split(x, cuts)
                ends = c.scan([c.summary(p) for p in parts])
                assert np.abs(np.concatenate([c.part(p, *e) for p, e in zip(parts, ends, strict=True)]) - signal.zero_phase(b, a, x)).max() < 1e-10
        assert c.scan([c.summary(np.ones(4)), c.summary(np.ones(c.pad - 4))]) is None


def directly(b, a, x):
    """Zero-phase filtering as one linear system: a y = b x from a steady state, forwards and backwards, on the odd extension."""
    pad, k = 3 * len(a), len(a) - 1
    e = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    for _ in range(2):
        full = np.concatenate([np.full(4_000, e[0]), e])  # a constant past
        gain = sum(b) / sum(a)
        y = np.full(len(full), gain * e[0])
        for i in range(k, len(full)):
            y[i] = sum(b[j] * full[i - j] for j in range(k + 1)) - sum(a[j] * y[i - j] for j in range(1, k + 1))
        e = y[4_000:][::-1]
    return e[pad:-pad]


def test_peaks():
    assert signal.peaks(np.array([0, 1, 1, 0, 2, 0, 0.001, 0.0]), 0.01, 1).tolist() == [1, 4]
    assert signal.peaks(np.array([0, 1, 0, 2, 0.0]), 0.01, 4).tolist() == [3]
    rng = random.Random(3)
    for _ in range(300):
        x = np.array([rng.randint(0, 4) / 10 for _ in range(rng.randint(1, 30))])
        tops = []
        for i in range(1, len(x) - 1):
            j = i
            while j < len(x) and x[j] == x[i]:
                j += 1
            if x[i - 1] < x[i] and j < len(x) and x[j] < x[i] and x[i] >= 0.2:
                tops.append((i + j - 1) // 2)
        left = []
        for i in sorted(tops, key=lambda i: (x[i], i), reverse=True):
            if all(abs(i - j) >= 3 for j in left):
                left.append(i)
        assert signal.peaks(x, 0.2, 3).tolist() == sorted(left)


def test_phasic_features_of_any_lengths():
    rng = np.random.default_rng(5)
    windows_ = [np.cumsum(rng.normal(size=n)) for n in (240, 10, 240, 6, 1, 10)] + [np.empty(0)]
    got = signal.phasic_features(windows_)
    b, a = signal.butter(1, 0.05, 4.0, high=True)
    for x, row in zip(windows_[:-1], got, strict=False):
        p = signal.zero_phase(b, a, x)
        t, at = x - p, signal.peaks(p, 0.01, 4)
        up = np.maximum(p, 0)
        slope = np.polyfit(np.arange(len(x)) / 4, t, 1)[0] if len(x) > 1 else 0
        want = [t.mean(), t.std(), slope, p.mean(), p.std(), p.max(), ((up[1:] + up[:-1]) / 2).sum() / 4, len(at), p[at].mean() if len(at) else 0, p[at].max() if len(at) else 0]
        assert np.allclose(row, want, atol=1e-9)
    assert not got[-1].any()


def test_islands_are_components(spark):
    rng, rows = random.Random(2), []
    for pid in range(40):
        for sid in range(rng.randint(1, 8)):
            t0 = float(rng.randint(0, 20))
            rows.append((pid, sid, t0, t0 + rng.randint(1, 6)))
    got = {(r.pid, r.sid): r.gid for r in splits.overlap_groups(spark.createDataFrame(rows, "pid long, sid long, t0 double, t1 double")).collect()}
    for pid in range(40):
        own = [r for r in rows if r[0] == pid]
        group = {r[1]: r[1] for r in own}
        for _ in own:
            for a in own:
                for b in own:
                    if a[2] < b[3] and b[2] < a[3]:
                        group[a[1]] = group[b[1]] = min(group[a[1]], group[b[1]])
        assert all((got[pid, a[1]] == got[pid, b[1]]) == (group[a[1]] == group[b[1]]) for a in own for b in own)


def test_label_bounds_are_inclusive(spark):
    s = spark.createDataFrame([(1, i, float(t)) for i, t in enumerate((0, 2400, 2399, 3600, 7200, 7201))], "pid long, event_id long, t double")
    t = spark.createDataFrame([(1, 3600.0)], "pid long, tag_t double")
    both = {r.t: r.y for r in labels.labelled(s, t, 1200, 3600).collect()}
    assert both == {0: -1, 2400: 1, 2399: -1, 3600: 1, 7200: -1, 7201: 0}
    before = {r.t: r.y for r in labels.labelled(s, t, 1200, 3600, labels.before_only).collect()}
    assert before == {0: -1, 2400: 1, 2399: -1, 3600: 1, 7200: -1, 7201: 0}


@pytest.mark.parametrize("n", [9, 10, 11, 15, 16, 27])
def test_number_of_windows(spark, n):
    s = spark.createDataFrame([(1, 1, i, i / 4, 1.0, 0) for i in range(n)], "pid long, sid long, i long, t double, x double, y int")
    assert windows.windows(s, 5, 1).count() == max(0, (n - 10 - 1) // 5 + 1)


def test_auc(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 9), rng.randint(0, 1)) for _ in range(300)]
    df = spark.createDataFrame(rows, "score int, y int").withColumn("g", F.lit(1))
    a = metrics.auc(df, ["g"]).first().auc
    pairs = [(p > q) + (p == q) / 2 for p, y in rows if y for q, z in rows if not z]
    assert abs(a - sum(pairs) / len(pairs)) < 1e-12
    assert abs(metrics.auc(df.withColumn("score", -F.col("score")), ["g"]).first().auc + a - 1) < 1e-12


def test_smote_points_lie_between(spark):
    rng = np.random.default_rng(3)
    v = {i: rng.normal(size=4).tolist() for i in range(12)}
    out = balance.smote(spark.createDataFrame(list(v.items()), "vec_id long, v array<double>"), 5, 1).collect()
    assert len(out) == 12 and all(np.allclose(np.array(v[r.vec_id]) + r.lam * (np.array(v[r.other]) - v[r.vec_id]), r.v) for r in out)


@pytest.mark.parametrize("group", ["g", None])
def test_neighbours_are_all_of_the_group(spark, monkeypatch, group):
    monkeypatch.setattr(balance, "BLOCK", 16)  # blocks, parts and lists to merge in the hot group
    rng = np.random.default_rng(4)
    rows = [(i, "hot" if i % 5 else f"g{i % 3}", rng.integers(0, 3, 4).astype(float).tolist() if i % 2 else rng.normal(size=4).tolist()) for i in range(300)]
    rows += [(i, "same", [1.0, 2.0, 3.0, 4.0]) for i in range(400, 440)]  # blocks of equal vectors
    other = [(900, "g0", None), (901, "g0", [1.0, None, 2.0, 3.0]), (902, "g0", [float("nan")] * 4), (903, "g1", [1.0, 2.0])]
    got = balance.neighbours(spark.createDataFrame(rows + other, "vec_id long, g string, v array<double>").repartition(3), 5, group=group).collect()
    want = set()
    for i, g, v in rows:
        near = sorted((round(math.dist(v, w), 9), j) for j, h, w in rows if j != i and (not group or g == h))
        want |= {(i, rank, j, d) for rank, (d, j) in enumerate(near[:5], 1)}
    assert len(got) == len(want) and {(r.vec_id, r["rank"], r.other, r.dist) for r in got} == want


def test_a_search_holds_few_matrices():
    rng = np.random.default_rng(5)
    q, c = rng.normal(size=(1_024, 16)), rng.normal(size=(1_024, 16))
    tracemalloc.start()
    row, other, dist = balance.nearest(q, c, (np.arange(3), np.arange(3)), np.arange(1_024), 5)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 3.5 * 1_024 * 1_024 * 8 and len(row) == 5 * 1_024 and not (row == other)[row < 3].any()
    kth = dist.reshape(-1, 5)[:, 4]
    again = balance.nearest(q, c, (np.arange(3), np.arange(3)), np.arange(1_024), 5, kth)  # what is known already hides none that is as near
    assert all((a == b).all() for a, b in zip((row, other, dist), again, strict=True))


def test_every_label_has_neighbours(spark):
    n = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()
    assert catalog.QUERIES["q43b_knn_topk_all"](spark, "/root/testdata/sf0.001").select("vec_id").distinct().count() == n == catalog.QUERIES["q44b_smote_all"](spark, "/root/testdata/sf0.001").count()


def test_sensor_files(spark, tmp_path):
    d = tmp_path / "Part 101C" / "B77aa1_200102-030405"
    d.mkdir(parents=True)
    (d / "EDA.csv").write_text("100.0\n4.0\n" + "\n".join(map(str, range(8))) + "\n")
    (d / "tags.csv").write_text("101.5\n\n103\n")
    (d / "IBI.csv").write_text("100.0, IBI\n1.0,0.8\n2.0,0.3\n3.0,2.0\n4.0,1.9\n")
    e = tmp_path / "Part 102C" / "B1_x"
    e.mkdir(parents=True)
    (e / "tags.csv").write_text("")
    (e / "IBI.csv").write_text("")
    signal_ = sensors.read_signal(spark, str(tmp_path))
    assert [(r.pid, r.i, r.t, r.x) for r in signal_.orderBy("i").collect()][1] == ("P101C", 1, 100.25, 1.0)
    assert [r.tag_t for r in sensors.read_tags(spark, str(tmp_path)).orderBy("tag_t").collect()] == [101.5, 103.0]
    assert [(r.bt, r.rr) for r in sensors.read_beats(spark, str(tmp_path)).orderBy("bt").collect()] == [(101.0, 0.8), (104.0, 1.9)]
    s = sensors.sessions(signal_).first()
    assert (s.device, s.t1, s.n) == ("B77AA1", 102.0, 8)
    (tmp_path / "S2_quest.csv").write_text("# ORDER;Base;TSST;;\n# X;1\n# STAI;1;2;3;4;1;2;\n# STAI;4;4;4;4;4;4;\n")
    assert {r.block: list(r["items"]) for r in sensors.read_questionnaire(spark, f"{tmp_path}/S2_quest.csv").collect()} == {"Base": [0.25, 0.5, 0.75, 1, 0.25, 0.5], "TSST": [1.0] * 6}


def test_labels_on_arrival(spark, tmp_path):
    at = lambda c: F.timestamp_seconds(F.lit(1_000_000) + F.col(c))  # noqa: E731  (a stream takes the first second of 1970 as late)
    s = spark.createDataFrame([(1, t, float(t)) for t in (0, 3000, 3600, 9000, 90000)], "pid long, t long, x double").select("pid", at("t").alias("ts"), "x")
    t = spark.createDataFrame([(1, 3600), (1, 90000)], "pid long, t long").select("pid", at("t").alias("tag_ts"))
    s.write.parquet(f"{tmp_path}/s")
    t.write.parquet(f"{tmp_path}/t")
    out = labelled_stream(spark.readStream.schema(s.schema).parquet(f"{tmp_path}/s"), spark.readStream.schema(t.schema).parquet(f"{tmp_path}/t"), 600, 3600)
    q = out.writeStream.format("memory").queryName("arrived").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.x: r.y for r in spark.table("arrived").collect()}
    got.pop(90000.0, None)  # its buffer has not passed
    assert got == {0.0: -1, 3000.0: 1, 3600.0: 1, 9000.0: 0}
