"""Models, kernels and numbering against NumPy."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sensorloom.functions import signal
from sensorloom.operators import beats, kernels, metrics, models, splits, windows
from sensorloom.plans import protocols


def newton(x, y, weight, c):
    """The minimum of the penalised loss, by plain Newton steps."""
    w, penalty = np.zeros(x.shape[1]), np.append(np.full(x.shape[1] - 1, 1 / c), 0.0)
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ w))
        w = w - np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-12), x.T @ (weight * (p - y)) + penalty * w)
    return w


def scaled(train, rows):
    sd = train.std(axis=0)
    return np.column_stack([(rows - train.mean(axis=0)) / np.where(sd > 0, sd, 1), np.ones(len(rows))])


def rank_auc(score, y):
    won = sum((p > q) + (p == q) / 2 for p in score[y == 1] for q in score[y == 0])
    return won / ((y == 1).sum() * (y == 0).sum())


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"pid": rng.integers(0, 3, 240), "a": rng.normal(size=240), "b": rng.normal(size=240), "c": 1.0})
    pdf["y"] = (pdf.a + 0.5 * pdf.pid + rng.normal(size=240) > 0.5).astype(int)
    pdf["key"], pdf["fold"] = [f"k{i}" for i in range(240)], np.arange(240) % 5
    return pdf


def test_logistic_gradient_is_zero(spark, rows, monkeypatch):
    monkeypatch.setattr(models, "HELD", 1)  # sums are handed on all the time
    z = rows.copy()
    z["x"] = [[float(a), float(b), 1.0] for a, b in zip(z.a, z.b, strict=True)]
    w, history = models.logistic(spark.createDataFrame(z[["pid", "x", "y"]]).withColumn("weight", F.lit(2.0)), ["pid"], 3, 0.7)
    for r in w.collect():
        some = z[z.pid == r.pid]
        assert np.allclose(r.w, newton(np.stack(some.x), some.y.to_numpy(), np.full(len(some), 2.0), 0.7), atol=1e-6)
    losses = history.toPandas().sort_values(["pid", "round"])
    assert (losses.groupby("pid").loss.diff().dropna() <= 1e-9).all()


def test_logistic_cv(spark, rows):
    got = models.logistic_cv(spark.createDataFrame(rows), ["a", "b", "c"]).toPandas()
    want = []
    for _, of in rows.groupby("pid"):
        for fold in range(5):
            train, test = of[of.fold != fold], of[of.fold == fold]
            if train.y.nunique() == test.y.nunique() == 2:
                n = train.y.map(train.y.value_counts())
                w = newton(scaled(train[["a", "b", "c"]].to_numpy(), train[["a", "b", "c"]].to_numpy()), train.y.to_numpy(), (len(train) / (2 * n)).to_numpy(), 0.5)
                want += list(1 / (1 + np.exp(-scaled(train[["a", "b", "c"]].to_numpy(), test[["a", "b", "c"]].to_numpy()) @ w)))
    assert len(got) == len(want) and np.allclose(sorted(got.score), sorted(want), atol=1e-6)


def test_pooled_model(spark, rows):
    rows = rows.assign(split=np.where(np.arange(240) % 3 == 0, "test", "train"))
    scores, history = models.pooled(spark.createDataFrame(rows), ["a", "b"])
    train = rows[rows.split == "train"]
    n = train.y.map(train.y.value_counts())
    x = train[["a", "b"]].to_numpy()
    w = newton(scaled(x, x), train.y.to_numpy(), (len(train) / (2 * n)).to_numpy(), 1.0)
    got = scores.toPandas().set_index("key").score
    assert np.allclose(got[rows.key], 1 / (1 + np.exp(-scaled(x, rows[["a", "b"]].to_numpy()) @ w)), atol=1e-6) and history.count() > 1


def test_label_curve(spark, rows):
    import hashlib

    rows = rows.assign(split=np.where(np.arange(240) % 3 == 0, "test", "train"))
    got = {(r.n_labels, r.repeat): r for r in models.label_curve(spark.createDataFrame(rows), ["a", "b", "c"], [1, 4, 30, 500], 2, seed=3).collect()}
    assert len(got) == 8
    f = ["a", "b", "c"]
    for (n, repeat), r in got.items():
        train, test = rows[rows.split == "train"].copy(), rows[rows.split == "test"]
        train["o"] = [hashlib.md5(f"3:{repeat}:{k}".encode()).hexdigest() for k in train.key]
        train = train.sort_values("o")
        train = pd.concat([train[train.y == 1].head(n // 2), train[train.y == 0].head(n - n // 2)])
        assert r.n_used == len(train)
        if n == 1:
            assert r.auc is None
        else:
            w = newton(scaled(train[f].to_numpy(), train[f].to_numpy()), train.y.to_numpy(), np.ones(len(train)), 1.0)
            assert abs(r.auc - rank_auc(scaled(train[f].to_numpy(), test[f].to_numpy()) @ w, test.y.to_numpy())) < 1e-9


def test_ridge_and_pretext(spark):
    rng = np.random.default_rng(4)
    x, g = rng.normal(size=(90, 4)), np.arange(90) % 2
    y = x @ rng.normal(size=(4, 3)) + rng.normal(size=(90, 3))
    df = spark.createDataFrame([(int(a), b.tolist(), c.tolist()) for a, b, c in zip(g, x, y, strict=True)], "g long, x array<double>, y array<double>")
    for r in models.ridge(df, ["g"], 0.3).collect():
        some = g == r.g
        want = np.linalg.lstsq(np.vstack([x[some], np.sqrt(0.3) * np.eye(4)]), np.vstack([y[some], np.zeros((4, 3))]), rcond=None)[0]
        assert np.allclose(np.array(r.w).reshape(3, 4).T, want)
    w = [(p, s, float(s), rng.normal(size=5).tolist(), rng.normal(size=2).tolist()) for p, n in ((1, 30), (2, 9), (3, 11)) for s in range(n)]
    got = {r.pid: r for r in models.ridge_pretext(spark.createDataFrame(w, "pid long, s long, t_start double, x array<double>, yf array<double>").withColumn("sid", F.lit(0))).collect()}
    assert set(got) == {1, 3}
    for pid, r in got.items():
        own = [v for v in w if v[0] == pid]
        n = len(own) - len(own) // 10
        x, y = np.array([v[3] for v in own]), np.array([v[4] for v in own])
        mean, sd = x[:n].mean(), x[:n].std()
        x, y = np.column_stack([(x - mean) / sd, np.ones(len(x))]), (y - mean) / sd
        b = np.linalg.solve(x[:n].T @ x[:n] + np.eye(6), x[:n].T @ y[:n])
        assert (r.n_train, r.n_val) == (n, len(own) - n) and abs(r.rmse - np.sqrt(np.mean((x[n:] @ b - y[n:]) ** 2))) < 1e-9


@pytest.mark.parametrize("part", [kernels.PART, 11, 64])
def test_lowpass(spark, part):
    rng = np.random.default_rng(6)
    xs = {(1, 1): rng.normal(size=40), (1, 2): rng.normal(size=7), (2, 1): rng.normal(size=300), (None, 3): rng.normal(size=25)}
    df = spark.createDataFrame([(p, s, i, float(v)) for (p, s), x in xs.items() for i, v in enumerate(x)], "pid long, sid long, i long, x double").orderBy(F.desc("x"))
    got = kernels.lowpass(df, part=part).toPandas().sort_values("i")
    assert len(got) == sum(map(len, xs.values())) and not kernels.lowpass(df.limit(0), part=part).count()
    for (p, s), x in xs.items():
        own = got[(got.pid.isna() if p is None else got.pid == p) & (got.sid == s)]
        assert np.allclose(own.x, x) and np.allclose(own.smooth, signal.zero_phase(*signal.butter(2, 1.25, 4.0), x), atol=1e-10)


def test_26_features(spark):
    rng = np.random.default_rng(8)
    xs = np.cumsum(rng.normal(size=(5, 40)), axis=1)
    got = protocols.features_26(spark.createDataFrame([(1, 0, i, x.tolist()) for i, x in enumerate(xs)], "pid long, sid long, s long, x array<double>")).toPandas().sort_values("s")
    assert len(got.columns) == 29
    for x, (_, r) in zip(xs, got.iterrows(), strict=True):
        c, d1, d2 = x - x.mean(), np.diff(x), np.diff(x, 2)
        want = {"mean": x.mean(), "std": x.std(), "min": x.min(), "max": x.max(), "range": np.ptp(x), "median": np.median(x), "p25": np.percentile(x, 25), "p75": np.percentile(x, 75), "skew": (c**3).mean() / (c**2).mean() ** 1.5, "kurt": (c**4).mean() / (c**2).mean() ** 2 - 3}
        want |= {"slope": np.polyfit(np.arange(40) / 4, x, 1)[0], "d1_mean": d1.mean(), "d1_std": d1.std(), "d1_abs": np.abs(d1).mean(), "d2_mean": d2.mean(), "d2_std": d2.std()}
        want |= dict(zip(kernels.PHASIC, signal.phasic_features([x])[0], strict=True))
        assert len(want) == 26 and all(abs(r[k] - v) < 1e-8 for k, v in want.items())


def test_tachogram(spark):
    rng = random.Random(9)
    grid = [(p, s, i, round(rng.uniform(0, 50), 2)) for p in (1, 2) for s in (1, 2) for i in range(40)]
    rr = sorted({(p, s, round(rng.uniform(5, 45), 2)) for p in (1, 2) for s in (1, 2) for _ in range(15) if (p, s) != (2, 2)} | {(1, 1, grid[0][3])})
    rr = [(*b, rng.uniform(0.4, 1.5)) for b in rr]
    out = beats.tachogram(spark.createDataFrame(grid, "pid long, sid long, i long, t double"), spark.createDataFrame(rr, "pid long, sid long, bt double, rr double")).collect()
    assert len(out) == len(grid)
    for r in out:
        own = [(b[2], b[3]) for b in rr if b[:2] == (r.pid, r.sid)]
        assert r.below == sum(t < r.t for t, _ in own)
        assert r.rr is None if not own else abs(r.rr - np.interp(r.t, *zip(*own, strict=True))) < 1e-9


def test_numbered_and_first_rows(spark):
    rng = random.Random(10)
    keys = [rng.randint(-50, 50) for _ in range(700)] + [None, None]
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i long").repartition(5)
    got = sorted(((r.n, r.k) for r in splits.numbered(df, "k", "n").collect()))
    assert [n for n, _ in got] == list(range(702)) and [k for _, k in got] == [*sorted(keys[:-2]), None, None]
    assert splits.numbered(df.limit(0), "k", "n").count() == 0
    first = splits.first_rows(df.withColumn("g", F.col("i") % 3), ["g"], [F.desc("k"), F.col("i")], 4, ["i"]).collect()
    for g in range(3):
        own = sorted(((-k, i) for i, k in enumerate(keys[:-2]) if i % 3 == g))[:4]
        assert sorted(r.i for r in first if r.g == g) == sorted(i for _, i in own)


def test_auc_of_any_scores(spark):
    rng = random.Random(11)
    s = [rng.choice([0.0, -0.0, 1e-310, -1e-310, 1e300, -1e300, 0.5, 0.50001, -2.0, 3.0]) * rng.choice([1, 1, 1.0000001]) for _ in range(200)]
    y = [rng.randint(0, 1) for _ in s]
    got = metrics.auc(spark.createDataFrame(list(zip(s, y, strict=True)), "score double, y int"), []).first()
    assert abs(got.auc - rank_auc(np.array(s), np.array(y))) < 1e-12
    assert metrics.auc(spark.createDataFrame([(1.0, 1)], "score double, y int"), []).first().auc is None


def test_guarded_split(spark):
    rng, rows = random.Random(12), []
    for pid in range(60):
        n = rng.randint(1, 9)
        share = rng.choice([0, 0.2, 0.6])
        rows += [(pid, g, float(g), rng.randint(1, 5), rng.random() < share) for g in range(n)]
    got = {(r.pid, r.gid): r.split for r in splits.guarded_split(spark.createDataFrame(rows, "pid long, gid long, t0 double, weight long, stress boolean")).collect()}
    for pid in range(60):
        own = [r for r in rows if r[0] == pid]
        test, held = [], 0
        for r in reversed(own):
            if held >= 0.2 * sum(x[3] for x in own):
                break
            test.append(r)
            held += r[3]
        if any(r[4] for r in own):
            while not any(r[4] for r in test):
                test.append([r for r in own if r not in test][-1])
            while not any(r[4] for r in own if r not in test):
                test.remove(min(test))
        assert {r[1] for r in test} == {g for p, g in got if p == pid and got[p, g] == "test"}


def test_leaks_are_found(spark):
    rows = [(1, 1, 1, 0.0, "train"), (1, 2, 1, 5.0, "test"), (2, 3, 2, 9.0, "train"), (2, 4, 3, 8.0, "test"), (3, 5, 4, 1.0, None), (4, 6, 5, 1.0, "train"), (4, 6, 5, 2.0, "test"), (5, 7, 6, 1.0, "train"), (5, 8, 7, 2.0, "test")]
    got = splits.leaks(spark.createDataFrame(rows, "pid long, sid long, gid long, t0 double, split string")).collect()
    assert sorted((r.pid, r.leak) for r in got) == [(1, "group on both sides"), (2, "training after test"), (3, "no split"), (4, "group on both sides"), (4, "recording on both sides")]


def test_blocks_and_coverage(spark):
    rng = random.Random(13)
    blocks = {(s, i): rng.choice([1, 2, None, None]) for s in (1, 2) for i in range(60)}
    rows = [(s, i, float(i), b) for (s, i), b in blocks.items()]
    df = spark.createDataFrame(rows, "subject long, i long, x double, block int")
    starts = windows.block_windows(df.filter("block is not null"), 7, 2, 3, {1: 5})
    got, want = {(r.subject, r.block, r.start) for r in starts.collect()}, set()
    for s in (1, 2):
        for b in (1, 2):
            at = [i for (t, i), c in blocks.items() if t == s and c == b]
            want |= {(s, b, a) for a in list(range(min(at), max(at) + 1 - 7 - 2, 3))[: 5 if b == 1 else None]}
    assert got == want
    inside = {(r.subject, r.i) for r in windows.covered(df, starts.filter("start % 2 = 0"), 7).collect()}
    assert inside == {(s, i) for s, _, a in want if a % 2 == 0 for i in range(a, a + 7)}


def test_horizon_is_a_step_at_most(spark):
    with pytest.raises(ValueError):
        windows.windows(spark.createDataFrame([], "pid long, sid long, i long, t double, x double, y int"), 5, 6)


def test_a_days_labels_are_linear(spark):
    from threading import Timer

    from sensorloom.operators import labels

    timer = Timer(40, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:  # a day at 4 Hz of one participant
        s = spark.range(345_600).select(F.lit(1).alias("pid"), (F.col("id") / 4).alias("t"))
        t = spark.createDataFrame([(1, float(x)) for x in range(5_000, 80_000, 9_000)], "pid int, tag_t double")
        got = labels.labelled(s, t, 1200, 3600).groupBy("y").count().collect()
    finally:
        timer.cancel()
    t, tags = np.arange(345_600) / 4, np.arange(5_000, 80_000, 9_000.0)
    d = np.abs(t[:, None] - tags).min(axis=1)
    assert {r.y: r["count"] for r in got} == {1: (d <= 1200).sum(), -1: ((d > 1200) & (d <= 3600)).sum(), 0: (d > 3600).sum()}
