"""Repeated tags, overlapping recordings, gathered windows, exact quantiles and places, against plain loops."""

import random

import numpy as np
import pandas as pd
import pytest
from oracle import same
from pyspark.sql import functions as F

from sensorloom.functions import signal
from sensorloom.operators import beats, features, labels, metrics, models, splits, windows
from sensorloom.plans import catalog, protocols

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("tags", [[1_000.0], [1_000.0] * 2, [1_000.0] * 3 + [50_000.0], [1_000.0, 50_000.0, 50_000.0], [1_000.0, 3_000.0, 3_000.0, 200_000.0], []])
@pytest.mark.parametrize("few", [labels.FEW_TAGS, 0])
def test_labels_do_not_hang_on_repeats(spark, tags, few):
    times = [float(t) for t in range(0, 260_000, 1_700)] + [1_000.0, 50_000.0]
    s = spark.createDataFrame([(1, 7, t, "own", "z") for t in times], "pid long, sid long, t double, bucket string, tag_kind string")
    t = spark.createDataFrame([(1, x) for x in tags], "pid long, tag_t double")
    near, buffer = 2_000, 6_000
    for rule, ahead in ((labels.two_sided, False), (labels.before_only, True)):
        got = labels.labelled(s, t, near, buffer, rule, few).collect()
        assert {r.bucket for r in got} == {"own"} and {r.tag_kind for r in got} == {"z"} and len(got) == len(times)
        for r in got:
            d = [x - r.t for x in tags]
            one = any(0 <= x <= near for x in d) if ahead else any(abs(x) <= near for x in d)
            assert r.y == (1 if one else -1 if any(abs(x) <= buffer for x in d) else 0), (rule, r.t)
    ses = spark.createDataFrame([(1, 7, 0.0, 201_000.0)], "pid long, sid long, t0 double, t1 double")
    got = labels.interval_labels(s, t.withColumn("sid", F.lit(7).cast("long")), ses, near, few).collect()
    for r in got:
        kinds = {x - near >= 0 and x + near <= 201_000 for x in tags if abs(x - r.t) <= near}
        assert r.y == (1 if True in kinds else -1 if kinds else 0)


def test_broadcast_tags_and_buckets_agree(spark, monkeypatch):
    """Both plans give the same on random tags, null keys and times; samples are shuffled in one of them only."""
    rng = random.Random(9)
    some = lambda n, null: [(rng.choice([1, 2, None]), None if rng.random() < null else float(rng.randint(-3_000, 9_000))) for _ in range(n)]
    s = spark.createDataFrame([(*r, n) for n, r in enumerate(some(600, 0.05))], "pid long, t double, n long")
    t = spark.createDataFrame([(*r, rng.choice("ab")) for r in some(40, 0.1)], "pid long, tag_t double, kind string")
    for radius, kinds in ((0.0, ()), (1.0, ("a", "b")), (700.0, ()), (700.0, ("b", "a", "none"))):
        plans = [labels.near_tags(s, t, radius, 1_000.0, kinds=kinds, few=few) for few in (100, 0)]
        few, many = (sorted(map(tuple, p.collect()), key=lambda r: r[2]) for p in plans)
        assert few == many and len(few) == 600
        assert ["BroadcastHashJoin" in p._jdf.queryExecution().executedPlan().toString() for p in plans] == [True, False]
    assert labels.stretches(t.selectExpr("pid", "tag_t as t", "kind as __kind"), 700.0, 700.0, ("pid",), ("a", "b"), 39) is None
    monkeypatch.setattr(labels, "FEW_IN_BUCKET", 2)
    assert "Broadcast" not in labels.near_tags(s, t, 700.0, 1_000.0)._jdf.queryExecution().executedPlan().toString()


def two_sessions(spark, seed=1):
    rng = random.Random(seed)
    rows = [(p, sid, i, 1_000.0 * p + i / 4 + sid / 8, rng.random() * 4 + 10 * sid + 1, 0 if i < 60 else 1) for p in (1, 2) for sid in (0, 1) for i in range(100)]
    hearts = [(p, sid, 1_000.0 * p + k * 0.8 + sid * 0.3, 0.6 + rng.random() / 2) for p in (1, 2) for sid in (0, 1) for k in range(40)]
    return rows, hearts, spark.createDataFrame(rows, "pid long, sid long, i long, t double, x double, y int"), spark.createDataFrame(hearts, "pid long, sid long, bt double, rr double")


def test_windows_of_two_recordings_stay_apart(spark):
    rows, hearts, s, b = two_sessions(spark)
    w = windows.windows(s, 20)
    got = {(r.pid, r.sid, r.s): r.n for r in beats.beats_in(w, b, 10.0).groupBy("pid", "sid", "s").agg(F.count("bt").alias("n")).collect()}
    of = {(r.pid, r.sid, r.s): r for r in protocols.features_26(w).collect()}
    assert len(got) == len(of) == 16
    for (p, sid, at), n in got.items():
        x = np.array([r[4] for r in rows if r[:2] == (p, sid)])[at : at + 40]
        start = 1_000.0 * p + at / 4 + sid / 8
        assert n == sum(h[:2] == (p, sid) and start <= h[2] < start + 10 for h in hearts) and abs(of[p, sid, at]["mean"] - x.mean()) < 1e-9 and abs(of[p, sid, at]["max"] - x.max()) < 1e-12


def test_eda_hrv_table(spark):
    rows, hearts, s, b = two_sessions(spark, 3)
    got = features.eda_hrv(s, b, 10, 5.0, 2.0).toPandas().set_index(["pid", "sid", "s"]).sort_index()
    want, hb, ha = [], *signal.butter(1, 0.05, 4.0, high=True)
    for p in (1, 2):
        for sid in (0, 1):
            x = np.array([r[4] for r in rows if r[:2] == (p, sid)])
            z = (x - x.mean()) / (x.std() + 1e-8)
            for at in range(0, 81, 10):
                y = {r[5] for r in rows if r[:2] == (p, sid) and at <= r[2] < at + 20}
                start = 1_000.0 * p + at / 4 + sid / 8
                rr = np.array([h[3] for h in hearts if h[:2] == (p, sid) and start <= h[2] < start + 5])
                if len(y) > 1 or x[at : at + 20].mean() < 2 or len(rr) < 2:
                    continue
                seg, raw, d = z[at : at + 20], x[at : at + 20], np.diff(rr)
                phasic = signal.zero_phase(hb, ha, raw)
                top = phasic[signal.peaks(phasic, 0.01, 4)]
                t = np.arange(20) / 4
                want.append((p, sid, at, start, seg.mean(), seg.std(), np.ptp(seg), np.polyfit(t, seg, 1)[0], np.abs(np.diff(seg)).mean(), len(top), top.mean() if len(top) else 0, top.max() if len(top) else 0, phasic.std(), np.polyfit(t, raw - phasic, 1)[0], len(rr), rr.mean(), rr.std(), np.sqrt((d**2).mean()), (np.abs(d) > 0.05).mean(), 60 / rr.mean()))
    eda = ["eda_mean", "eda_std", "eda_range", "eda_slope", "eda_absdiff", "eda_scr_count", "eda_scr_amp_mean", "eda_scr_amp_max", "eda_phasic_std", "eda_tonic_slope"]
    hrv = list(features.HRV.values())
    want = pd.DataFrame(want, columns=["pid", "sid", "s", "t_start", *eda, *hrv])
    want[hrv] = want.groupby(["pid", "sid"])[hrv].transform(lambda c: (c - c.mean()) / (c.std() + 1e-8))
    want = want.sort_values(["pid", "t_start", "sid", "s"])
    want["fold"] = want.groupby("pid").cumcount() * 5 // want.groupby("pid")["s"].transform("size")
    want = want.set_index(["pid", "sid", "s"]).sort_index()
    assert len(got) == len(want) > 20 and np.allclose(got[[*eda, *hrv, "fold"]].to_numpy(float), want[[*eda, *hrv, "fold"]].to_numpy(float), atol=1e-6, equal_nan=True)


@pytest.mark.parametrize("width,step,chunk", [(70, 1, None), (7, 3, 16), (1, 1, None)])
def test_gathered_windows_are_slices(spark, width, step, chunk):
    rng = np.random.default_rng(4)
    x = {p: rng.normal(size=n) for p, n in (("a", 300), ("b", width), ("c", max(width - 1, 1) if width > 1 else 1))}
    gap = {("a", 150)}  # a missing sample
    s = spark.createDataFrame([(p, i, float(v), float(-v)) for p, of in x.items() for i, v in enumerate(of) if (p, i) not in gap], "subject string, i long, x double, z double").repartition(5)
    starts = [(p, k, 0) for p, of in x.items() for k in range(-3, len(of) + 3, step)] + [("a", 5, 1), ("d", 0, 0)]
    got = windows.gathered(s, spark.createDataFrame(starts, "subject string, start long, tag int"), width, ("x", "z"), chunk=chunk).collect()
    fits = [(p, k, t) for p, k, t in starts if p in x and 0 <= k <= len(x[p]) - width and not any(p == q and k <= i < k + width for q, i in gap)]
    assert sorted((r.subject, r.start, r.tag) for r in got) == sorted(fits)
    assert all(r.x == x[r.subject][r.start : r.start + width].tolist() and r.z == [-v for v in r.x] for r in got)


def test_between_marks(spark):
    marks = spark.createDataFrame([(1, 0, 40), (1, 0, 41), (1, 0, 90)], "pid long, sid long, i long")
    ends = spark.createDataFrame([(1, 0, 100), (2, 0, 12)], "pid long, sid long, n long")
    assert sorted(map(tuple, windows.between_marks(marks, ends, 5, 2).collect())) == [(1, 0, 5, 35), (1, 0, 46, 85), (2, 0, 5, 7)]


@pytest.mark.parametrize("keys", [["g"], []])
def test_quantiles_are_those_of_sorted_values(spark, keys):
    rng = np.random.default_rng(5)
    v = {"a": rng.normal(size=500), "b": np.repeat([3.0, -1.0], [70, 31]), "c": np.array([2.5]), None: np.array([0.0, -0.0, 1e300, -1e-300])}
    rows = [(g, float(x)) for g, of in v.items() for x in of] + [("a", None), ("only", None)]
    got = metrics.quantiles(spark.createDataFrame(rows, "g string, v double"), keys, "v", {"low": 0.1, "mid": 0.5, "top": 1.0, "first": 0.0}).collect()
    of = v if keys else {0: np.concatenate(list(v.values()))}
    assert len(got) == len(of)
    for r in got:
        x = of[r.g if keys else 0]
        assert np.allclose([r.low, r.mid, r.top, r.first], np.quantile(x, [0.1, 0.5, 1, 0]), rtol=1e-12)


def test_places_by_time(spark):
    rng = random.Random(6)
    rows = [(k % 2, rng.choice([None, rng.random() * 1e6 - 3e5]), k) for k in range(200)]
    got = splits.placed_by_time(spark.createDataFrame(rows, "g long, t double, k long"), ["g"], "t", "k", bucket=10_000.0).collect()
    for g in (0, 1):
        want = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0.0, r[2]))
        assert [r.k for r in sorted((r for r in got if r.g == g), key=lambda r: r.place)] == [r[2] for r in want] and {r.places for r in got if r.g == g} == {len(want)}


def test_auc_leaves_out_rows_without_a_label(spark):
    rows = spark.createDataFrame([("a", 0.1, 0), ("a", 0.9, 1), ("a", 0.5, None), ("a", None, 1), ("a", 0.9, 0)], "g string, score double, y int")
    assert tuple(metrics.auc(rows, ["g"]).first()) == ("a", 3, 1, 0.75)


def test_no_group_is_sorted_whole_for_weights_and_tails(spark):
    rows = spark.range(100).select((F.col("id") % 2).alias("pid"), F.lit(0).alias("fold"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    got = models.balanced(rows, ["pid", "fold"])
    assert "Window [count" not in got._jdf.queryExecution().toString() and abs(got.filter("y = 1 and pid = 0").first().weight - 50 / (2 * 17)) < 1e-12


def many_tags(monkeypatch):
    """Labels as they are found when there are too many tags to broadcast."""
    found = labels.labelled
    monkeypatch.setattr(labels, "labelled", lambda *a, **k: found(*a, **k | {"few": 0}))


def test_encoders_of_signal_and_heart_with_many_tags(spark, monkeypatch):
    many_tags(monkeypatch)
    assert catalog.QUERIES["q101_conv_fusion"](spark, SF).count() > 0


def test_two_signals_with_many_tags(spark, monkeypatch):
    many_tags(monkeypatch)
    same(spark, SF, catalog.QUERIES["q54_multimodal_windows"], catalog.ORACLE["q54_multimodal_windows"])


def test_two_signals_with_few_tags_and_many_stretches(spark, monkeypatch):
    # few enough to be counted as such, but what lies between them is too much to broadcast
    monkeypatch.setattr(labels, "FEW_STRETCHES", 0)
    same(spark, SF, catalog.QUERIES["q54_multimodal_windows"], catalog.ORACLE["q54_multimodal_windows"])


def test_what_rounds_to_zero_keeps_its_sign(spark, tmp_path):
    # the sample ahead is a little below the mean, so its z rounds to minus zero
    events = spark.range(11).select(F.col("id").alias("event_id"), F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(cast(id as int))").alias("ts"), F.lit(7).cast("long").alias("user_id"), F.lit("view").alias("event_type"), F.when(F.col("id") == 10, 99.9999).otherwise(F.when(F.col("id") % 2 == 0, 50.0).otherwise(150.0)).alias("value"), F.lit("{}").alias("props"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    same(spark, str(tmp_path), catalog.QUERIES["q53_zscored_windows"], catalog.ORACLE["q53_zscored_windows"])
    assert str(catalog.QUERIES["q53_zscored_windows"](spark, str(tmp_path)).first().ahead) == "-0.0"


def at_the_bound(spark, path):
    """Events of users whose first ten values have a mean of 40: one by one they add up to a bit less for user 1 and a bit more for user 2, by fives to 400 for user 1 and a bit less for user 2."""
    of = {
        1: [42.5, 38.1, 53.7, 13.1, 12.7, 71.6, 61.0, 60.4, 43.5, 3.4, 9.0],
        2: [14.8, 7.6, 42.7, 20.5, 34.3, 78.1, 71.1, 56.1, 39.8, 35.0, 9.0],
        3: [40.5, 39.5, 30.0, 50.0, 40.0, 45.0, 35.0, 40.0, 60.0, 20.0, 9.0],
    }
    rows = [(100 * u + k, u, k, x) for u, v in of.items() for k, x in enumerate(v)]
    ts = F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 4 * k, k * k)")
    events = spark.createDataFrame(rows, "event_id long, user_id long, k int, value double").select("event_id", ts.alias("ts"), "user_id", F.lit("view").alias("event_type"), "value", F.lit("{}").alias("props"))
    events.coalesce(1).write.parquet(f"{path}/events.parquet")


def test_a_mean_at_the_bound_is_of_samples_in_their_order(spark, tmp_path):
    at_the_bound(spark, tmp_path)
    for name in ("q53_zscored_windows", "q57_windows_offbody_count", "q05_window_offbody_filter"):
        same(spark, str(tmp_path), catalog.QUERIES[name], catalog.ORACLE[name])
    assert sorted(r.pid for r in catalog.QUERIES["q53_zscored_windows"](spark, str(tmp_path)).collect()) == [2, 3]


@pytest.mark.parametrize("many", [False, True])
def test_two_signals_of_windows_with_a_mean_at_the_bound(spark, tmp_path, monkeypatch, many):
    if many:
        many_tags(monkeypatch)
    at_the_bound(spark, tmp_path)
    same(spark, str(tmp_path), catalog.QUERIES["q54_multimodal_windows"], catalog.ORACLE["q54_multimodal_windows"])
    assert sorted(r.pid for r in catalog.QUERIES["q54_multimodal_windows"](spark, str(tmp_path)).collect()) == [2, 3]
