"""Scans in two levels against loops and NumPy, at bucket widths from one row to everything, and recordings as arrays."""

import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sensorloom.operators import beats, scans, splits
from sensorloom.plans import catalog
from sensorloom.sources import recordings, sensors

WIDTHS = [0.5, 7.0, 1e9]


@pytest.mark.parametrize("width", WIDTHS)
@pytest.mark.parametrize("down", [False, True])
def test_running_values(spark, width, down):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([None, rng.randint(-60, 60) / 2]), k, rng.choice([None, rng.randint(-9, 9)])) for k in range(250)]
    order = [F.col("t").desc_nulls_last() if down else F.col("t").asc_nulls_first(), F.col("k")]
    got = scans.running(spark.createDataFrame(rows, "g string, t double, k long, v long").repartition(5), ["g"], "t", width, order, {"s": F.col("v")}, {"m": F.col("v")}, down).collect()
    assert len(got) == len(rows)
    of = {r.k: (r.s, r.s_all, r.m) for r in got}
    for g in ("hot", "b", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: ((r[1] is None) == down, (-1 if down else 1) * (r[1] or 0.0), r[2]))
        total, s, m = sum(r[3] or 0 for r in own), 0, None
        for r in own:
            assert of[r[2]] == (s, total, m)
            s, m = s + (r[3] or 0), r[3] if m is None else m if r[3] is None else max(m, r[3])


@pytest.mark.parametrize("width,few", [*[(w, 0) for w in WIDTHS], (7.0, 100_000)])
def test_groups_splits_and_folds_at_any_width(spark, width, few):
    rng, rows = random.Random(2), []
    for pid in (1, 1, 1, 2, None):
        for _ in range(40):
            t0 = float(rng.randint(0, 300))
            rows.append((pid, len(rows), t0, t0 + rng.randint(0, 6), rng.randint(1, 9)))
    df = spark.createDataFrame(rows, "pid long, sid long, t0 double, t1 double, weight long")
    got = {r.sid: r.gid for r in splits.overlap_groups(df, width, few).collect()}
    flat = df.withColumn("gid", F.col("sid"))
    split = {r.gid: r.split for r in splits.chrono_split(flat, 0.2, width, few).collect()}
    fold = {r.gid: r.fold for r in splits.group_folds(flat, 5, width, few).collect()}
    place = {r.sid: r.fold for r in splits.window_folds(df, 5, "t0", "sid", bucket=width).collect()}
    assert len(got) == len(split) == len(fold) == len(place) == len(rows)
    for pid in (1, 2, None):
        own = sorted((r for r in rows if r[0] == pid), key=lambda r: (r[2], r[3], r[1]))
        reach, gid = None, -1
        for r in own:
            gid += reach is None or r[2] >= reach
            reach = r[3] if reach is None else max(reach, r[3])
            assert got[r[1]] == gid
        own.sort(key=lambda r: (r[2], r[1]))
        total, run = sum(r[4] for r in own), 0
        for n, r in enumerate(own):
            run += r[4]
            assert fold[r[1]] == max(0, -(-run * 5 // total) - 1) and place[r[1]] == n * 5 // len(own)
            assert split[r[1]] == ("test" if total - run < 0.2 * total else "train")


@pytest.mark.parametrize("width", [0.5, 90.0, 1e9])
def test_interpolation_over_gaps_of_days(spark, width):
    rng = np.random.default_rng(3)
    beat = {0: np.sort(np.concatenate([rng.random(40) * 100, 4e5 + rng.random(30) * 50, [12.25, 30.0]])), 1: np.array([50.0]), 2: np.array([])}
    rr = {s: rng.random(len(b)) + 0.3 for s, b in beat.items()}
    at = np.concatenate([np.arange(-20, 120, 0.75), [12.25, 30.0, 2e5, 3.9e5], 4e5 + np.arange(-5, 60, 2.5), [9e5]])
    samples = spark.createDataFrame([(1, s, float(t)) for s in beat for t in at], "pid long, sid long, t double").repartition(6)
    pulses = spark.createDataFrame([(1, s, float(t), float(v)) for s in beat for t, v in zip(beat[s], rr[s], strict=True)], "pid long, sid long, bt double, rr double")
    got = beats.tachogram(samples, pulses, width).collect()
    assert len(got) == len(at) * 3
    for r in got:
        b = beat[r.sid]
        assert r.below == (np.round(b * 1e6) < np.round(r.t * 1e6)).sum()
        assert r.rr is None if not len(b) else abs(r.rr - np.interp(r.t, b, rr[r.sid])) < 1e-9


def test_a_hot_group_is_many_tasks_work(spark):
    rows = spark.range(40_000).select(F.floor(F.col("id") / 50_000).alias("pid"), F.col("id").alias("s"))
    found = splits.window_folds(rows, 5, "s", bucket=1_000)
    # rows are dealt by participant and bucket, never by participant alone
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(pid" in plan and all("__k" in line for line in plan.splitlines() if "hashpartitioning(pid" in line)
    assert [r["count"] for r in found.groupBy("fold").count().collect()] == [8_000] * 5


def files(root):
    def put(person, session, **of):
        d = root / f"Part {person}" / session
        d.mkdir(parents=True)
        for name, text in of.items():
            (d / f"{name}.csv").write_bytes(text.encode())

    put("101C", "B77aa1_200102-030405", EDA="100.0\r\n4.0\r\n" + "\r\n".join(map(str, range(25))) + "\r\n", tags="101.5\n\n103\nx\n", IBI="100.0, IBI\n1.0,0.8\n2.0,0.3\n3.0,2.0\n4.0,1.9\n5.0,\n")
    put("101C", "B1 a+b%20", EDA="7, x\n4, y\n\n1.5,9\nnan\n-2\n\nbad\n", tags="", IBI="")
    put("102C", "B1_x", EDA="100.0\n", tags="5\n")
    put("102C", "B2_x", EDA="100.0\n4.0\n", IBI="9\n")
    (root / "Other" / "s").mkdir(parents=True)
    (root / "Other" / "s" / "EDA.csv").write_text("1\n4\n1\n")


@pytest.mark.parametrize("chunk,task", [(1, 1), (7, 40), (16_384, 1 << 20)])
def test_arrays_are_the_samples_of_the_files(spark, tmp_path, chunk, task):
    files(tmp_path)
    read = lambda kind: recordings.recordings(spark, str(tmp_path), kind, chunk=chunk, task_bytes=task)
    rows = lambda df, *c: sorted(map(repr, df.select(*c).collect()))
    own, other = recordings.samples(read("signal")), sensors.read_signal(spark, str(tmp_path))
    assert rows(own, "pid", "sid", "t0", "i", "t", "x") == rows(other, "pid", "sid", "t0", "i", "t", "x") and own.count() == 29
    assert rows(recordings.ends(read("signal")), "pid", "sid", "t0", "t1", "n") == rows(sensors.sessions(other), "pid", "sid", "t0", "t1", "n")
    assert max(len(r.x) for r in read("signal").collect()) <= chunk
    assert rows(read("tags").select("pid", "sid", F.explode("tag_t").alias("tag_t")), "pid", "sid", "tag_t") == rows(sensors.read_tags(spark, str(tmp_path)), "pid", "sid", "tag_t")
    pairs = read("beats").select("pid", "sid", F.inline(F.arrays_zip("bt", "rr")))
    assert rows(pairs, "pid", "sid", "bt", "rr") == rows(sensors.read_beats(spark, str(tmp_path)), "pid", "sid", "bt", "rr")


def test_only_files_of_wanted_participants_are_opened(spark, tmp_path):
    files(tmp_path)
    bad = tmp_path / "Part 9" / "s"
    bad.mkdir(parents=True)
    (bad / "EDA.csv").write_text("1\n32\n1\n")
    read = lambda **o: recordings.recordings(spark, f"file://{tmp_path}", **o)
    with pytest.raises(PySparkException, match="sampling rate"):
        read().collect()
    assert recordings.samples(read(rate=None).filter("pid = 'P9'")).first().t == 1.0
    one = read().filter("pid = 'P101C'")
    assert one.count() == 2 and one.filter(F.col("sid").isin("B1 a+b%20", "none")).count() == 1
    assert read().filter(F.col("pid").isin("P101C", "P102C") & (F.col("start") > 5)).count() == 0
    assert read().filter("pid = 'P101C' and pid = 'P9'").count() == 0 and read().filter("pid = 'none'").count() == 0
    only = read().filter((F.col("pid") == "P101C") & (F.col("t0") > 50))
    assert [r.pid for r in only.collect()] == ["P101C"]


def test_leak_checks_read_what_is_written_once(spark):
    plan = catalog.QUERIES["q60_leak_checks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Window" not in plan and "/splits-" in plan
