"""Labels on arrival against labels of the whole table: files in any order, repeats, a restart, rows too late."""

import random

import numpy as np
from pyspark.sql import functions as F

from sensorloom.operators import labels
from sensorloom.streaming.labels import labelled_stream, labels_before

BASE = 1_000_000


def stream(spark, folder, late):
    """What has arrived after all files of ``folder`` so far; called again, it goes on from its checkpoint."""
    read = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/{name}")
    out = labelled_stream(read("s", "pid long, ts timestamp, x double"), read("t", "pid long, tag_ts timestamp"), 600, 3600, late)
    q = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/c").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted((r.pid or -1, r.t, r.x, r.y) for r in spark.read.parquet(f"{folder}/out").select("pid", (F.col("ts").cast("long") - BASE).alias("t"), "x", "y").collect())


def add(spark, folder, samples, tags):
    at = F.timestamp_seconds(F.col("t") + BASE)
    spark.createDataFrame(samples, "pid long, t long, x double").select("pid", at.alias("ts"), "x").coalesce(1).write.mode("append").parquet(f"{folder}/s")
    spark.createDataFrame(tags, "pid long, t long").select("pid", at.alias("tag_ts")).coalesce(1).write.mode("append").parquet(f"{folder}/t")


def batch(spark, samples, tags):
    s = spark.createDataFrame(samples, "pid long, t long, x double").withColumn("t", F.col("t").cast("double"))
    t = spark.createDataFrame(tags, "pid long, t long").select("pid", F.col("t").cast("double").alias("tag_t"))
    return sorted((r.pid or -1, int(r.t), r.x, r.y) for r in labels.labelled(s, t, 600, 3600, labels.before_only).collect())


def test_out_of_order_repeated_and_restarted(spark, tmp_path):
    rng = random.Random(7)
    samples = [(rng.choice([1, 1, 1, 2, None]), t, float(t % 97)) for t in range(0, 40_000, 400)]
    samples += samples[5:9]  # repeated rows stay
    tags = [(1, 3_600), (1, 3_600), (1, 7_300), (2, 0), (2, 22_000), (1, 30_001), (None, 15_000), (2, 39_000)]
    part = lambda rows, n: [r for r in rows if (r[1] >= 20_000) == n]
    wait = 7_200
    for n in (False, True):
        s, t = part(samples, n), part(tags, n)
        rng.shuffle(s)  # within a file, any order
        add(spark, tmp_path, s, t)
        got = stream(spark, tmp_path, wait)
        assert len(got) > 10 or not n
    add(spark, tmp_path, [(9, 90_000, 0.0)], [(9, 90_000)])  # time goes on, so all of the others are final
    got = [r for r in stream(spark, tmp_path, wait) if r[0] != 9]
    assert got == batch(spark, samples, tags) and len(got) == len(samples)


def test_a_tag_behind_the_watermark_counts_no_more(spark, tmp_path):
    add(spark, tmp_path, [(1, 0, 1.0), (1, 50_000, 2.0)], [(1, 50_000)])
    assert stream(spark, tmp_path, 100) == [(1, 0, 1.0, 0)]  # the other one waits
    add(spark, tmp_path, [(1, 49_950, 3.0)], [(1, 300), (1, 49_960)])
    add(spark, tmp_path, [(1, 90_000, 4.0)], [(1, 90_000)])
    assert stream(spark, tmp_path, 100) == [(1, 0, 1.0, 0), (1, 49_950, 3.0, 1), (1, 50_000, 2.0, 1)]


def test_labels_by_sorted_tags():
    rng = np.random.default_rng(8)
    for n in (0, 1, 7):
        tags, t = np.sort(rng.integers(0, 60, n).astype(float)), np.arange(-20.0, 90)
        ahead = lambda a, k: any(0 <= g - a <= k for g in tags)  # noqa: B023, E731
        want = [1 if ahead(a, 5) else -1 if any(abs(g - a) <= 12 for g in tags) else 0 for a in t]
        assert labels_before(t, tags, 5, 12).tolist() == want
