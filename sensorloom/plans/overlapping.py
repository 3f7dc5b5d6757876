"""Queries of recordings that overlap, repeated tags, and windows with their samples.

A participant's events with even and with odd numbers stand for two devices worn at the same time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import beats as heart
from ..operators import features, labels, windows
from ..sources.tables import samples
from .blocks import BLOCKS, blocks
from .catalog import BUFFER, NEAR, ORACLE, SPAN, query, recordings, rounded, session_table, tags_of, whole

#: Presses reach an hour here, so that many windows have one label.
HOUR = 3_600.0
TWO = f""", e AS (SELECT event_id, pid, event_id % 2 AS sid, t, x, CASE WHEN after <= {HOUR} THEN 1 WHEN before <= {HOUR} THEN -1 ELSE 0 END AS yb, row_number() OVER (PARTITION BY pid, event_id % 2 ORDER BY t, event_id) - 1 AS i FROM y),
eb AS (SELECT pid, sid, t AS bt, (t - lag(t) OVER (PARTITION BY pid, sid ORDER BY i)) / 40000 AS rr FROM e), eok AS (SELECT * FROM eb WHERE rr > 0.3 AND rr < 2.0),
ez AS (SELECT *, (x - avg(x) OVER v) / (stddev_pop(x) OVER v + 1e-8) AS z FROM e WINDOW v AS (PARTITION BY pid, sid)),
es AS (SELECT pid, sid, i AS s FROM e WHERE i % 5 = 0),
ej AS (SELECT es.pid, es.sid, s, t, x, yb, z, i - s AS k FROM es JOIN ez ON es.pid = ez.pid AND es.sid = ez.sid AND i BETWEEN s AND s + 9),
ew AS (SELECT pid, sid, s, min(t) AS t_start, avg(x) AS mean, CASE WHEN min(yb) = max(yb) AND min(yb) <> -1 THEN min(yb) ELSE -1 END AS y FROM ej GROUP BY 1, 2, 3 HAVING count(*) = 10),
eh AS (SELECT ew.pid, ew.sid, ew.s, bt, rr, rr - lag(rr) OVER (PARTITION BY ew.pid, ew.sid, ew.s ORDER BY bt) AS d FROM ew LEFT JOIN eok ON eok.pid = ew.pid AND eok.sid = ew.sid AND bt >= t_start AND bt < t_start + {SPAN})
"""


def two_devices(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Labelled samples (pid, sid, i, t, x, y) of two recordings at once, by the tags of both, and their beats (pid, sid, bt, rr)."""
    s = samples(spark, d)
    w = Window.partitionBy("pid", "sid").orderBy("t", "event_id")
    rows = labels.labelled(s, tags_of(s), HOUR, HOUR, labels.before_only).withColumn("sid", F.col("event_id") % 2).withColumn("i", (F.row_number().over(w) - 1).cast("long"))
    of = Window.partitionBy("pid", "sid").orderBy("i")
    return rows, rows.select("pid", "sid", F.col("t").alias("bt"), ((F.col("t") - F.lag("t").over(of)) / 40000).alias("rr")).filter("rr > 0.3 and rr < 2.0")


@query("q91_beats_by_recording", TWO + "SELECT pid, sid, s, count(bt) AS n_beats, round(avg(rr), 6) AS mean_rr, round(sqrt(avg(d * d)), 6) AS rmssd FROM eh GROUP BY 1, 2, 3")
def q91(spark, d):
    s, b = two_devices(spark, d)
    keys = ["pid", "sid", "s"]
    return rounded(heart.variability(heart.beats_in(windows.windows(s, 5), b, SPAN), keys).select(*keys, "n_beats", "mean_rr", "rmssd"))


def twice(tags: DataFrame) -> DataFrame:
    return tags.unionByName(tags)


@query("q92_labels_of_repeated_tags", "SELECT event_id, y, yb FROM y")
def q92(spark, d):
    # every tag is there twice, as where two devices of a participant keep the same press
    s = samples(spark, d)
    near = labels.near_tags(s, twice(tags_of(s)), BUFFER)
    return near.select("event_id", labels.two_sided(NEAR, BUFFER).alias("y"), labels.before_only(NEAR, BUFFER).alias("yb"))


@query("q93_intervals_of_repeated_tags", ORACLE["q03_interval_labels_valid_events"], shared=False)
def q93(spark, d):
    rec = recordings(spark, d)
    tags = rec.filter("tag").select("pid", "sid", F.col("t").alias("tag_t"))
    return labels.interval_labels(rec, twice(tags), session_table(rec), NEAR).select("event_id", "y")


def eda_hrv_rows(spark: SparkSession, d: str) -> DataFrame:
    s, b = two_devices(spark, d)
    return features.eda_hrv(s, b, 5, SPAN, 40.0)


PLAIN = ["eda_mean", "eda_std", "eda_range", "eda_slope", "eda_absdiff", *features.HRV.values()]


@query("q94_eda_hrv_features", TWO + """, ef AS (SELECT pid, sid, s, avg(z) AS eda_mean, stddev_pop(z) AS eda_std, max(z) - min(z) AS eda_range, regr_slope(z, k / 4.0) AS eda_slope FROM ej GROUP BY 1, 2, 3),
ed AS (SELECT pid, sid, s, avg(abs(step)) AS eda_absdiff FROM (SELECT *, z - lag(z) OVER (PARTITION BY pid, sid, s ORDER BY k) AS step FROM ej) GROUP BY 1, 2, 3),
hv AS (SELECT pid, sid, s, count(bt) AS a, avg(rr) AS b, stddev_pop(rr) AS c, sqrt(avg(d * d)) AS d, avg(CAST(abs(d) > 0.05 AS INTEGER)) AS e, 60 / avg(rr) AS f FROM eh GROUP BY 1, 2, 3 HAVING count(bt) >= 2),
al AS (SELECT * FROM ew JOIN ef USING (pid, sid, s) JOIN ed USING (pid, sid, s) JOIN hv USING (pid, sid, s) WHERE y >= 0 AND mean >= 40)
SELECT pid, sid, s, y, """ + ", ".join(f"round({c}, 4) AS {c}" for c in PLAIN[:5]) + ", " + ", ".join(f"round(({x} - avg({x}) OVER v) / (stddev_samp({x}) OVER v + 1e-8), 4) AS {c}" for x, c in zip("abcdef", PLAIN[5:], strict=True)) + ", CAST(floor((row_number() OVER (PARTITION BY pid ORDER BY t_start, sid, s) - 1) * 5 / count(*) OVER (PARTITION BY pid)) AS BIGINT) AS fold FROM al WINDOW v AS (PARTITION BY pid, sid)")
def q94(spark, d):
    return rounded(eda_hrv_rows(spark, d).select("pid", "sid", "s", "y", *PLAIN, "fold"), 4)


@query("q95_eda_hrv_table")
def q95(spark, d):
    return rounded(eda_hrv_rows(spark, d))


@query("q96_block_window_samples", BLOCKS + "SELECT b.subject, b.block, b.start, b.split, round(sum(x), 4) AS total, round(max(x) FILTER (i = b.start + 6), 4) AS last FROM b2 b JOIN bl ON bl.subject = b.subject AND i BETWEEN b.start AND b.start + 6 GROUP BY 1, 2, 3, 4")
def q96(spark, d):
    rows, starts = blocks(spark, d)
    w = windows.gathered(rows, starts, 7)
    return w.select("subject", "block", "start", "split", F.round(features.total("x"), 4).alias("total"), F.round(F.element_at("x", -1), 4).alias("last"))


@query("q97_event_window_samples", """, q AS (SELECT r.pid, r.i AS mark, m.n FROM r JOIN (SELECT pid, count(*) AS n FROM r GROUP BY pid) m USING (pid) WHERE tag AND r.i - 24 >= 0 AND r.i + 24 <= m.n), w2 AS (SELECT pid, mark, unnest(range(mark - 24, mark + 24 - 10 + 1, 5)) AS start FROM q)
SELECT w2.pid, mark, start, round(sum(x), 4) AS total FROM w2 JOIN r ON r.pid = w2.pid AND r.i BETWEEN start AND start + 9 GROUP BY 1, 2, 3""")
def q97(spark, d):
    # segments of 48 samples around tags, in windows; overlapping segments repeat them
    rec = whole(spark, d, None)
    n = rec.groupBy("pid", "sid").agg(F.count("*").alias("n"))
    segments = rec.filter("tag").join(n, ["pid", "sid"]).select("pid", "sid", F.col("i").alias("mark"), (F.col("i") - 24).alias("first"), (F.col("i") + 24).alias("last"), "n").filter("first >= 0 and last <= n")
    w = windows.gathered(rec.select("pid", "sid", "i", "x"), windows.segment_windows(segments, 10, 5), 10, keys=("pid", "sid"), chunk=64)
    return w.select("pid", "mark", "start", F.round(features.total("x"), 4).alias("total"))


@query("q98_stretch_window_samples", """, n AS (SELECT pid, count(*) AS n FROM r GROUP BY pid), b AS (SELECT pid, 0 AS b FROM n UNION ALL SELECT pid, n FROM n UNION ALL SELECT pid, i FROM r WHERE tag),
c AS (SELECT pid, b + 6 AS first, lead(b) OVER (PARTITION BY pid ORDER BY b) - 6 AS last FROM b), w2 AS (SELECT pid, unnest(range(first, last - 10 + 1, 5)) AS start FROM c WHERE last - first >= 10)
SELECT w2.pid, start, round(sum(x), 4) AS total FROM w2 JOIN r ON r.pid = w2.pid AND r.i BETWEEN start AND start + 9 GROUP BY 1, 2""")
def q98(spark, d):
    rec = whole(spark, d, None)
    n = rec.groupBy("pid", "sid").agg(F.count("*").alias("n"))
    stretches = windows.between_marks(rec.filter("tag"), n, 6, 10)
    w = windows.gathered(rec.select("pid", "sid", "i", "x"), windows.segment_windows(stretches, 10, 5), 10, keys=("pid", "sid"), chunk=64)
    return w.select("pid", "start", F.round(features.total("x"), 4).alias("total"))
