"""Queries of whole evaluation protocols: windows of several signals, guards and leak checks, blocks, models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import balance, kernels, labels, metrics, models, splits, windows
from ..operators import beats as heart
from ..shared import written
from ..sources.tables import table
from .catalog import BEATS, DEV, FEATURES, SEED, SPAN, beats, cut, device_groups, devices, feature_rows, labelled, long_sessions, one_recording, places, points, query, recordings, rounded, whole  # before what hangs on it
from .blocks import BLOCKS, blocks  # noqa: I001

#: Windows by the labels that look ahead only, found without panes: those that ``wb`` has samples for, with a horizon of one.
WB = """, rb AS (SELECT pid, t, x, yb, row_number() OVER (PARTITION BY pid ORDER BY t, event_id) - 1 AS i FROM y), st AS (SELECT pid, i AS s FROM rb WHERE i % 5 = 0),
wj AS (SELECT st.pid, s, t, x, yb, i - s AS k FROM st JOIN rb ON st.pid = rb.pid AND i BETWEEN s AND s + 10),
wa AS (SELECT pid, s, count(*) FILTER (k < 10) AS n, count(*) AS n_all, avg(x) FILTER (k < 10) AS mean, min(yb) FILTER (k < 10) AS lo, max(yb) FILTER (k < 10) AS hi, min(t) AS t_start, max(t) FILTER (k < 10) AS t_last FROM wj GROUP BY pid, s),
wf AS (SELECT *, CASE WHEN lo = hi AND lo <> -1 THEN lo ELSE -1 END AS y FROM wa WHERE n = 10)
"""
Z = ", zz AS (SELECT pid, i, (x - avg(x) OVER v) / (stddev_pop(x) OVER v + 1e-8) AS z FROM rb WINDOW v AS (PARTITION BY pid))"


def total(c: str):
    return F.aggregate(c, F.lit(0.0), lambda s, v: s + v)


def zscored(rows: DataFrame) -> DataFrame:
    """``rows`` with z: their x by the recording's mean and population deviation."""
    w = Window.partitionBy("pid", "sid")
    return rows.withColumn("z", (F.col("x") - F.avg("x").over(w)) / (F.stddev_pop("x").over(w) + F.lit(1e-8)))


# ---- windows of several signals --------------------------------------------------------------------


@query("q53_zscored_windows", WB + Z + " SELECT f.pid, f.s, f.y, round(sum(z) FILTER (i < s + 10), 4) AS total, round(max(z) FILTER (i = s + 10), 4) AS ahead FROM wf f JOIN zz ON f.pid = zz.pid AND i BETWEEN s AND s + 10 WHERE n_all = 11 AND mean >= 40 GROUP BY 1, 2, 3")
def q53(spark, d):
    w = windows.windows(zscored(whole(spark, d, labels.before_only)), 5, 1, 40.0, ("z",))
    return w.select("pid", "s", "y", places(total("z"), 4).alias("total"), places(F.col("z_yf")[0], 4).alias("ahead"))


@query("q54_multimodal_windows", BEATS + WB + Z + """, bs AS (SELECT pid, count(*) AS n, avg(rr) AS m, stddev_pop(rr) AS sd FROM ok GROUP BY pid HAVING count(*) >= 2),
gb AS (SELECT rb.pid, rb.i, rb.t, max(bt) FILTER (bt <= rb.t) AS ta, min(bt) FILTER (bt >= rb.t) AS tz FROM rb JOIN ok ON ok.pid = rb.pid GROUP BY 1, 2, 3),
hb AS (SELECT gb.*, a.rr AS ra, b.rr AS rz FROM gb LEFT JOIN ok a ON a.pid = gb.pid AND a.bt = ta LEFT JOIN ok b ON b.pid = gb.pid AND b.bt = tz),
th AS (SELECT hb.pid, i, (CASE WHEN ra IS NULL THEN rz WHEN rz IS NULL OR tz = ta THEN ra ELSE ra + (rz - ra) * (t - ta) / (tz - ta) END - bs.m) / (bs.sd + 1e-8) AS h FROM hb JOIN bs ON bs.pid = hb.pid),
nb AS (SELECT f.pid, f.s, count(bt) AS n_beats FROM wf f LEFT JOIN ok ON ok.pid = f.pid AND bt >= t_start AND bt < t_last GROUP BY 1, 2)
SELECT f.pid, f.s, f.y, n_beats, round(sum(z) FILTER (zz.i < f.s + 10), 4) AS eda, round(sum(h) FILTER (zz.i < f.s + 10), 4) AS hrv, round(max(h) FILTER (zz.i = f.s + 10), 4) AS hrv_ahead
FROM wf f JOIN nb USING (pid, s) JOIN zz ON f.pid = zz.pid AND zz.i BETWEEN f.s AND f.s + 10 JOIN th ON th.pid = f.pid AND th.i = zz.i WHERE n_all = 11 AND mean >= 40 AND n_beats >= 4 GROUP BY 1, 2, 3, 4""")
def q54(spark, d):
    # the tachogram is scaled by the beats' own mean and deviation; a window needs beats between its first and last sample
    b = beats(spark, d).withColumn("sid", F.lit(0).cast("long"))
    stats = b.groupBy("pid", "sid").agg(F.count("*").alias("n_rr"), F.avg("rr").alias("m"), F.stddev_pop("rr").alias("sd")).filter("n_rr >= 2")
    both = heart.tachogram(zscored(whole(spark, d, labels.before_only)), b).join(stats, ["pid", "sid"])
    both = both.withColumn("h", (F.col("rr") - F.col("m")) / (F.col("sd") + F.lit(1e-8)))
    w = windows.windows(both, 5, 1, 40.0, ("z", "h", "below")).withColumn("n_beats", F.element_at("below", -1) - F.col("below")[0])
    return w.filter("n_beats >= 4").select("pid", "s", "y", "n_beats", places(total("z"), 4).alias("eda"), places(total("h"), 4).alias("hrv"), places(F.col("h_yf")[0], 4).alias("hrv_ahead"))


KEPT = BEATS + WB + f""", lw AS (SELECT * FROM wf WHERE mean >= 40), wbt AS (SELECT f.pid, f.s, f.y, bt, rr, rr - lag(rr) OVER (PARTITION BY f.pid, f.s ORDER BY bt) AS d FROM lw f JOIN ok ON ok.pid = f.pid AND bt >= t_start AND bt < t_start + {SPAN} WHERE f.y >= 0),
hv AS (SELECT pid, s, y, count(*) AS n_beats, avg(rr) AS mean_rr, stddev_pop(rr) AS sdnn, sqrt(avg(d * d)) AS rmssd, avg(CAST(abs(d) > 0.05 AS INTEGER)) AS pnn50, 60 / avg(rr) AS mean_hr FROM wbt GROUP BY 1, 2, 3 HAVING count(*) >= 2)
"""


def heart_windows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Windows on the body, and the features of the labelled ones that have two beats or more."""
    w = windows.windows(whole(spark, d, labels.before_only), 5).filter("mean >= 40").select("pid", "s", "y", "t_start")
    kept = heart.beats_in(one_recording(w.filter("y >= 0")), one_recording(beats(spark, d)), SPAN)
    return w, heart.variability(kept, ["pid", "s"]).filter("n_beats >= 2").join(w.select("pid", "s", "y"), ["pid", "s"])


@query("q55_hrv_windows", KEPT + """SELECT pid, s, y, n_beats, round(mean_rr, 6) AS mean_rr, round(sdnn, 6) AS sdnn, round(rmssd, 6) AS rmssd, round(pnn50, 6) AS pnn50, round(mean_hr, 6) AS mean_hr,
round((rmssd - avg(rmssd) OVER v) / (stddev_samp(rmssd) OVER v + 1e-8), 4) AS rmssd_z, CAST(floor((row_number() OVER (PARTITION BY pid ORDER BY s) - 1) * 5 / count(*) OVER v) AS BIGINT) AS fold FROM hv WINDOW v AS (PARTITION BY pid)""")
def q55(spark, d):
    v = Window.partitionBy("pid")
    z = (F.col("rmssd") - F.avg("rmssd").over(v)) / (F.stddev_samp("rmssd").over(v) + F.lit(1e-8))
    made = splits.window_folds(heart_windows(spark, d)[1].withColumn("rmssd_z", places(z, 4)), 5, "s")
    return rounded(made)


@query("q56_hrv_coverage", KEPT + "SELECT wf.pid, count(*) AS n_windows, count(*) FILTER (mean >= 40 AND wf.y >= 0) AS n_labelled, count(hv.s) AS n_kept, round(100 * count(hv.s) / greatest(count(*) FILTER (mean >= 40 AND wf.y >= 0), 1), 4) AS coverage FROM wf LEFT JOIN hv USING (pid, s) GROUP BY wf.pid")
def q56(spark, d):
    every = windows.windows(whole(spark, d, labels.before_only), 5).groupBy("pid").agg(F.count("*").alias("n_windows"), F.count_if((F.col("mean") >= 40) & (F.col("y") >= 0)).alias("n_labelled"))
    kept = heart_windows(spark, d)[1].groupBy("pid").agg(F.count("*").alias("n_kept"))
    out = every.join(kept, "pid", "left").na.fill({"n_kept": 0})
    return out.withColumn("coverage", F.round(100 * F.col("n_kept") / F.greatest("n_labelled", F.lit(1)), 4))


@query("q57_windows_offbody_count", WB.replace("yb", "y") + "SELECT pid, count(*) AS n_windows, count(*) FILTER (y >= 0 AND mean >= 40) AS n_kept, count(*) FILTER (y >= 0 AND mean < 40) AS n_offbody FROM wf GROUP BY pid")
def q57(spark, d):
    # pure labels first, then what is off the body, which is counted
    pure, on = F.col("y") >= 0, F.col("mean") >= 40
    return windows.windows(whole(spark, d), 5).groupBy("pid").agg(F.count("*").alias("n_windows"), F.count_if(pure & on).alias("n_kept"), F.count_if(pure & ~on).alias("n_offbody"))


def features_26(w: DataFrame) -> DataFrame:
    """(pid, sid, s, 26 features) of windows (pid, sid, s, x): sixteen by SQL, ten of the phasic and tonic parts by the filter kernel."""
    x, i, v = F.col("x"), F.col("i") / F.lit(4.0), Window.partitionBy("pid", "sid", "s").orderBy("i")
    d1 = points(w.withColumn("y", F.lit(0))).withColumns({"d1": x - F.lag("x").over(v), "d2": x - 2 * F.lag("x").over(v) + F.lag("x", 2).over(v)})
    plain = d1.groupBy("pid", "sid", "s").agg(
        F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), (F.max(x) - F.min(x)).alias("range"), F.median(x).alias("median"), F.percentile(x, 0.25).alias("p25"), F.percentile(x, 0.75).alias("p75"),
        F.coalesce(F.skewness(x), F.lit(0.0)).alias("skew"), F.coalesce(F.kurtosis(x), F.lit(0.0)).alias("kurt"), F.regr_slope(x, i).alias("slope"),
        F.avg("d1").alias("d1_mean"), F.stddev_pop("d1").alias("d1_std"), F.avg(F.abs("d1")).alias("d1_abs"), F.avg("d2").alias("d2_mean"), F.stddev_pop("d2").alias("d2_std"),
    )
    return plain.join(kernels.phasic(w), ["pid", "sid", "s"])


@query("q58_window_features_26")
def q58(spark, d):
    return rounded(features_26(cut(spark, d)))


# ---- guards, leaks, statistics of the training part --------------------------------------------------


@query("q59_guarded_split", DEV + """, g1 AS (SELECT *, max(CASE WHEN stress THEN {'a': t0, 'b': gid} END) OVER w AS edge, count(*) FILTER (stress AND split = 'test') OVER w AS k FROM split WINDOW w AS (PARTITION BY pid)),
g2 AS (SELECT * REPLACE (CASE WHEN k = 0 AND {'a': t0, 'b': gid} >= edge THEN 'test' ELSE split END AS split) FROM g1),
g3 AS (SELECT pid, gid, t0, split, min(CASE WHEN stress AND split = 'test' THEN {'a': t0, 'b': gid} END) OVER w AS edge, count(*) FILTER (stress AND split = 'train') OVER w AS k FROM g2 WINDOW w AS (PARTITION BY pid))
SELECT pid, gid, CASE WHEN k = 0 AND {'a': t0, 'b': gid} <= edge THEN 'train' ELSE split END AS split FROM g3""", shared=False)
def q59(spark, d):
    return splits.guarded_split(device_groups(spark, d)).select("pid", "gid", "split")


@query("q60_leak_checks", DEV + """, x AS (SELECT pid, sid, gid, t0, CASE WHEN md5('44:' || sid) < '4' THEN 'test' WHEN md5('44:' || sid) > 'f8' THEN NULL ELSE 'train' END AS split FROM og
UNION ALL SELECT pid, sid, gid, t0, CASE WHEN md5('45:' || sid) < '8' THEN 'test' ELSE 'train' END FROM og WHERE sid % 50 = 0)
SELECT pid, 'group on both sides' AS leak FROM x GROUP BY pid, gid HAVING count(DISTINCT split) > 1
UNION ALL SELECT pid, 'recording on both sides' FROM (SELECT pid, sid FROM x GROUP BY pid, sid HAVING bool_or(split = 'train') AND bool_or(split = 'test'))
UNION ALL SELECT pid, 'training after test' FROM x GROUP BY pid HAVING max(CASE WHEN split = 'train' THEN t0 END) >= min(CASE WHEN split = 'test' THEN t0 END)
UNION ALL SELECT pid, 'no split' FROM x WHERE split IS NULL""", shared=False)
def q60(spark, d):
    # a split by chance, some recordings twice and some without one: every check finds something
    g = splits.overlap_groups(devices(spark, d)).select("pid", "sid", "gid", "t0")
    h = lambda seed: splits.shuffled(seed, "sid")
    once = g.withColumn("split", F.when(h(44) < "4", "test").when(h(44) > "f8", None).otherwise("train"))
    return splits.leaks(once.unionByName(g.filter("sid % 50 = 0").withColumn("split", F.when(h(45) < "8", "test").otherwise("train"))))


@query("q61_train_zscore", """, f AS (SELECT pid, s, floor((row_number() OVER (PARTITION BY pid ORDER BY s) - 1) * 5 / count(*) OVER (PARTITION BY pid)) AS fold FROM w),
st AS (SELECT pid, avg(x) AS mu, stddev_pop(x) AS sd FROM wx JOIN f USING (pid, s) WHERE fold < 4 GROUP BY pid)
SELECT wx.pid, wx.s, round(sum((x - mu) / nullif(sd, 0)), 4) AS total FROM wx JOIN st USING (pid) GROUP BY wx.pid, wx.s""")
def q61(spark, d):
    # statistics of the samples of training windows (a sample counts in each), population deviation, no epsilon
    p = points(splits.window_folds(cut(spark, d), 5, "s").withColumn("y", F.col("fold")))
    w = Window.partitionBy("pid")
    train = F.when(F.col("y") < 4, F.col("x"))
    sd = F.stddev_pop(train).over(w)
    z = p.select("pid", "s", ((F.col("x") - F.avg(train).over(w)) / F.nullif(sd, F.lit(0.0))).alias("z"), F.avg(train).over(w).alias("mu"))
    return z.filter("mu is not null").groupBy("pid", "s").agg(places(F.sum("z"), 4).alias("total"))


@query("q62_train_span_stats", BLOCKS + "SELECT subject, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS sd FROM (SELECT DISTINCT subject, i, x FROM bl JOIN b2 USING (subject) WHERE split = 'train' AND i BETWEEN start AND start + 6) GROUP BY subject")
def q62(spark, d):
    rows, starts = blocks(spark, d)
    inside = windows.covered(rows, starts.filter("split = 'train'"), 7)
    return rounded(inside.groupBy("subject").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd")))


@query("q63_block_windows", BLOCKS + "SELECT * FROM b2")
def q63(spark, d):
    return blocks(spark, d)[1]


@query("q64_event_windows", ", ls AS (SELECT pid, min(t) AS t0, max(t) AS t1, floor((max(t) - min(t)) / 900) AS n FROM s0 GROUP BY pid), q AS (SELECT e.pid, e.t AS tag_t, CAST(floor(floor(e.t - t0) * (1 / 900.0)) AS BIGINT) AS k, n FROM s0 e JOIN ls USING (pid) WHERE e.tag AND e.t > t0 AND e.t < t1) SELECT pid, tag_t, unnest(range(k - 48, k + 48 - 24 + 1, 12)) AS start FROM q WHERE k - 80 >= 0 AND k + 80 <= n")
def q64(spark, d):
    return windows.segment_windows(windows.event_segments(*long_sessions(spark, d), 48, 80, 1 / 900.0), 24, 12).select("pid", "tag_t", "start")


@query("q86_recording_guards", BEATS + """, c AS (SELECT pid, sid, count(*) AS n FROM s GROUP BY 1, 2), b2 AS (SELECT pid, sid FROM ok GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT c.pid, CAST(sum(n) AS BIGINT) AS n_all, CAST(coalesce(sum(n) FILTER (n >= 2), 0) AS BIGINT) AS n_filter, CAST(coalesce(sum(n) FILTER (n >= 3), 0) AS BIGINT) AS n_window, CAST(coalesce(sum(n) FILTER (n >= 4 AND b2.sid IS NOT NULL), 0) AS BIGINT) AS n_both FROM c LEFT JOIN b2 USING (pid, sid) GROUP BY c.pid""")
def q86(spark, d):
    # samples that the guards of filters, of windows, and of windows with a horizon and beats let through
    s = recordings(spark, d)
    out = s.groupBy("pid").agg(F.count("*").alias("n_all"))
    for name, kept in (("n_filter", windows.long_enough(s, 2)), ("n_window", windows.long_enough(s, 3)), ("n_both", windows.long_enough(s, 4, beats(spark, d), 2))):
        out = out.join(kept.groupBy("pid").agg(F.count("*").alias(name)), "pid", "left")
    return out.na.fill(0)


@query("q87_segment_minmax", "SELECT pid, s, round(sum((x - lo) / (hi - lo)), 4) AS total FROM (SELECT *, min(x) OVER v AS lo, max(x) OVER v AS hi FROM wx WINDOW v AS (PARTITION BY pid, s)) WHERE hi > lo GROUP BY pid, s")
def q87(spark, d):
    w = cut(spark, d).select("pid", "s", "x", F.array_min("x").alias("lo"), F.array_max("x").alias("hi")).filter("hi > lo")
    return w.select("pid", "s", places(total(F.transform("x", lambda v: (v - F.col("lo")) / (F.col("hi") - F.col("lo")))), 4).alias("total"))


@query("q88_train_span_zscore", BLOCKS + """, m AS (SELECT subject, avg(x) AS mu, stddev_pop(x) AS sd FROM (SELECT DISTINCT subject, i, x FROM bl JOIN b2 USING (subject) WHERE split = 'train' AND i BETWEEN start AND start + 6) GROUP BY subject)
SELECT subject, i, round((x - mu) / (sd + 1e-8), 4) AS z FROM bl JOIN m USING (subject)""")
def q88(spark, d):
    rows, starts = blocks(spark, d)
    m = windows.covered(rows, starts.filter("split = 'train'"), 7).groupBy("subject").agg(F.avg("x").alias("mu"), F.stddev_pop("x").alias("sd"))
    return rows.join(m, "subject").select("subject", "i", places((F.col("x") - F.col("mu")) / (F.col("sd") + F.lit(1e-8)), 4).alias("z"))


@query("q76_stratified_subset", "SELECT doc_id, quality AS y FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5('42:' || doc_id), doc_id) AS k FROM labels) WHERE k <= CASE quality WHEN 1 THEN 50 ELSE 51 END", shared=False)
def q76(spark, d):
    return balance.stratified_subset(table(spark, d, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id", 101, SEED)


@query("q77_pooled_split", "SELECT event_id, y, CASE WHEN row_number() OVER (PARTITION BY y ORDER BY md5('42:' || event_id), event_id) <= round_even(count(*) OVER (PARTITION BY y) * 0.3, 0) THEN 'test' ELSE 'train' END AS split FROM y WHERE y >= 0")
def q77(spark, d):
    return splits.stratified_split(labelled(spark, d).filter("y >= 0"), ["y"], "event_id", 0.3, SEED).select("event_id", "y", "split")


@query("q80_train_rows_by_difference", "SELECT pid, i FROM r EXCEPT SELECT pid, i FROM r WHERE i % 7 = 3")
def q80(spark, d):
    rows = whole(spark, d, None).select("pid", "i")
    return rows.subtract(rows.filter("i % 7 = 3"))


# ---- models (no SQL) -------------------------------------------------------------------------------


def pooled_rows(spark: SparkSession, d: str) -> DataFrame:
    """Features of windows with a pooled split."""
    rows = feature_rows(spark, d).withColumn("key", F.concat_ws("/", "pid", "s")).na.drop()
    return splits.stratified_split(rows, ["y"], "key", 0.3, SEED)


@query("q81_pooled_by_participant")
def q81(spark, d):
    # one model for all; its test windows by cohort
    scores, _ = models.pooled(pooled_rows(spark, d), FEATURES)
    test = scores.filter("split = 'test'").withColumns({"cohort": F.col("pid") % 10, "p": (F.col("score") >= 0.5).cast("int")})
    out = metrics.confusion(test, ["cohort"], "p", "y").join(metrics.auc(test, ["cohort"]).select("cohort", "auc", "n_pos"), "cohort")
    return rounded(out)


@query("q82_fusion_auc")
def q82(spark, d):
    # late fusion: heart features beside those of the signal, against either alone, on the same windows
    both = feature_rows(spark, d).drop("y").join(heart_windows_any(spark, d), ["pid", "s"]).na.drop()
    folded = written(splits.window_folds(both.withColumns({"user": F.col("pid"), "pid": F.col("pid") % 10}), 5, "s", "user"), "folded")
    out = None
    for name, columns in (("signal", FEATURES), ("heart", HEART), ("signal+heart", [*FEATURES, *HEART])):
        a = metrics.auc(models.logistic_cv(folded, columns), ["pid"]).withColumn("features", F.lit(name))
        out = a if out is None else out.unionByName(a)
    return rounded(out)


HEART = ["mean_rr", "sdnn", "mean_hr"]


def heart_windows_any(spark: SparkSession, d: str) -> DataFrame:
    """Heart features of windows whose y says whether any sample has stress ahead."""
    w = windows.windows(whole(spark, d, labels.before_only), 5).select("pid", "s", F.col("any").cast("int").alias("y"), "t_start")
    f = heart.variability(heart.beats_in(one_recording(w), one_recording(beats(spark, d)), SPAN), ["pid", "s"]).filter("n_beats >= 2")
    return f.select("pid", "s", *HEART).join(w.select("pid", "s", "y"), ["pid", "s"])


@query("q83_frozen_head_vs_supervised")
def q83(spark, d):
    # the pretext model's forecast as a frozen feature under a head, against a head on the samples themselves
    w = cut(spark, d).withColumn("key", F.concat_ws("/", "pid", "s")).withColumn("y", F.col("any").cast("int"))
    rows = written(splits.stratified_split(w.select("key", "x", "yf", "y", "sid", "s", "t_start", "pid"), ["y"], "key", 0.3, SEED), "windows")
    scaled = written(models.pretext_rows(rows.filter("split = 'train'").withColumn("pid", F.lit(0).cast("long")), ["pid"]), "pretext")
    encoder = models.ridge(scaled, ["pid"], 1.0).select("w")
    ahead = rows.crossJoin(F.broadcast(encoder)).withColumn("forecast", models.dot(F.concat("x", F.array(F.lit(0.0))), F.slice("w", 1, F.size("x") + 1)))  # one row of weights
    wide = ahead.select("key", "y", "split", "forecast", *[F.col("x")[k].alias(f"x{k}") for k in range(10)])
    out = None
    for name, columns in (("frozen", ["forecast"]), ("supervised", [f"x{k}" for k in range(10)])):
        scores, _ = models.pooled(wide.select("key", "y", "split", *columns), columns)
        a = metrics.auc(scores.select("split", "y", "score").withColumn("model", F.lit(name)), ["model", "split"])
        out = a if out is None else out.unionByName(a)
    return rounded(out)


@query("q84_multi_output_regression")
def q84(spark, d):
    # six items at once from order lines; errors by item and of all
    x = [F.col(c).cast("double") for c in ("l_quantity", "l_discount", "l_tax")]
    items = F.array(*[F.col("l_extendedprice") / 1000 * k - F.col("l_quantity") * (6 - k) for k in range(1, 7)])
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") % 10 == 0).alias("test"), F.array(*x, F.lit(1.0)).alias("x"), items.alias("y"), F.lit(0).alias("g"))
    w = models.ridge(rows.filter("not test"), ["g"], 1e-6).select("w")
    e = rows.filter("test").crossJoin(F.broadcast(w)).select(F.posexplode(F.zip_with(models.forecasts("x", "w", F.size("y")), "y", lambda p, v: (p - v) * (p - v))).alias("item", "e"))  # one row of weights
    return rounded(e.rollup("item").agg(F.sqrt(F.avg("e")).alias("rmse"), F.count("*").alias("n")), 4)


@query("q85_training_history")
def q85(spark, d):
    return rounded(models.pooled(pooled_rows(spark, d), FEATURES)[1])


@query("q90_perceptron")
def q90(spark, d):
    # a small perceptron over the samples of windows, in place of the convolutional network
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    w = cut(spark, d).withColumn("key", F.concat_ws("/", "pid", "s"))
    rows = splits.stratified_split(w.select("key", F.col("any").cast("double").alias("y"), array_to_vector(F.transform("x", lambda v: v / 100)).alias("x")), ["y"], "key", 0.3, SEED)
    rows = written(rows.withColumn("a", vector_to_array("x")).drop("x"), "perceptron").withColumn("x", array_to_vector("a")).drop("a")
    model = MultilayerPerceptronClassifier(featuresCol="x", labelCol="y", layers=[10, 16, 8, 2], maxIter=40, seed=SEED).fit(rows.filter("split = 'train'"))
    scores = model.transform(rows).select("split", F.col("y").cast("int").alias("y"), vector_to_array("probability")[1].alias("score"))
    return rounded(metrics.auc(scores, ["split"]))
