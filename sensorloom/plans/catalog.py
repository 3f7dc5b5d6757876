"""All queries over the star-schema tables, with their DuckDB SQL.

Participants are event users, samples their values, button presses their errors; radii and windows are scaled
to that data (a sample every few hours): +-4 h and +-12 h, windows of 10 samples in steps of 5, one ahead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import balance, kernels, labels, metrics, models, splits, windows
from ..operators import beats as heart
from ..sources.tables import GAP, samples, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
NEAR, BUFFER = 14_400.0, 43_200.0
SEED = 42

# ---- SQL shared by the oracles ---------------------------------------------------------------------

S = f"""WITH s0 AS (SELECT event_id, user_id AS pid, epoch_us(ts) / 1e6 AS t, value AS x, event_type = 'error' AS tag FROM events),
l AS (SELECT *, t - max(CASE WHEN tag THEN t END) OVER (PARTITION BY pid ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS before,
  min(CASE WHEN tag THEN t END) OVER (PARTITION BY pid ORDER BY t RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - t AS after FROM s0),
y AS (SELECT *, CASE WHEN least(before, after) <= {NEAR} THEN 1 WHEN least(before, after) <= {BUFFER} THEN -1 ELSE 0 END AS y,
  CASE WHEN after <= {NEAR} THEN 1 WHEN before <= {BUFFER} OR after <= {BUFFER} THEN -1 ELSE 0 END AS yb FROM l),
g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY pid ORDER BY t, event_id) > {GAP} THEN 1 ELSE 0 END AS st FROM y),
g2 AS (SELECT *, CAST(sum(st) OVER (PARTITION BY pid ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS sid FROM g),
s AS (SELECT *, row_number() OVER (PARTITION BY pid, sid ORDER BY t, event_id) - 1 AS i FROM g2),
r AS (SELECT event_id, pid, 0 AS sid, t, x, tag, y, row_number() OVER (PARTITION BY pid ORDER BY t, event_id) - 1 AS i FROM y),
ses AS (SELECT pid, sid, min(t) AS t0, max(t) + 3600 AS t1, count(*) AS n FROM s GROUP BY pid, sid),
p AS (SELECT pid, i // 5 AS pane, count(*) AS n, sum(x) AS total, min(y) AS low, max(y) AS high, min(t) AS ts, list(x ORDER BY i) AS xs FROM r GROUP BY pid, i // 5),
p2 AS (SELECT *, lead(n) OVER w AS n2, lead(total) OVER w AS total2, lead(low) OVER w AS low2, lead(high) OVER w AS high2, lead(xs) OVER w AS xs2, lead(xs, 2) OVER w AS xs3 FROM p WINDOW w AS (PARTITION BY pid ORDER BY pane)),
w AS (SELECT pid, pane * 5 AS s, ts AS t_start, list_concat(xs, xs2) AS x, xs3[1] AS yf, CASE WHEN least(low, low2) = greatest(high, high2) AND low <> -1 THEN low ELSE -1 END AS y, total + total2 AS total FROM p2 WHERE n = 5 AND n2 = 5 AND len(xs3) >= 1),
wx AS (SELECT pid, s, y, unnest(x) AS x, unnest(range(10)) AS i FROM w)
"""


def query(name: str, sql: str | None = None, shared: bool = True):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = (S + sql) if shared else sql
        return f

    return register


# ---- inputs that many queries share ----------------------------------------------------------------


def tags_of(s: DataFrame) -> DataFrame:
    return s.filter("tag").select("pid", F.col("t").alias("tag_t"))


def labelled(spark: SparkSession, d: str, rule=labels.two_sided) -> DataFrame:
    s = samples(spark, d)
    return labels.labelled(s, tags_of(s), NEAR, BUFFER, rule)


def recordings(spark: SparkSession, d: str) -> DataFrame:
    """Samples by session; without labels, which cost a pass of their own."""
    return windows.with_sessions(samples(spark, d), GAP)


def session_table(rec: DataFrame) -> DataFrame:
    return rec.groupBy("pid", "sid").agg(F.min("t").alias("t0"), (F.max("t") + 3600).alias("t1"), F.count("*").alias("n"), F.count_if("tag").alias("tags"))


def whole(spark: SparkSession, d: str, rule=labels.two_sided) -> DataFrame:
    """A participant's samples as one recording, labelled unless ``rule`` is None."""
    w = Window.partitionBy("pid").orderBy("t", "event_id")
    s = labelled(spark, d, rule) if rule else samples(spark, d)
    return s.withColumns({"sid": F.lit(0).cast("long"), "i": (F.row_number().over(w) - 1).cast("long")})


def cut(spark: SparkSession, d: str) -> DataFrame:
    return windows.windows(whole(spark, d), 5, 1)


def points(w: DataFrame) -> DataFrame:
    return w.select("pid", "sid", "s", "y", F.posexplode("x").alias("i", "x"))


def places(x: Column | str, digits: int) -> Column:
    """``x``, a double, rounded; what rounds to zero keeps its sign, as in SQL (-0.00001 is -0.0)."""
    made = F.round(x, digits)
    return F.when(made == 0, F.signum(x) * F.lit(0.0)).otherwise(made)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: places(c, digits) for c, t in df.dtypes if t == "double"})


def devices(spark: SparkSession, d: str) -> DataFrame:
    """Recordings of two devices of a participant that may overlap: orders of a customer, each some days long."""
    o = table(spark, d, "orders")
    t0 = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(o_orderdate as timestamp_ntz))").cast("double")
    return o.select(F.col("o_custkey").alias("pid"), F.col("o_orderkey").alias("sid"), t0.alias("t0"), (t0 + (F.col("o_orderkey") % 90 + 1) * 86400.0).alias("t1"), (F.col("o_orderkey") % 7 + 1).cast("long").alias("weight"), F.col("o_orderpriority").startswith("1").alias("stress"))


DEV = """WITH o AS (SELECT o_custkey AS pid, o_orderkey AS sid, epoch(o_orderdate) AS t0, epoch(o_orderdate) + (o_orderkey % 90 + 1) * 86400.0 AS t1, o_orderkey % 7 + 1 AS weight, starts_with(o_orderpriority, '1') AS stress FROM orders),
f AS (SELECT *, CASE WHEN m IS NULL OR t0 >= m THEN 1 ELSE 0 END AS st FROM (SELECT *, max(t1) OVER (PARTITION BY pid ORDER BY t0, t1, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM o)),
og AS (SELECT pid, sid, t0, t1, weight, stress, CAST(sum(st) OVER (PARTITION BY pid ORDER BY t0, t1, sid ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS gid FROM f),
grp AS (SELECT pid, gid, min(t0) AS t0, CAST(sum(weight) AS BIGINT) AS weight, bool_or(stress) AS stress FROM og GROUP BY pid, gid),
split AS (SELECT *, CASE WHEN coalesce(sum(weight) OVER (PARTITION BY pid ORDER BY t0 DESC, gid DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 0.2 * sum(weight) OVER (PARTITION BY pid) THEN 'test' ELSE 'train' END AS split FROM grp)
"""


def device_groups(spark: SparkSession, d: str) -> DataFrame:
    return splits.overlap_groups(devices(spark, d)).groupBy("pid", "gid").agg(F.min("t0").alias("t0"), F.sum("weight").alias("weight"), F.bool_or("stress").alias("stress"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    """(source, lang, score, y, p): labelled documents, their length as the score."""
    x = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return x.select("doc_id", "lang", "source", F.col("n_chars").alias("score"), F.col("quality").alias("y"), F.col("toxic").alias("p"))


SC = "WITH sc AS (SELECT doc_id, lang, source, n_chars AS score, quality AS y, toxic AS p FROM documents JOIN labels USING (doc_id))"
AUC = "(sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * (count(*) - sum(y)), 0)"


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Windows of each label by participant."""
    return cut(spark, d).groupBy("pid").agg(F.count("*").alias("n_windows"), *[F.count_if(F.col("y") == v).alias(k) for k, v in (("n_stress", 1), ("n_nostress", 0), ("n_unlabeled", -1))])


# ---- labels ----------------------------------------------------------------------------------------


@query("q01_sample_labels_two_sided", "SELECT event_id, pid, y FROM y")
def q01(spark, d):
    return labelled(spark, d).select("event_id", "pid", "y")


@query("q02_sample_labels_before_only", "SELECT event_id, pid, yb AS y FROM y")
def q02(spark, d):
    return labelled(spark, d, labels.before_only).select("event_id", "pid", "y")


@query("q03_interval_labels_valid_events", f"""SELECT a.event_id, coalesce(max(CASE WHEN b.t - {NEAR} >= e.t0 AND b.t + {NEAR} <= e.t1 THEN 1 WHEN b.t IS NOT NULL THEN -1 END), 0) AS y
FROM s a JOIN ses e ON a.pid = e.pid AND a.sid = e.sid LEFT JOIN s b ON a.pid = b.pid AND a.sid = b.sid AND b.tag AND abs(a.t - b.t) <= {NEAR} GROUP BY a.event_id""")
def q03(spark, d):
    rec = recordings(spark, d)
    tags = rec.filter("tag").select("pid", "sid", F.col("t").alias("tag_t"))
    return labels.interval_labels(rec, tags, session_table(rec), NEAR).select("event_id", "y")


# ---- windows ---------------------------------------------------------------------------------------


@query("q04_windows_purity", "SELECT pid, count(*) AS n_windows, CAST(count(*) FILTER (y = 1) AS BIGINT) AS n_stress, CAST(count(*) FILTER (y = 0) AS BIGINT) AS n_nostress, CAST(count(*) FILTER (y = -1) AS BIGINT) AS n_unlabeled FROM w GROUP BY pid")
def q04(spark, d):
    return flagship(spark, d)


@query("q05_window_offbody_filter", "SELECT pid, s, y, round(total / 10, 6) AS mean FROM w WHERE total / 10 >= 40")
def q05(spark, d):
    # by the panes' sums, as the SQL
    return rounded(cut(spark, d).withColumn("mean", F.col("total") / 10).filter("mean >= 40").select("pid", "s", "y", "mean"))


@query("q06_window_forecast_target", "SELECT pid, s, round(total, 4) AS total, yf FROM w")
def q06(spark, d):
    return cut(spark, d).select("pid", "s", F.round("total", 4).alias("total"), F.col("yf")[0].alias("yf"))


@query("q06b_window_spans", "SELECT pid, 3 * pane AS s, round(total, 4) AS total FROM (SELECT pid, pane, sum(n) OVER v AS m, sum(total) OVER v AS total FROM (SELECT pid, i // 3 AS pane, count(*) AS n, sum(x) AS total FROM r GROUP BY pid, i // 3) WINDOW v AS (PARTITION BY pid ORDER BY pane ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING)) WHERE m = 21")
def q06b(spark, d):
    return windows.spans(whole(spark, d, None), 7, 3).select("pid", "s", F.round("total", 4).alias("total"))


# ---- groups, splits, folds -------------------------------------------------------------------------


@query("q07_overlap_groups_islands", DEV + "SELECT pid, sid, gid FROM og", shared=False)
def q07(spark, d):
    return splits.overlap_groups(devices(spark, d)).select("pid", "sid", "gid")


@query("q08_chrono_split", DEV + "SELECT pid, gid, weight, split FROM split", shared=False)
def q08(spark, d):
    return splits.chrono_split(device_groups(spark, d)).select("pid", "gid", "weight", "split")


@query("q09_chrono_folds_by_groups", DEV + "SELECT pid, gid, CAST(greatest(0, ceil(sum(weight) OVER (PARTITION BY pid ORDER BY t0, gid ROWS UNBOUNDED PRECEDING) * 5 / sum(weight) OVER (PARTITION BY pid)) - 1) AS BIGINT) AS fold FROM grp", shared=False)
def q09(spark, d):
    return splits.group_folds(device_groups(spark, d)).select("pid", "gid", "fold")


@query("q10_window_folds_floor", "SELECT pid, s, CAST(floor((row_number() OVER (PARTITION BY pid ORDER BY s) - 1) * 5 / count(*) OVER (PARTITION BY pid)) AS BIGINT) AS fold FROM w")
def q10(spark, d):
    return splits.window_folds(cut(spark, d), 5, "s").select("pid", "s", "fold")


@query("q11_random_group_split", DEV + """, c AS (SELECT *, count(*) OVER v AS n, row_number() OVER (PARTITION BY pid, stress ORDER BY md5('42:' || pid || ':' || gid), gid) AS k FROM grp WINDOW v AS (PARTITION BY pid, stress))
SELECT pid, gid, CASE WHEN k <= CASE WHEN stress THEN greatest(0, least(greatest(round_even(n * 0.3, 0), 1), n - 1)) ELSE round_even(n * 0.3, 0) END THEN 'test' ELSE 'train' END AS split FROM c""", shared=False)
def q11(spark, d):
    return splits.random_group_split(device_groups(spark, d), 0.3, SEED).select("pid", "gid", "split")


@query("q12_stratified_split", "SELECT event_id, y, CASE WHEN row_number() OVER (PARTITION BY pid, y ORDER BY md5('42:' || event_id), event_id) <= round_even(count(*) OVER (PARTITION BY pid, y) * 0.2, 0) THEN 'test' ELSE 'train' END AS split FROM y WHERE y >= 0")
def q12(spark, d):
    return splits.stratified_split(labelled(spark, d).filter("y >= 0"), ["pid", "y"], "event_id", 0.2, SEED).select("event_id", "y", "split")


@query("q12b_tail_split", "SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY pid ORDER BY i DESC) <= 7 THEN 'test' ELSE 'train' END AS split FROM r")
def q12b(spark, d):
    return splits.tail_split(whole(spark, d, None), "pid", "i", F.lit(7)).select("event_id", "split")


@query("q13_leakage_violations", DEV + """, x AS (SELECT og.pid, og.gid, og.t0, split FROM og JOIN split USING (pid, gid))
SELECT pid, 'group on both sides' AS leak FROM x GROUP BY pid, gid HAVING count(DISTINCT split) > 1
UNION ALL SELECT pid, 'training after test' FROM x GROUP BY pid HAVING max(CASE WHEN split = 'train' THEN t0 END) >= min(CASE WHEN split = 'test' THEN t0 END)""", shared=False)
def q13(spark, d):
    split = splits.chrono_split(device_groups(spark, d)).select("pid", "gid", "split")
    return splits.leaks(splits.overlap_groups(devices(spark, d)).join(split, ["pid", "gid"]))


# ---- normalisation ---------------------------------------------------------------------------------


@query("q14_minmax_train", """, z AS (SELECT *, CASE WHEN i < 0.8 * count(*) OVER (PARTITION BY pid) THEN 'train' ELSE 'test' END AS split FROM r)
SELECT event_id, split, round((x - min(CASE WHEN split = 'train' THEN x END) OVER (PARTITION BY pid)) / (max(CASE WHEN split = 'train' THEN x END) OVER (PARTITION BY pid) - min(CASE WHEN split = 'train' THEN x END) OVER (PARTITION BY pid) + 1e-12), 6) AS x FROM z""")
def q14(spark, d):
    w = Window.partitionBy("pid")
    z = whole(spark, d, None).withColumn("split", F.when(F.col("i") < 0.8 * F.count("*").over(w), "train").otherwise("test"))
    train = F.when(F.col("split") == "train", F.col("x"))
    return z.select("event_id", "split", places((F.col("x") - F.min(train).over(w)) / (F.max(train).over(w) - F.min(train).over(w) + F.lit(1e-12)), 6).alias("x"))


@query("q15_session_zscore", "SELECT event_id, round((x - avg(x) OVER v) / (stddev_pop(x) OVER v + 1e-8), 4) AS z, round((x - avg(x) OVER v) / (stddev_samp(x) OVER v + 1e-8), 4) AS z1 FROM s WINDOW v AS (PARTITION BY pid, sid) QUALIFY count(*) OVER v > 1 AND stddev_pop(x) OVER v > 1e-3")
def q15(spark, d):
    w = Window.partitionBy("pid", "sid")
    c = F.col("x") - F.avg("x").over(w)
    z = recordings(spark, d).withColumns({"z": places(c / (F.stddev_pop("x").over(w) + F.lit(1e-8)), 4), "z1": places(c / (F.stddev_samp("x").over(w) + F.lit(1e-8)), 4), "n": F.count("*").over(w), "sd": F.stddev_pop("x").over(w)})
    return z.filter("n > 1 and sd > 1e-3").select("event_id", "z", "z1")


@query("q16_recording_minmax", "SELECT event_id, round(CASE WHEN max(x) OVER v > min(x) OVER v THEN (x - min(x) OVER v) / (max(x) OVER v - min(x) OVER v) ELSE 0 END, 6) AS x FROM s WINDOW v AS (PARTITION BY pid, sid)")
def q16(spark, d):
    w = Window.partitionBy("pid", "sid")
    lo, hi = F.min("x").over(w), F.max("x").over(w)
    return recordings(spark, d).select("event_id", F.round(F.when(hi > lo, (F.col("x") - lo) / (hi - lo)).otherwise(0.0), 6).alias("x"))


# ---- features of windows ---------------------------------------------------------------------------


@query("q17_eda_stats", "SELECT pid, s, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, min(x) AS min, max(x) AS max, round(max(x) - min(x), 6) AS range, round(median(x), 6) AS median, round(quantile_cont(x, 0.25), 6) AS p25, round(quantile_cont(x, 0.75), 6) AS p75 FROM wx GROUP BY pid, s")
def q17(spark, d):
    x = F.col("x")
    return rounded(points(cut(spark, d)).groupBy("pid", "s").agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), (F.max(x) - F.min(x)).alias("range"), F.median(x).alias("median"), F.percentile(x, 0.25).alias("p25"), F.percentile(x, 0.75).alias("p75")))


@query("q18_moments", """, m AS (SELECT pid, s, x - avg(x) OVER (PARTITION BY pid, s) AS c FROM wx)
SELECT pid, s, round(avg(c * c * c) / pow(avg(c * c), 1.5), 5) AS skew, round(avg(c * c * c * c) / pow(avg(c * c), 2) - 3, 5) AS kurt FROM m GROUP BY pid, s""")
def q18(spark, d):
    return points(cut(spark, d)).groupBy("pid", "s").agg(places(F.coalesce(F.skewness("x"), F.lit(0.0)), 5).alias("skew"), places(F.coalesce(F.kurtosis("x"), F.lit(0.0)), 5).alias("kurt"))


@query("q19_slope", "SELECT pid, s, round(regr_slope(x, i / 4.0), 5) AS slope FROM wx GROUP BY pid, s")
def q19(spark, d):
    return points(cut(spark, d)).groupBy("pid", "s").agg(places(F.regr_slope("x", F.col("i") / F.lit(4.0)), 5).alias("slope"))


@query("q20_diff_stats", """, a AS (SELECT *, x - lag(x) OVER v AS d1, x - 2 * lag(x) OVER v + lag(x, 2) OVER v AS d2 FROM wx WINDOW v AS (PARTITION BY pid, s ORDER BY i))
SELECT pid, s, round(avg(d1), 5) AS d1_mean, round(stddev_pop(d1), 5) AS d1_std, round(avg(abs(d1)), 5) AS d1_abs, round(avg(d2), 5) AS d2_mean, round(stddev_pop(d2), 5) AS d2_std FROM a GROUP BY pid, s""")
def q20(spark, d):
    d1 = F.expr("zip_with(slice(x, 2, 9), slice(x, 1, 9), (a, b) -> a - b)")
    both = cut(spark, d).select("pid", "s", d1.alias("d1")).withColumn("d2", F.expr("concat(zip_with(slice(d1, 2, 8), slice(d1, 1, 8), (a, b) -> a - b), array(cast(null as double)))"))
    x = both.select("pid", "s", F.explode(F.arrays_zip("d1", "d2")).alias("v")).select("pid", "s", "v.*")
    return rounded(x.groupBy("pid", "s").agg(F.avg("d1").alias("d1_mean"), F.stddev_pop("d1").alias("d1_std"), F.avg(F.abs("d1")).alias("d1_abs"), F.avg("d2").alias("d2_mean"), F.stddev_pop("d2").alias("d2_std")), 5)


@query("q21_trapezoid", """, a AS (SELECT pid, s, i, greatest(x - 50, 0) AS p, lag(greatest(x - 50, 0)) OVER (PARTITION BY pid, s ORDER BY i) AS q FROM wx)
SELECT pid, s, round(sum((p + q) / 2) / 4, 5) AS auc FROM a GROUP BY pid, s""")
def q21(spark, d):
    up = F.transform("x", lambda v: F.greatest(v - 50, F.lit(0.0)))
    area = F.expr("aggregate(zip_with(slice(u, 2, 9), slice(u, 1, 9), (a, b) -> (a + b) / 2), 0D, (s, v) -> s + v) / 4")
    return cut(spark, d).select("pid", "s", up.alias("u")).select("pid", "s", places(area, 5).alias("auc"))


BEATS = """, b AS (SELECT pid, sid, t AS bt, (t - lag(t) OVER (PARTITION BY pid, sid ORDER BY i)) / 20000 AS rr FROM s), ok AS (SELECT * FROM b WHERE rr > 0.3 AND rr < 2.0)
"""


def beats(spark: SparkSession, d: str) -> DataFrame:
    """(pid, sid, bt, rr): scaled gaps between events as beat intervals, clean ones only."""
    w = Window.partitionBy("pid", "sid").orderBy("i")
    return recordings(spark, d).select("pid", "sid", F.col("t").alias("bt"), ((F.col("t") - F.lag("t").over(w)) / 20000).alias("rr")).filter("rr > 0.3 and rr < 2.0")


@query("q22_hrv_features", BEATS + """, dd AS (SELECT *, rr - lag(rr) OVER (PARTITION BY pid ORDER BY bt) AS d FROM ok)
SELECT pid, count(*) AS n_beats, round(avg(rr), 6) AS mean_rr, round(stddev_pop(rr), 6) AS sdnn, round(sqrt(avg(d * d)), 6) AS rmssd, round(avg(CAST(abs(d) > 0.05 AS INTEGER)), 6) AS pnn50, round(60 / avg(rr), 6) AS mean_hr FROM dd GROUP BY pid""")
def q22(spark, d):
    return rounded(heart.variability(beats(spark, d), ["pid"]))


SPAN = 86_400.0


def one_recording(rows: DataFrame) -> DataFrame:
    """``rows`` of a participant's sessions as rows of the one recording that ``whole`` makes of them."""
    return rows.withColumn("sid", F.lit(0).cast("long"))


@query("q23_beats_in_window", BEATS + f", k AS (SELECT pid, s, t_start FROM w) SELECT k.pid, k.s, count(ok.bt) AS n_beats FROM k LEFT JOIN ok ON ok.pid = k.pid AND ok.bt >= k.t_start AND ok.bt < k.t_start + {SPAN} GROUP BY k.pid, k.s")
def q23(spark, d):
    return heart.beats_in(cut(spark, d), one_recording(beats(spark, d)), SPAN).groupBy("pid", "s").agg(F.count("bt").alias("n_beats"))


@query("q24_beat_count_rank_diff", BEATS + ", e AS (SELECT pid, s, t_start AS a, lead(t_start, 2) OVER (PARTITION BY pid ORDER BY s) AS z FROM w) SELECT e.pid, e.s, count(ok.bt) AS n_beats FROM e LEFT JOIN ok ON ok.pid = e.pid AND ok.bt >= e.a AND ok.bt < e.z WHERE e.z IS NOT NULL GROUP BY e.pid, e.s")
def q24(spark, d):
    starts = cut(spark, d).select("pid", "s", F.col("t_start").alias("t"))
    both = starts.unionByName(beats(spark, d).select("pid", F.col("bt").alias("t")), allowMissingColumns=True).withColumn("us", F.round(F.col("t") * 1e6).cast("long"))
    below = F.count_if(F.col("s").isNull()).over(Window.partitionBy("pid").orderBy("us").rangeBetween(Window.unboundedPreceding, -1))
    w = Window.partitionBy("pid").orderBy("s")
    ranks = both.withColumn("below", below).filter("s is not null")
    return ranks.select("pid", "s", (F.lead("below", 2).over(w) - F.col("below")).alias("n_beats")).filter("n_beats is not null")


@query("q25_tachogram_interp", BEATS + """, u AS (SELECT pid, event_id, t, NULL AS rr FROM r UNION ALL SELECT pid, NULL, bt, rr FROM ok),
v AS (SELECT *, max(CASE WHEN rr IS NOT NULL THEN t END) OVER a AS ta, min(CASE WHEN rr IS NOT NULL THEN t END) OVER z AS tz FROM u WINDOW a AS (PARTITION BY pid ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), z AS (PARTITION BY pid ORDER BY t RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
j AS (SELECT v.*, a.rr AS ra, z.rr AS rz FROM v LEFT JOIN ok a ON a.pid = v.pid AND a.bt = v.ta LEFT JOIN ok z ON z.pid = v.pid AND z.bt = v.tz WHERE event_id IS NOT NULL)
SELECT event_id, round(CASE WHEN ra IS NULL THEN rz WHEN rz IS NULL OR tz = ta THEN ra ELSE ra + (rz - ra) * (t - ta) / (tz - ta) END, 6) AS rr FROM j WHERE ra IS NOT NULL OR rz IS NOT NULL""")
def q25(spark, d):
    grid = samples(spark, d).withColumn("sid", F.lit(0).cast("long"))
    found = heart.tachogram(grid, beats(spark, d).withColumn("sid", F.lit(0).cast("long")))
    return found.filter("rr is not null").select("event_id", F.round("rr", 6).alias("rr"))


def long_sessions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Tags and recordings of a participant's whole time; a sample every 900 s stands for each of the regular signal."""
    s = samples(spark, d).withColumn("sid", F.lit(0).cast("long"))
    ses = s.groupBy("pid", "sid").agg(F.min("t").alias("t0"), F.max("t").alias("t1")).withColumn("n", F.floor((F.col("t1") - F.col("t0")) / 900))
    return s.filter("tag").select("pid", "sid", F.col("t").alias("tag_t")), ses


LS = ", ls AS (SELECT pid, min(t) AS t0, max(t) AS t1, floor((max(t) - min(t)) / 900) AS n FROM s0 GROUP BY pid)"


@query("q26_event_segments", LS + ", q AS (SELECT e.pid, e.t AS tag_t, CAST(floor(floor(e.t - t0) * (1 / 900.0)) AS BIGINT) AS k, n FROM s0 e JOIN ls USING (pid) WHERE e.tag AND e.t > t0 AND e.t < t1) SELECT pid, tag_t, k - 48 AS first, k + 48 AS last FROM q WHERE k - 80 >= 0 AND k + 80 <= n")
def q26(spark, d):
    return windows.event_segments(*long_sessions(spark, d), 48, 80, 1 / 900.0).select("pid", "tag_t", "first", "last")


@query("q27_complement_stretches", LS + """, b AS (SELECT pid, t0 AS b FROM ls UNION ALL SELECT pid, t1 FROM ls UNION ALL SELECT pid, t FROM s0 WHERE tag),
c AS (SELECT pid, b + 3600 AS lo, lead(b) OVER (PARTITION BY pid ORDER BY b) - 3600 AS hi FROM b) SELECT pid, round(lo, 3) AS lo, round(hi, 3) AS hi FROM c WHERE hi - lo >= 7200""")
def q27(spark, d):
    return rounded(windows.stretches(*long_sessions(spark, d), 3600.0, 7200.0).select("pid", "lo", "hi"), 3)


# ---- evaluation ------------------------------------------------------------------------------------


@query("q28_auc_rank", SC + f", k AS (SELECT lang, y, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0 AS r FROM sc) SELECT lang, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos, round({AUC}, 9) AS auc FROM k GROUP BY lang", shared=False)
def q28(spark, d):
    return rounded(metrics.auc(scored(spark, d), ["lang"]), 9)


@query("q29_confusion_metrics", SC + """, c AS (SELECT lang, count(*) FILTER (p = 1 AND y = 1) AS tp, count(*) FILTER (p = 1 AND y = 0) AS fp, count(*) FILTER (p = 0 AND y = 1) AS fn, count(*) FILTER (p = 0 AND y = 0) AS tn FROM sc GROUP BY lang)
SELECT *, round((tp + tn) / (tp + fp + fn + tn), 9) AS acc, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1,
round((coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2, 9) AS bal_acc FROM c""", shared=False)
def q29(spark, d):
    return rounded(metrics.confusion(scored(spark, d), ["lang"], "p", "y"), 9)


@query("q30_rmse_items", "SELECT l_returnflag AS item, round(sqrt(avg(pow(l_quantity - 50 * l_discount * 10, 2))), 6) AS rmse, count(*) AS n FROM lineitem GROUP BY l_returnflag UNION ALL SELECT 'all', round(sqrt(avg(pow(l_quantity - 50 * l_discount * 10, 2))), 6), count(*) FROM lineitem", shared=False)
def q30(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("item"), F.pow(F.col("l_quantity") - 50 * F.col("l_discount") * 10, F.lit(2)).alias("e"))
    sums = x.rollup("item").agg(F.round(F.sqrt(F.avg("e")), 6).alias("rmse"), F.count("*").alias("n"))
    return sums.select(F.coalesce("item", F.lit("all")).alias("item"), "rmse", "n")


@query("q31_pooled_vs_fold_auc", SC + f""", fo AS (SELECT *, doc_id % 5 AS fold FROM sc),
a AS (SELECT lang, fold, y, rank() OVER (PARTITION BY lang, fold ORDER BY score) + (count(*) OVER (PARTITION BY lang, fold, score) - 1) / 2.0 AS r FROM fo),
b AS (SELECT lang, avg(auc) AS m FROM (SELECT lang, fold, {AUC} AS auc FROM a GROUP BY lang, fold) GROUP BY lang),
k AS (SELECT lang, y, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0 AS r FROM sc)
SELECT lang, round({AUC}, 9) AS pooled_auc, round(any_value(m), 9) AS fold_mean_auc FROM k JOIN b USING (lang) GROUP BY lang""", shared=False)
def q31(spark, d):
    s = scored(spark, d).withColumn("fold", F.col("doc_id") % 5)
    fold = metrics.auc(s, ["lang", "fold"]).groupBy("lang").agg(F.avg("auc").alias("fold_mean_auc"))
    return rounded(metrics.auc(s, ["lang"]).select("lang", F.col("auc").alias("pooled_auc")).join(fold, "lang"), 9)


PRIO = "WITH t AS (SELECT o_orderpriority AS participant, avg(o_totalprice) AS train_auc, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1)"


@query("q32_mean_row_rollup", PRIO + " SELECT participant, round(train_auc, 4) AS train_auc, n FROM t UNION ALL SELECT 'MEAN', round(avg(train_auc), 4), sum(n) FROM t", shared=False)
def q32(spark, d):
    t = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("participant")).agg(F.avg("o_totalprice").alias("train_auc"), F.count("*").alias("n"))
    return metrics.with_mean_row(t, "participant", ("n",)).select("participant", F.round("train_auc", 4).alias("train_auc"), "n")


@query("q33_pivot_train_test", "SELECT l_returnflag AS participant, round(avg(l_extendedprice) FILTER (l_linestatus = 'F'), 4) AS train_auc, round(avg(l_extendedprice) FILTER (l_linestatus = 'O'), 4) AS test_auc FROM lineitem GROUP BY 1", shared=False)
def q33(spark, d):
    p = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("participant")).pivot("l_linestatus", ["F", "O"]).agg(F.round(F.avg("l_extendedprice"), 4))
    return p.select("participant", F.col("F").alias("train_auc"), F.col("O").alias("test_auc"))


@query("q34_crosstab_split_label", """, sp AS (SELECT pid, y, CASE WHEN row_number() OVER (PARTITION BY pid, y ORDER BY md5('42:' || event_id), event_id) <= round_even(count(*) OVER (PARTITION BY pid, y) * 0.2, 0) THEN 'test' ELSE 'train' END AS split FROM y WHERE y >= 0)
SELECT pid, count(*) FILTER (split = 'train' AND y = 0) AS train_0, count(*) FILTER (split = 'train' AND y = 1) AS train_1, count(*) FILTER (split = 'test' AND y = 0) AS test_0, count(*) FILTER (split = 'test' AND y = 1) AS test_1 FROM sp GROUP BY pid""")
def q34(spark, d):
    rows = splits.stratified_split(labelled(spark, d).filter("y >= 0"), ["pid", "y"], "event_id", 0.2, SEED).withColumn("k", F.concat_ws("_", "split", F.col("y").cast("string")))
    return rows.groupBy("pid").pivot("k", ["train_0", "train_1", "test_0", "test_1"]).count().na.fill(0)


@query("q35_full_outer_compare", """, a AS (SELECT pid, count(*) AS n10 FROM w WHERE y = 1 GROUP BY pid), b AS (SELECT pid, count(*) AS n60 FROM s WHERE y = 1 AND x > 100 GROUP BY pid)
SELECT coalesce(a.pid, b.pid) AS pid, n10, n60 FROM a FULL JOIN b ON a.pid = b.pid""")
def q35(spark, d):
    a = cut(spark, d).filter("y = 1").groupBy("pid").agg(F.count("*").alias("n10"))
    b = labelled(spark, d).filter("y = 1 and x > 100").groupBy("pid").agg(F.count("*").alias("n60"))
    return a.join(b, "pid", "full_outer")


@query("q36_left_join_extra", "SELECT n_name, coalesce(c.n, 0) AS n_customers, s.n AS n_suppliers FROM nation LEFT JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) c ON n_nationkey = c.k LEFT JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) s ON n_nationkey = s.k", shared=False)
def q36(spark, d):
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n_customers"))
    s = table(spark, d, "supplier").filter("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n_suppliers"))
    out = table(spark, d, "nation").join(c, "n_nationkey", "left").join(s, "n_nationkey", "left")
    return out.select("n_name", F.coalesce("n_customers", F.lit(0).cast("long")).alias("n_customers"), "n_suppliers")


@query("q37_resume_anti", "SELECT DISTINCT c_nationkey AS scope, c_mktsegment AS balance FROM customer EXCEPT SELECT c_nationkey, c_mktsegment FROM customer WHERE c_acctbal > 9000", shared=False)
def q37(spark, d):
    jobs = table(spark, d, "customer").select(F.col("c_nationkey").alias("scope"), F.col("c_mktsegment").alias("balance"), "c_acctbal")
    return jobs.select("scope", "balance").distinct().join(jobs.filter("c_acctbal > 9000"), ["scope", "balance"], "left_anti")


@query("q38_label_efficiency_curve", "SELECT CAST(l_linenumber AS INTEGER) AS n_labels, l_linestatus AS model, round(avg(l_discount), 6) AS auc_mean, round(coalesce(stddev_samp(l_discount), 0), 6) AS auc_sd FROM lineitem GROUP BY 1, 2", shared=False)
def q38(spark, d):
    return rounded(table(spark, d, "lineitem").groupBy(F.col("l_linenumber").cast("int").alias("n_labels"), F.col("l_linestatus").alias("model")).agg(F.avg("l_discount").alias("auc_mean"), F.coalesce(F.stddev_samp("l_discount"), F.lit(0.0)).alias("auc_sd")))


@query("q39_best_epoch", "SELECT l_orderkey AS run, (min({'e': l_linenumber, 'x': l_extendedprice})).x AS first_loss, (max({'e': l_linenumber, 'x': l_extendedprice})).x AS last_loss, min(l_extendedprice) AS best_loss, CAST((min({'x': l_extendedprice, 'e': l_linenumber})).e AS INTEGER) AS best_epoch FROM lineitem GROUP BY l_orderkey", shared=False)
def q39(spark, d):
    by_epoch, by_loss = F.struct("l_linenumber", "l_extendedprice"), F.struct("l_extendedprice", "l_linenumber")
    best = F.min(by_loss)
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("run")).agg(F.min(by_epoch)["l_extendedprice"].alias("first_loss"), F.max(by_epoch)["l_extendedprice"].alias("last_loss"), best["l_extendedprice"].alias("best_loss"), best["l_linenumber"].cast("int").alias("best_epoch"))


@query("q40_class_weights", "SELECT pid, y, n, round(sum(n) OVER (PARTITION BY pid) / (2 * n), 6) AS weight FROM (SELECT pid, y, count(*) AS n FROM y WHERE y >= 0 GROUP BY pid, y)")
def q40(spark, d):
    return rounded(metrics.class_weights(labelled(spark, d).filter("y >= 0"), ["pid"]))


# ---- balancing -------------------------------------------------------------------------------------


@query("q41_undersample", ", k AS (SELECT event_id, pid, y, least(sum(y) OVER v, sum(1 - y) OVER v) AS m, row_number() OVER (PARTITION BY pid, y ORDER BY md5('42:' || event_id), event_id) AS k FROM y WHERE y >= 0 WINDOW v AS (PARTITION BY pid)) SELECT event_id, y FROM k WHERE k <= m")
def q41(spark, d):
    return balance.undersample(labelled(spark, d).filter("y >= 0"), ["pid"], "event_id", SEED).select("event_id", "y")


@query("q42_undersample_replacement", """, lab AS (SELECT doc_id, quality AS y FROM labels), c AS (SELECT count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM lab),
dr AS (SELECT unnest(range(1, pos + 1)) AS draw, neg FROM c), k AS (SELECT draw, CAST('0x' || substr(md5('42:' || draw), 1, 8) AS BIGINT) % neg AS slot FROM dr),
ng AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS slot FROM lab WHERE y = 0)
SELECT doc_id, y, CAST(0 AS BIGINT) AS draw FROM lab WHERE y = 1 UNION ALL SELECT doc_id, 0, draw FROM k JOIN ng USING (slot)""")
def q42(spark, d):
    return balance.undersample_with_replacement(table(spark, d, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id", SEED).select("doc_id", "y", "draw")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """The vectors of every label, as windows."""
    return table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


KNN = """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
di AS (SELECT a.vec_id, b.vec_id AS other, round(sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 9) AS dist FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id),
nn AS (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY dist, other) AS INTEGER) AS rank FROM di)
"""


@query("q43_knn_topk", KNN + "SELECT vec_id, rank, other, round(dist, 6) AS dist FROM nn WHERE rank <= 5", shared=False)
def q43(spark, d):
    return rounded(balance.neighbours(vectors(spark, d), 5, group="label").select("vec_id", "rank", "other", "dist"))


@query("q44_smote", KNN + """, k AS (SELECT *, count(*) OVER (PARTITION BY vec_id) AS n FROM nn WHERE rank <= 5),
pk AS (SELECT vec_id, other, CAST('0x' || substr(md5('43:' || vec_id), 1, 8) AS BIGINT) / 4294967296.0 AS lam FROM k WHERE rank = CAST('0x' || substr(md5('42:' || vec_id), 1, 8) AS BIGINT) % n + 1)
SELECT vec_id, other, round(lam, 9) AS lam, round(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] + lam * (z[2] - z[1]))), 6) AS total FROM pk JOIN v a USING (vec_id) JOIN v b ON b.vec_id = pk.other""", shared=False)
def q44(spark, d):
    s = balance.smote(vectors(spark, d), 5, SEED, group="label")
    return s.select("vec_id", "other", F.round("lam", 9).alias("lam"), places(F.expr("aggregate(v, 0D, (a, x) -> a + x)"), 6).alias("total"))


EVERY = KNN.replace("a.label = b.label AND a.vec_id <> b.vec_id", "a.vec_id <> b.vec_id")


@query("q43b_knn_topk_all", EVERY + "SELECT vec_id, rank, other, round(dist, 6) AS dist FROM nn WHERE rank <= 5", shared=False)
def q43b(spark, d):
    # among all vectors, whatever their labels
    return rounded(balance.neighbours(vectors(spark, d), 5).select("vec_id", "rank", "other", "dist"))


@query("q44b_smote_all", ORACLE["q44_smote"].replace(KNN, EVERY), shared=False)
def q44b(spark, d):
    s = balance.smote(vectors(spark, d), 5, SEED)
    return s.select("vec_id", "other", F.round("lam", 9).alias("lam"), places(F.expr("aggregate(v, 0D, (a, x) -> a + x)"), 6).alias("total"))


@query("q45_norm_artefact", ", f AS (SELECT pid, s, y, stddev_pop(x) AS sd, max(x) - min(x) AS rg FROM wx WHERE y >= 0 GROUP BY pid, s, y) SELECT y, count(*) AS n, round(median(sd), 6) AS median_std, round(median(rg), 6) AS median_range, round(avg(CAST(rg < 100 AS INTEGER)), 6) AS share_flat FROM f GROUP BY y")
def q45(spark, d):
    f = points(cut(spark, d)).filter("y >= 0").groupBy("pid", "s", "y").agg(F.stddev_pop("x").alias("sd"), (F.max("x") - F.min("x")).alias("rg"))
    out = f.groupBy("y").agg(F.count("*").alias("n"), F.avg((F.col("rg") < 100).cast("int")).alias("share_flat"))
    for c, name in (("sd", "median_std"), ("rg", "median_range")):
        out = out.join(metrics.quantiles(f, ["y"], c, {name: 0.5}), "y")
    return rounded(out.select("y", "n", "median_std", "median_range", "share_flat"))


@query("q45b_range_auc", f", f AS (SELECT pid, s, y, round(max(x) - min(x), 6) AS rg FROM wx WHERE y >= 0 GROUP BY pid, s, y), k AS (SELECT y, rank() OVER (ORDER BY rg) + (count(*) OVER (PARTITION BY rg) - 1) / 2.0 AS r FROM f) SELECT count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos, round({AUC}, 9) AS auc FROM k")
def q45b(spark, d):
    f = points(cut(spark, d)).filter("y >= 0").groupBy("pid", "s", "y").agg(F.round(F.max("x") - F.min("x"), 6).alias("score"))
    return rounded(metrics.auc(f.withColumn("g", F.lit(1)), ["g"]).drop("g"), 9)


@query("q46_param_grid_jobs", "SELECT r_name AS scope, m AS model, n AS n_labels, CAST(k AS INTEGER) AS repeat FROM region, (VALUES ('ssl'), ('supervised')) a(m), (VALUES (5), (10), (20), (50), (100), (200), (500)) b(n), range(3) c(k)", shared=False)
def q46(spark, d):
    models = spark.createDataFrame([("ssl",), ("supervised",)], "model string")
    sizes = spark.createDataFrame([(n,) for n in (5, 10, 20, 50, 100, 200, 500)], "n_labels int")
    repeats = spark.range(3).select(F.col("id").cast("int").alias("repeat"))
    return table(spark, d, "region").select(F.col("r_name").alias("scope")).crossJoin(models).crossJoin(sizes).crossJoin(repeats)


STAI = [("# ORDER;Base;TSST;Fun", None), ("# STAI;1;2;3;4;1;2", 0), ("# STAI;4;3;2;1;4;4", 1), ("# STAI;2;2;2;2;3;1", 2)]


@query("q47_stai_map", """WITH m AS (SELECT * FROM (VALUES ('Base', 0.25, 0.5), ('TSST', 1.0, 0.75), ('Fun', 0.5, 0.5)) v(block, q1, q2))
SELECT c_custkey, m.block, CAST(q1 AS DOUBLE) AS q1, CAST(q2 AS DOUBLE) AS q2 FROM customer JOIN m ON m.block = CASE c_custkey % 4 WHEN 0 THEN 'Base' WHEN 1 THEN 'TSST' WHEN 2 THEN 'Fun' END""", shared=False)
def q47(spark, d):
    rows = spark.createDataFrame(STAI, "line string, k int").select(F.split("line", ";").alias("f"), "k")
    order = rows.filter(F.col("f")[0] == "# ORDER").select(F.posexplode(F.slice("f", 2, F.size("f"))).alias("k", "block"))
    stai = rows.filter(F.col("f")[0] == "# STAI").select("k", F.transform(F.slice("f", 2, 6), lambda v: v.cast("double") / 4).alias("items"))
    m = order.join(stai, "k").select("block", F.col("items")[0].alias("q1"), F.col("items")[1].alias("q2"))
    block = F.create_map(*[F.lit(x) for x in (0, "Base", 1, "TSST", 2, "Fun")])[(F.col("c_custkey") % 4).cast("int")]
    return table(spark, d, "customer").select("c_custkey", block.alias("block")).join(F.broadcast(m), "block")  # three literal rows


# ---- kernels and models (no SQL) -------------------------------------------------------------------


@query("q48_lowpass_filtfilt")
def q48(spark, d):
    return rounded(kernels.lowpass(recordings(spark, d)))


@query("q49_phasic_tonic_scr")
def q49(spark, d):
    return rounded(kernels.phasic(cut(spark, d)))


FEATURES = ["mean", "sd", "slope", "range"]


def feature_rows(spark: SparkSession, d: str) -> DataFrame:
    """Features of windows; y says whether a window holds any stress sample (pure ones are too few here)."""
    x = F.col("x")
    return points(cut(spark, d).withColumn("y", F.col("any").cast("int"))).groupBy("pid", "s", "y").agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"), F.regr_slope("x", F.col("i") / F.lit(4.0)).alias("slope"), (F.max(x) - F.min(x)).alias("range"))


def cohorts(rows: DataFrame) -> DataFrame:
    """Personal models need more rows than this table has of one user: users of one last digit make a cohort."""
    return rows.withColumn("pid", F.col("pid") % 10)


@query("q50_logreg_cv_auc")
def q50(spark, d):
    rows = cohorts(feature_rows(spark, d).withColumn("user", F.col("pid")))
    oof = models.logistic_cv(splits.window_folds(rows, 5, "s", "user"), FEATURES)
    fold = metrics.auc(oof, ["pid", "fold"]).groupBy("pid").agg(F.avg("auc").alias("fold_mean_auc"))
    return rounded(metrics.auc(oof, ["pid"]).join(fold, "pid"))


@query("q51_ridge_pretext")
def q51(spark, d):
    return rounded(models.ridge_pretext(cohorts(cut(spark, d).withColumn("sid", F.col("pid")))))


@query("q52_label_curve_models")
def q52(spark, d):
    rows = feature_rows(spark, d).withColumn("key", F.concat_ws("/", "pid", "s"))
    split = splits.stratified_split(rows, ["y"], "key", 0.3, SEED)
    return rounded(models.label_curve(split.select("key", "y", "split", *FEATURES), FEATURES, [10, 20, 50, 100], 3))


from . import overlapping, protocols, reports, trained  # noqa: E402, F401  (they register their queries)
