"""Queries of reports: manifests, comparisons, curves and tables as they are shown or drawn."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import metrics, splits
from ..sources.tables import samples, table
from .catalog import AUC, PRIO, SC, cut, labelled, q20, q35, query, rounded, scored


@query("q65_manifest", """, m AS (SELECT pid, min(t) AS t0, max(t) AS t1, CAST(count(*) FILTER (tag) AS BIGINT) AS n_tags, count(*) FILTER (y = -1) AS n_buffer FROM y GROUP BY pid), f AS (SELECT pid, s, floor((row_number() OVER (PARTITION BY pid ORDER BY s) - 1) * 5 / count(*) OVER (PARTITION BY pid)) AS fold FROM w),
c AS (SELECT pid, count(*) AS n, count(*) FILTER (fold = 4) AS n_te FROM f GROUP BY pid)
SELECT pid, 'W' AS device, strftime(to_timestamp(floor(t0)) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS start_utc, round_even((t1 - t0) / 3600, 2) AS hours, n_tags, round_even(n_te / n, 3) AS test_frac, round_even(n_buffer * 900 / 3600, 2) AS buffer_hours FROM m JOIN c USING (pid)""")
def q65(spark, d):
    m = labelled(spark, d).groupBy("pid").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.count_if("tag").alias("n_tags"), F.count_if(F.col("y") == -1).alias("n_buffer"))
    c = splits.window_folds(cut(spark, d), 5, "s").groupBy("pid").agg(F.count("*").alias("n"), F.count_if(F.col("fold") == 4).alias("n_te"))
    start = F.date_format(F.timestamp_seconds(F.floor("t0")), "yyyy-MM-dd HH:mm:ss")
    return m.join(c, "pid").select("pid", F.lit("W").alias("device"), start.alias("start_utc"), F.bround((F.col("t1") - F.col("t0")) / 3600, 2).alias("hours"), "n_tags", F.bround(F.col("n_te") / F.col("n"), 3).alias("test_frac"), F.bround(F.col("n_buffer") * 900 / F.lit(3600), 2).alias("buffer_hours"))


@query("q66_largest_loss", "SELECT max(greatest(l_discount, l_tax)) AS top FROM lineitem", shared=False)
def q66(spark, d):
    return table(spark, d, "lineitem").agg(F.max(F.greatest("l_discount", "l_tax")).alias("top"))


@query("q67_item_score_auc", f"""WITH c AS (SELECT l_linestatus AS lang, round(0.5 * l_quantity - l_extendedprice / 1000 + 100 * l_discount, 6) AS score, CAST(l_returnflag = 'R' AS INTEGER) AS y FROM lineitem),
k AS (SELECT lang, y, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0 AS r FROM c) SELECT lang, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos, round({AUC}, 9) AS auc FROM k GROUP BY lang""", shared=False)
def q67(spark, d):
    score = F.round(0.5 * F.col("l_quantity") - F.col("l_extendedprice") / 1000 + 100 * F.col("l_discount"), 6)
    return rounded(metrics.auc(table(spark, d, "lineitem").select(F.col("l_linestatus").alias("lang"), score.alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("y")), ["lang"]), 9)


@query("q68_paper_rows", PRIO + " SELECT 'ours' AS source, participant AS scope, round(train_auc, 4) AS acc, n FROM t WHERE participant IN ('1-URGENT', '2-HIGH') AND train_auc IS NOT NULL UNION ALL VALUES ('paper', 'Table I', 0.98, 0.0), ('paper', 'Table II', 0.87, 0.0)", shared=False)
def q68(spark, d):
    t = table(spark, d, "orders").filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).groupBy(F.col("o_orderpriority").alias("scope")).agg(F.round(F.avg("o_totalprice"), 4).alias("acc"), F.count("*").cast("double").alias("n"))
    paper = spark.createDataFrame([("paper", "Table I", 0.98, 0.0), ("paper", "Table II", 0.87, 0.0)], "source string, scope string, acc double, n double")
    return t.filter("acc is not null").withColumn("source", F.lit("ours")).select("source", "scope", "acc", "n").unionByName(paper)


@query("q69_ordered_features", "SELECT pid, s, round(total / 10, 6) AS mean, row_number() OVER (PARTITION BY pid ORDER BY round(total / 10, 6) DESC, s) AS place FROM w ORDER BY pid, place")
def q69(spark, d):
    x = rounded(cut(spark, d).select("pid", "s", (F.col("total") / 10).alias("mean")))
    return x.withColumn("place", F.row_number().over(Window.partitionBy("pid").orderBy(F.desc("mean"), "s")).cast("long")).orderBy("pid", "place")


@query("q70_union_of_participants", "SELECT pid FROM w WHERE y = 1 UNION SELECT pid FROM s WHERE x > 450")
def q70(spark, d):
    return cut(spark, d).filter("y = 1").select("pid").union(samples(spark, d).filter("x > 450").select("pid")).distinct()


FOLDS = SC + f""", fo AS (SELECT *, doc_id % 5 AS fold FROM sc), a AS (SELECT lang, fold, y, rank() OVER (PARTITION BY lang, fold ORDER BY score) + (count(*) OVER (PARTITION BY lang, fold, score) - 1) / 2.0 AS r FROM fo), fa AS (SELECT lang, fold, {AUC} AS auc FROM a GROUP BY lang, fold)"""


def fold_aucs(spark, d):
    return metrics.auc(scored(spark, d).withColumn("fold", F.col("doc_id") % 5), ["lang", "fold"])


@query("q71_fold_auc_sd", FOLDS + " SELECT lang, count(auc) AS folds, round(avg(auc), 9) AS auc_mean, round(stddev_samp(auc), 9) AS auc_sd FROM fa GROUP BY lang", shared=False)
def q71(spark, d):
    return rounded(fold_aucs(spark, d).groupBy("lang").agg(F.count("auc").alias("folds"), F.avg("auc").alias("auc_mean"), F.stddev_samp("auc").alias("auc_sd")), 9)


@query("q72_auc_by_person", FOLDS + " SELECT lang, round(max(auc) FILTER (fold = 0), 9) AS train_auc, round(max(auc) FILTER (fold = 1), 9) AS test_auc FROM fa WHERE lang <> 'MEAN' GROUP BY lang ORDER BY test_auc DESC", shared=False)
def q72(spark, d):
    p = fold_aucs(spark, d).filter("lang != 'MEAN'").groupBy("lang").pivot("fold", [0, 1]).agg(F.round(F.max("auc"), 9))
    return p.select("lang", F.col("0").alias("train_auc"), F.col("1").alias("test_auc")).orderBy(F.desc("test_auc"))


@query("q73_cv_error_bars", FOLDS + ", m AS (SELECT lang, avg(auc) AS m, coalesce(stddev_samp(auc) FILTER (fold < 1), 0) AS sd0, coalesce(stddev_samp(auc), 0) AS sd FROM fa GROUP BY lang) SELECT lang, round(m, 9) AS auc, round(m - sd, 9) AS low, round(m + sd, 9) AS high, sd0 AS one_fold_sd FROM m", shared=False)
def q73(spark, d):
    none = F.lit(0.0)
    m = fold_aucs(spark, d).groupBy("lang").agg(F.avg("auc").alias("m"), F.coalesce(F.stddev_samp("auc"), none).alias("sd"), F.coalesce(F.stddev_samp(F.when(F.col("fold") < 1, F.col("auc"))), none).alias("one_fold_sd"))
    return rounded(m.select("lang", F.col("m").alias("auc"), (F.col("m") - F.col("sd")).alias("low"), (F.col("m") + F.col("sd")).alias("high"), "one_fold_sd"), 9)


@query("q74_feature_sets", SC + f""", l AS (SELECT lang, y, length(source) + score % 7 AS score FROM sc), k AS (SELECT lang, y, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0 AS r FROM sc), j AS (SELECT lang, y, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0 AS r FROM l),
a AS (SELECT lang, {AUC} AS eda FROM k GROUP BY lang), b AS (SELECT lang, {AUC} AS eda_hrv FROM j GROUP BY lang), c AS (SELECT lang, eda, eda_hrv, eda_hrv - eda AS gain FROM a JOIN b USING (lang))
SELECT lang, round(eda, 9) AS eda, round(eda_hrv, 9) AS eda_hrv, round(gain, 9) AS gain FROM c UNION ALL SELECT 'MEAN', round(avg(eda), 9), round(avg(eda_hrv), 9), round(avg(gain), 9) FROM c""", shared=False)
def q74(spark, d):
    s = scored(spark, d)
    a = metrics.auc(s, ["lang"]).select("lang", F.col("auc").alias("eda"))
    b = metrics.auc(s.withColumn("score", F.length("source") + F.col("score") % 7), ["lang"]).select("lang", F.col("auc").alias("eda_hrv"))
    c = a.join(b, "lang").withColumn("gain", F.col("eda_hrv") - F.col("eda"))
    return rounded(metrics.with_mean_row(c, "lang"), 9)


@query("q75_compare_with_mean", """, a AS (SELECT pid, count(*) AS n10 FROM w WHERE y = 1 GROUP BY pid), b AS (SELECT pid, count(*) AS n60 FROM s WHERE y = 1 AND x > 100 GROUP BY pid),
j AS (SELECT coalesce(a.pid, b.pid) AS pid, n10, n60 FROM a FULL JOIN b ON a.pid = b.pid)
SELECT CAST(pid AS VARCHAR) AS pid, CAST(n10 AS DOUBLE) AS n10, CAST(n60 AS DOUBLE) AS n60 FROM j UNION ALL SELECT 'MEAN', round(avg(n10), 6), round(avg(n60), 6) FROM j""")
def q75(spark, d):
    return rounded(metrics.with_mean_row(q35(spark, d), "pid"))


@query("q78_chosen_jobs", "SELECT DISTINCT c_nationkey AS scope, c_mktsegment AS balance FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey < 10 EXCEPT SELECT c_nationkey, c_mktsegment FROM customer WHERE c_acctbal > 9000", shared=False)
def q78(spark, d):
    return chosen_jobs(table(spark, d, "customer").select(F.col("c_nationkey").alias("scope"), F.col("c_mktsegment").alias("balance"), "c_acctbal"), {"balance": ["BUILDING", "MACHINERY"], "scope": list(range(10))})


def chosen_jobs(jobs, only: dict[str, list]):
    """Jobs of a grid that run parameters name (a parameter without values names all) and that are not done yet."""
    for c, values in only.items():
        jobs = jobs.filter(F.col(c).isin(values)) if values else jobs
    keys = list(only)
    return jobs.select(*keys).distinct().join(jobs.filter("c_acctbal > 9000"), keys, "left_anti")


@query("q79_first_and_last", "SELECT pid, event_id, CASE WHEN k <= 5 THEN 'first' ELSE 'last' END AS part FROM (SELECT pid, event_id, row_number() OVER (PARTITION BY pid ORDER BY i) AS k, row_number() OVER (PARTITION BY pid ORDER BY i DESC) AS b FROM r) WHERE k <= 5 OR b <= 3")
def q79(spark, d):
    rows = samples(spark, d).select("pid", "event_id", "t")
    first = splits.first_rows(rows, ["pid"], [F.col("t"), F.col("event_id")], 5, ["event_id"]).withColumn("part", F.lit("first"))
    last = splits.first_rows(rows, ["pid"], [F.desc("t"), F.desc("event_id")], 3, ["event_id"]).withColumn("part", F.lit("last"))
    both = first.unionByName(last)
    return both.groupBy("pid", "event_id").agg(F.min("part").alias("part"))


@query("q89_columns_by_prefix", ", a AS (SELECT *, x - lag(x) OVER (PARTITION BY pid, s ORDER BY i) AS d1 FROM wx) SELECT pid, s, round(avg(d1), 5) AS eda_d1_mean, round(stddev_pop(d1), 5) AS eda_d1_std, round(avg(abs(d1)), 5) AS eda_d1_abs FROM a GROUP BY pid, s")
def q89(spark, d):
    # keys and the columns of one family, renamed
    rows = q20(spark, d)
    return rows.select("pid", "s", *[F.col(c).alias(f"eda_{c}") for c in rows.columns if c.startswith("d1_")])
