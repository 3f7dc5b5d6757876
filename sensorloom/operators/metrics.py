"""Evaluation: exact rank AUC, confusion measures, RMSE, total rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Score buckets for each doubling of a score's size.
FINE = 4_096


def score_bucket(score: Column) -> Column:
    """A whole number that never falls as the score grows: a bucket for each 1 / FINE of a doubling, on either side of 0."""
    size = F.floor(F.log2(F.abs(score)) * FINE) + 1_100 * FINE  # doubles reach down to 2^-1074
    return F.when(score > 0, size).when(score < 0, -size).when(score == 0, F.lit(0).cast("long"))


def auc(rows: DataFrame, keys: list[str], score: str = "score", y: str = "y") -> DataFrame:
    """(keys, n, n_pos, auc): ROC AUC with midranks for ties; null where a class is missing.  Rows without a label or score do not count.

    Scores are counted before they are ranked, and ranked inside buckets of like scores, so a group with most of the
    rows is many tasks' work; only its buckets, whose number does not grow with the rows, are put in order.
    """
    neg = F.col("n") - F.col("pos")
    half = F.lit(2.0).cast("double")
    rows = rows.filter(F.col(y).isNotNull() & F.col(score).isNotNull())
    counts = rows.groupBy(*keys, score).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("long")).alias("pos"))
    counts = counts.withColumn("bucket", score_bucket(F.col(score).cast("double")))
    inside = F.coalesce(F.sum(neg).over(Window.partitionBy(*keys, "bucket").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = counts.withColumn("won", F.col("pos") * (inside + neg / half)).groupBy(*keys, "bucket").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.sum("won").alias("won"))
    below = F.coalesce(F.sum(neg).over(Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = parts.withColumn("won", F.col("won") + F.col("pos") * below).groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("pos").alias("n_pos"), F.sum("won").alias("won"))
    both = F.col("n_pos") * (F.col("n") - F.col("n_pos"))
    return out.select(*keys, "n", "n_pos", F.when(both > 0, F.col("won") / both).alias("auc"))


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(keys, a column for each of ``shares``): exact quantiles, between two values on the line between them; nulls do not count.

    Values are counted by bucket; only the buckets that hold a wanted rank are looked into, each by itself, and equal values
    are one row with a count.  So a group with most of the rows is many tasks' work.
    """
    plain = lambda d: [F.col(f"w.{k}").eqNullSafe(F.col(f"{d}.{k}")) for k in keys]
    x = rows.select(*keys, F.col(value).cast("double").alias("v")).filter("v is not null")
    each = x.groupBy(*keys, score_bucket(F.col("v")).alias("bucket"), "v").agg(F.count("*").alias("m"))
    sums = each.groupBy(*keys, "bucket").agg(F.sum("m").alias("m"))
    g = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("m").over(g.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = F.array(*[f(F.col("n_") - 1).cast("long") for q in shares.values() for f in (lambda n, q=q: F.floor(n * q), lambda n, q=q: F.ceil(n * q))])
    placed = sums.withColumns({"before": before, "n_": F.sum("m").over(g)})
    wanted = placed.withColumn("rank", F.explode(F.array_distinct(ranks))).filter((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("m")))
    inside = Window.partitionBy(*keys, "bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = each.alias("e").join(wanted.select(*keys, "bucket").distinct().alias("w"), [*plain("e"), F.col("e.bucket") == F.col("w.bucket")], "left_semi").withColumn("upto", F.sum("m").over(inside))
    on = [*plain("e"), F.col("e.bucket") == F.col("w.bucket"), F.col("w.rank") < F.col("w.before") + F.col("upto"), F.col("w.rank") >= F.col("w.before") + F.col("upto") - F.col("e.m")]
    hit = near.alias("e").join(wanted.alias("w"), on).select(*[F.col(f"e.{k}").alias(k) for k in keys], "w.n_", "w.rank", "e.v")
    of = lambda r: F.max(F.when(F.col("rank") == r.cast("long"), F.col("v")))
    out = {}
    for name, q in shares.items():
        at = (F.col("n_") - 1) * q
        low, high = of(F.floor(at)), of(F.ceil(at))
        out[name] = low + (high - low) * (F.first(at) - F.floor(F.first(at)))
    return hit.groupBy(*keys).agg(*[c.alias(n) for n, c in out.items()])


def confusion(rows: DataFrame, keys: list[str], predicted: str, y: str) -> DataFrame:
    """(keys, tp, fp, fn, tn, acc, precision, recall, f1, bal_acc); a ratio over nothing is 0."""
    p, t = F.col(predicted) == 1, F.col(y) == 1
    c = rows.groupBy(*keys).agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"), F.count_if(~p & ~t).alias("tn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select("*", ratio(tp + tn, tp + fp + fn + tn).alias("acc"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ((ratio(tp, tp + fn) + ratio(tn, tn + fp)) / 2).alias("bal_acc"))


def with_mean_row(rows: DataFrame, key: str, sums: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` and a row named MEAN of the averages of its numeric columns (sums for those named)."""
    numeric = [c for c, t in rows.dtypes if c != key and t != "string"]
    mean = rows.agg(*[(F.sum(c) if c in sums else F.avg(c)).alias(c) for c in numeric]).withColumn(key, F.lit("MEAN"))
    return rows.withColumns({c: F.col(c).cast("double") for c in numeric}).withColumn(key, F.col(key).cast("string")).unionByName(mean.withColumns({c: F.col(c).cast("double") for c in numeric}), allowMissingColumns=True)


def class_weights(rows: DataFrame, keys: list[str], y: str = "y") -> DataFrame:
    """(keys, y, n, weight): balanced weights, rows over twice the rows of the class."""
    c = rows.groupBy(*keys, y).agg(F.count("*").alias("n"))
    return c.withColumn("weight", F.sum("n").over(Window.partitionBy(*keys)) / (2 * F.col("n")))
