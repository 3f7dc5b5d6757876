"""Beat intervals beside samples and windows: interpolation, counts by rank and by time, heart-rate variability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import DAY, carry, dealt


def micros(t: Column | str) -> Column:
    """Seconds as whole microseconds, for frames that end just before a time."""
    return F.round((F.col(t) if isinstance(t, str) else t) * 1e6).cast("long")


def tachogram(samples: DataFrame, beats: DataFrame, bucket: float = DAY) -> DataFrame:
    """``samples`` (pid, sid, t, ...) with rr, the beat intervals (pid, sid, bt, rr) interpolated at t, and below, the beats before t.

    Before the first and after the last beat their own intervals hold; recordings without beats have no rr.  Rows meet in
    buckets of time; the last beat before a bucket, the first one behind it and the number of those before come from the
    buckets' summaries, over any gap without beats.
    """
    both = samples.unionByName(beats.select("pid", "sid", F.col("bt").alias("t"), F.col("rr").alias("beat_rr")), allowMissingColumns=True).withColumn("us", micros("t"))
    w = Window.partitionBy("pid", "sid", "__k")
    beat = F.when(F.col("beat_rr").isNotNull(), F.struct(F.col("t").alias("bt"), F.col("beat_rr").alias("rr")))
    to_here = lambda o: o.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    past, ahead = (Window.unboundedPreceding, -1), (1, Window.unboundedFollowing)
    summary = {"__last": F.max(beat), "__first": F.min(beat), "__beats": F.count("beat_rr")}
    # buckets go by microseconds, as the counts do: beats within one microsecond of a sample are in its bucket
    met = carry(dealt(both, F.col("us"), bucket * 1e6), ["pid", "sid"], summary, lambda o: {
        "__from": F.max("__last").over(o.rowsBetween(*past)), "__to": F.min("__first").over(o.rowsBetween(*ahead)), "__until": F.sum("__beats").over(o.rowsBetween(*past)),
    })
    found = met.withColumns(
        {
            "beat_before": F.coalesce(F.max(beat).over(to_here(w.orderBy("t"))), "__from"), "beat_after": F.coalesce(F.min(beat).over(to_here(w.orderBy(F.desc("t")))), "__to"),
            "below": F.coalesce("__until", F.lit(0)) + F.count_if(F.col("beat_rr").isNotNull()).over(w.orderBy("us").rangeBetween(Window.unboundedPreceding, -1)),
        }
    )
    a, z = F.col("beat_before"), F.col("beat_after")
    line = a["rr"] + (z["rr"] - a["rr"]) * (F.col("t") - a["bt"]) / (z["bt"] - a["bt"])
    rr = F.when(a.isNull(), z["rr"]).when(z.isNull() | (z["bt"] == a["bt"]), a["rr"]).otherwise(line)
    return found.filter("beat_rr is null").withColumn("rr", rr).drop("beat_rr", "us", "beat_before", "beat_after", "__k", "__from", "__to", "__until")


def beats_in(windows: DataFrame, beats: DataFrame, span: float, keys: tuple[str, ...] = ("pid", "sid")) -> DataFrame:
    """(keys, s, bt, rr): the beats (keys, bt, rr) in [t_start, t_start + span) of each window (keys, s, t_start); windows without beats have one row of nulls.

    ``keys`` name a recording: beats of another one, at the same time, do not count.
    """
    # beats meet the two buckets that a window of one bucket's length can touch
    b = beats.select(*keys, "bt", "rr", F.floor(F.col("bt") / span).alias("k"))
    k = F.floor(F.col("t_start") / span)
    w = windows.select(*keys, "s", "t_start", F.explode(F.array(k, k + 1)).alias("k"))
    hit = (F.col("bt") >= F.col("t_start")) & (F.col("bt") < F.col("t_start") + span)
    inside = lambda c: F.when(hit, F.col(c)).alias(c)
    return w.join(b, [*keys, "k"], "left").select(*keys, "s", inside("bt"), inside("rr"))


def variability(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_beats, mean_rr, sdnn, rmssd, pnn50, mean_hr) of beats (keys, bt, rr) in the order of their times; rows without a beat count none."""
    x = rows.withColumn("d", F.col("rr") - F.lag("rr").over(Window.partitionBy(*keys).orderBy(F.col("bt").asc_nulls_last())))
    return x.groupBy(*keys).agg(
        F.count("rr").alias("n_beats"), F.avg("rr").alias("mean_rr"), F.stddev_pop("rr").alias("sdnn"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmssd"),
        F.avg((F.abs("d") > 0.05).cast("int")).alias("pnn50"), (60 / F.avg("rr")).alias("mean_hr"),
    )
