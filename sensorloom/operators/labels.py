"""Labels of samples from sparse events: as-of and interval joins in bounded time buckets.

A rule that asks only for events within a radius needs no participant-wide sort: each event is copied to
the buckets that its radius reaches.  Few events, by count, are broadcast as the stretches between them, and samples stay
where they are; with more, a window over (participant, bucket) finds the previous and the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written

BUCKET = 86_400.0
#: Most tags that are broadcast, most stretches between them (about 100 bytes each), and most of those in one bucket.
FEW_TAGS, FEW_STRETCHES, FEW_IN_BUCKET = 100_000, 400_000, 64


def stretches(tags: DataFrame, radius: float, bucket: float, keys: tuple[str, ...], kinds: tuple[str, ...], few: int) -> DataFrame | None:
    """(key_0 ..., bucket, from, to, last_0, next_0 ...) of ``tags`` (keys, t, __kind): what each kind's last and next tag are from one
    tag's time to another's, for the buckets that a tag's radius reaches; None unless both the tags and the stretches are few."""
    if tags.limit(few + 1).count() > few:
        return None
    at = lambda c: F.floor(c / bucket)
    names = [f"key_{n}" for n in range(len(keys))]
    is_kind = [F.max(F.col("__kind") == k).alias(f"is_{n}") for n, k in enumerate(kinds)]
    spread = tags.filter("t is not null").withColumn("bucket", F.explode(F.sequence(at(F.col("t") - radius), at(F.col("t") + radius))))
    times = spread.groupBy(*[F.col(k).alias(name) for k, name in zip(keys, names, strict=True)], "bucket", "t").agg(*is_kind)
    marks = times.select(*names, "bucket", F.lit(float("-inf")).alias("t"), *[F.lit(False).alias(f"is_{n}") for n in range(len(kinds))]).distinct()
    place = Window.partitionBy(*names, "bucket").orderBy("t")
    to_here, beyond = place.rowsBetween(Window.unboundedPreceding, 0), place.rowsBetween(1, Window.unboundedFollowing)
    found = {"to": F.coalesce(F.lead("t").over(place), F.lit(float("inf")))}
    for n in range(len(kinds)):
        found |= {f"last_{n}": F.max(F.when(F.col(f"is_{n}"), F.col("t"))).over(to_here), f"next_{n}": F.min(F.when(F.col(f"is_{n}"), F.col("t"))).over(beyond)}
    made = written(times.unionByName(marks).withColumns(found).withColumnRenamed("t", "from").drop(*[f"is_{n}" for n in range(len(kinds))]), "stretches")
    sizes = made.groupBy(*names, "bucket").count().agg(F.sum("count").alias("all"), F.max("count").alias("most")).first()
    return made if (sizes["all"] or 0) <= FEW_STRETCHES and (sizes["most"] or 0) <= FEW_IN_BUCKET else None


def near_tags(
    samples: DataFrame, tags: DataFrame, radius: float, bucket: float = BUCKET, keys: tuple[str, ...] = ("pid",), kinds: tuple[str, ...] = (), few: int = FEW_TAGS
) -> DataFrame:
    """``samples`` (keys, t, ...) with before and after: seconds to the previous and next tag (keys, tag_t) with the same keys, null beyond ``radius``.

    Tags may repeat.  With ``kinds``, tags have a column kind, and before_k and after_k are those to tags of kind k, all in one pass.
    Up to ``few`` tags (they are counted) go to all tasks as stretches between tags, of which a sample meets the one that it
    lies in, so samples are not shuffled.  Beyond that samples are sorted once: each tag of a bucket knows the next one
    there, a mark before all of them knows the first, and the frame looks back only, so the work does not depend on how
    many samples a bucket holds.  Null times have no neighbours; null keys are keys like others.
    """
    # tags of one time and kind are one: else the first would take the second for its next
    kind = F.col("kind") if kinds else F.lit("")
    once = tags.select(*keys, F.col("tag_t").alias("t"), kind.alias("__kind")).distinct()
    within = lambda c: F.when(c <= radius, c)
    ends = [f"_{k}" if k else "" for k in kinds or ("",)]
    narrow = min(bucket, radius) if radius > 0 else bucket
    between = stretches(once, radius, narrow, keys, kinds or ("",), few) if few else None
    if between is not None:
        t, b = F.col("s.t"), F.broadcast(between).alias("b")
        same = [F.col(f"s.{k}").eqNullSafe(F.col(f"b.key_{n}")) for n, k in enumerate(keys)]
        inside = (F.floor(t / narrow) == F.col("b.bucket")) & (t >= F.col("b.from")) & (t < F.col("b.to"))
        gaps = []
        for n, end in enumerate(ends):
            last, after = F.col(f"b.last_{n}"), F.col(f"b.next_{n}")
            gaps += [within(t - last).alias(f"before{end}"), within(F.when(last == t, 0.0).otherwise(after - t)).alias(f"after{end}")]
        return samples.alias("s").join(b, [*same, inside], "left").select("s.*", *gaps)
    at = lambda c: F.floor(c / bucket)
    spread = once.withColumn("__bucket", F.explode(F.sequence(at(F.col("t") - radius), at(F.col("t") + radius))))
    known = spread.withColumn("__next", F.lead("t").over(Window.partitionBy(*keys, "__bucket", "__kind").orderBy("t")))
    # without a time they come first; one that cannot be a whole number would fail in casts that Spark moves below the union
    marks = spread.groupBy(*keys, "__bucket", "__kind").agg(F.min("t").alias("__next")).withColumn("t", F.lit(None).cast("double"))
    both = samples.withColumns({"__bucket": at(F.col("t")), "__kind": F.lit(None).cast("string")}).unionByName(known, allowMissingColumns=True).unionByName(marks, allowMissingColumns=True)
    back = Window.partitionBy(*keys, "__bucket").orderBy("t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last, found = {}, {}
    for n, (k, end) in enumerate(zip(kinds or ("",), ends, strict=True)):
        last[f"__last_{n}"] = F.max(F.when(F.col("__kind") == k, F.struct("t", "__next"))).over(back)
        tag = F.col(f"__last_{n}")
        found[f"before{end}"] = within(F.col("t") - tag["t"])
        found[f"after{end}"] = within(F.when(tag["t"] == F.col("t"), 0.0).otherwise(tag["__next"] - F.col("t")))
    return both.withColumns(last).filter(F.col("__kind").isNull()).withColumns(found).drop("__bucket", "__kind", "__next", *last)


def two_sided(near: float, buffer: float) -> Column:
    """1 within ``near`` of any tag, -1 within ``buffer``, else 0; bounds count as inside."""
    d = F.least("before", "after")
    return F.when(d <= near, 1).when(d <= buffer, -1).otherwise(0)


def before_only(near: float, buffer: float) -> Column:
    """1 up to ``near`` before a tag, -1 within ``buffer`` of one, else 0."""
    return F.when(F.col("after") <= near, 1).when((F.col("before") <= buffer) | (F.col("after") <= buffer), -1).otherwise(0)


def labelled(samples: DataFrame, tags: DataFrame, near: float, buffer: float, rule=two_sided, few: int = FEW_TAGS) -> DataFrame:
    return near_tags(samples, tags, buffer, few=few).withColumn("y", rule(near, buffer)).drop("before", "after")


def interval_labels(samples: DataFrame, tags: DataFrame, sessions: DataFrame, radius: float, few: int = FEW_TAGS) -> DataFrame:
    """``samples`` (pid, sid, t, ...) with y: 1 within ``radius`` of a valid tag (pid, sid, tag_t) of the recording, -1 of an invalid one, else 0.

    A tag is valid if its whole radius lies inside the recording (sessions: pid, sid, t0, t1); valid tags win.
    """
    ok = (F.col("tag_t") - radius >= F.col("t0")) & (F.col("tag_t") + radius <= F.col("t1"))
    checked = tags.join(sessions.select("pid", "sid", "t0", "t1"), ["pid", "sid"]).select("pid", "sid", "tag_t", F.when(ok, "valid").otherwise("other").alias("kind"))
    near = near_tags(samples, checked, radius, keys=("pid", "sid"), kinds=("valid", "other"), few=few)
    inside = lambda k: F.coalesce(f"before_{k}", f"after_{k}").isNotNull()
    return near.withColumn("y", F.when(inside("valid"), 1).when(inside("other"), -1).otherwise(0)).drop("before_valid", "after_valid", "before_other", "after_other")
