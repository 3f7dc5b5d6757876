"""Sessions and count-based windows by panes: every sample is shuffled once, a window is two neighbouring panes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_sessions(samples: DataFrame, gap: float) -> DataFrame:
    """``samples`` (pid, t, event_id, ...; event_id orders samples of one time) with sid and i: a session ends where no sample follows for more than ``gap`` seconds; i counts from 0 in it."""
    w = Window.partitionBy("pid").orderBy("t", "event_id")
    start = F.when(F.col("t") - F.lag("t").over(w) > gap, 1).otherwise(0)
    numbered = samples.withColumn("start", start).withColumn("sid", F.sum("start").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("start")
    return numbered.withColumn("i", (F.row_number().over(Window.partitionBy("pid", "sid").orderBy("t", "event_id")) - 1).cast("long"))


def long_enough(samples: DataFrame, least: int, beats: DataFrame | None = None, least_beats: int = 0) -> DataFrame:
    """The samples (pid, sid, ...) of recordings of ``least`` samples or more, and of ``least_beats`` beats (pid, sid, ...) where these are given."""
    keep = samples.groupBy("pid", "sid").count().filter(F.col("count") >= least).select("pid", "sid")
    if beats is not None:
        keep = keep.join(beats.groupBy("pid", "sid").count().filter(F.col("count") >= least_beats), ["pid", "sid"], "left_semi")
    return samples.join(keep, ["pid", "sid"], "left_semi")


def windows(samples: DataFrame, step: int, horizon: int = 0, least_mean: float | None = None, others: tuple[str, ...] = ()) -> DataFrame:
    """(pid, sid, s, t_start, x, yf, y, any, n, total, mean): windows of two panes of ``step`` samples (pid, sid, i, t, x, y), each ``step`` apart.

    Only full windows, followed by ``horizon`` more samples (at most ``step``; ValueError beyond), whose values are yf.  y is
    the label that all samples share, else -1; any says whether one is 1.  total is the sum of the panes' sums; mean is that
    of the samples (nulls left out), added up in their order, since the last bit decides at a bound.  Windows below
    ``least_mean`` are left out before labels are looked at.  ``others`` are columns cut at the same places, into columns of
    their names and name_yf; their t_last is the time of a window's last sample.
    """
    if horizon > step:
        raise ValueError("the horizon is longer than a step")
    signals = ("x", *others)
    rows = F.array_sort(F.collect_list(F.struct("i", *signals)))
    pane = samples.groupBy("pid", "sid", F.floor(F.col("i") / step).alias("pane")).agg(
        F.count("*").alias("n"), F.sum("x").alias("total"), F.min("y").alias("low"), F.max("y").alias("high"), F.min("t").alias("t_start"), F.max("t").alias("t_last"), rows.alias("rows")
    )
    w = Window.partitionBy("pid", "sid").orderBy("pane")
    two = pane.withColumns({f"{c}2": F.lead(c).over(w) for c in ("n", "total", "low", "high", "rows", "t_last")} | {"rows3": F.lead("rows", 2).over(w)})
    full = (F.col("n") == step) & (F.col("n2") == step)
    if horizon:
        full &= F.size("rows3") >= horizon
    total = F.col("total") + F.col("total2")
    known = F.filter("x", F.isnotnull)
    mean = F.aggregate(known, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(known), F.lit(0))
    low, high = F.least("low", "low2"), F.greatest("high", "high2")
    of = lambda c, x: F.transform(c, lambda v: v[x])
    ahead = F.slice(F.coalesce("rows3", F.slice("rows", 1, 0)), 1, max(horizon, 1))
    cut = [c for x in signals for c in (F.concat(of("rows", x), of("rows2", x)).alias(x), of(ahead, x).alias("yf" if x == "x" else f"{x}_yf"))]
    times = [F.col("t_last2").alias("t_last")] if others else []
    y = F.when((low == high) & (low != -1), low).otherwise(-1).alias("y")
    out = two.filter(full).select("pid", "sid", (F.col("pane") * step).cast("long").alias("s"), "t_start", *times, *cut, y, (high == 1).alias("any"), F.lit(2 * step).alias("n"), total.alias("total")).withColumn("mean", mean)
    return out if least_mean is None else out.filter(F.col("mean") >= least_mean)


def block_windows(samples: DataFrame, width: int, horizon: int, step: int, most: dict[int, int] | None = None) -> DataFrame:
    """(subject, block, start): starts of windows of ``width`` samples in each block (subject, i, block), ``step`` apart from its first sample.

    A block spans from its first to its last sample, whatever lies between; ``width`` and ``horizon`` samples fit behind
    each start.  ``most`` keeps the first so many starts of a block.
    """
    span = samples.groupBy("subject", "block").agg(F.min("i").alias("a"), F.max("i").alias("z"))
    limit = F.lit(None).cast("long")
    for b, n in (most or {}).items():
        limit = F.when(F.col("block") == b, F.lit(n).cast("long")).otherwise(limit)
    last = F.col("z") - width - horizon
    fits = span.filter(last >= F.col("a")).select("subject", "block", F.posexplode(F.sequence(F.col("a"), last, F.lit(step).cast("long"))).alias("k", "start"), limit.alias("most"))
    return fits.filter(F.col("most").isNull() | (F.col("k") < F.col("most"))).select("subject", "block", "start")


def gathered(samples: DataFrame, starts: DataFrame, width: int, signals: tuple[str, ...] = ("x",), keys: tuple[str, ...] = ("subject",), chunk: int | None = None) -> DataFrame:
    """``starts`` (keys, start, ...) with a column for each of ``signals``: the array of the ``width`` samples (keys, i, signals) from start on.

    Windows may overlap as often as they like and repeat: samples are shuffled once, in chunks of arrays (``width`` long
    unless ``chunk`` is longer), starts meet the chunk that they are in, and a window is cut out of it and the next one
    only then.  i counts up in a recording; starts before its first, behind its last whole window, or across missing
    samples have none and are left out.
    """
    at = lambda c: F.expr(f"{c} div {max(width, chunk or 0)}")
    rows = samples.groupBy(*keys, at("i").alias("__k")).agg(F.array_sort(F.collect_list(F.struct("i", *signals))).alias("__rows"))
    w = Window.partitionBy(*keys).orderBy("__k")
    more = F.when(F.lead("__k").over(w) == F.col("__k") + 1, F.lead("__rows").over(w))
    chunks = rows.withColumn("__rows", F.concat("__rows", F.slice(F.coalesce(more, F.slice("__rows", 1, 0)), F.lit(1), F.lit(width - 1))))
    places = F.col("__rows.i")
    unbroken = F.element_at(places, -1) - places[0] + 1 == F.size(places)
    first = F.when(unbroken, F.col("start") - places[0]).otherwise(F.array_position(places, F.col("start")) - 1)
    met = starts.filter("start >= 0").withColumn("__k", at("start")).join(chunks, [*keys, "__k"]).withColumn("__at", first.cast("int")).filter(F.col("__at") >= 0)
    cut = met.withColumn("__rows", F.slice("__rows", F.col("__at") + 1, F.lit(width)))
    whole = cut.filter((F.size("__rows") == width) & (F.col("__rows")[0]["i"] == F.col("start")) & (F.element_at("__rows", -1)["i"] == F.col("start") + width - 1))
    return whole.withColumns({c: F.col(f"__rows.{c}") for c in signals}).drop("__rows", "__k", "__at")


def between_marks(marks: DataFrame, ends: DataFrame, trim: int, least: int, keys: tuple[str, ...] = ("pid", "sid")) -> DataFrame:
    """(keys, first, last): stretches of samples between neighbouring places: a recording's first, its marks (keys, i), its end (ends: keys, n).

    Each loses ``trim`` samples at either end; ``least`` samples or more are left.  last is exclusive.
    """
    every = ends.select(*keys, F.explode(F.array(F.lit(0).cast("long"), F.col("n"))).alias("b")).unionByName(marks.select(*keys, F.col("i").alias("b")))
    cut = every.withColumn("next", F.lead("b").over(Window.partitionBy(*keys).orderBy("b")))
    return cut.select(*keys, (F.col("b") + trim).alias("first"), (F.col("next") - trim).alias("last")).filter(F.col("last") - F.col("first") >= least)


def covered(samples: DataFrame, starts: DataFrame, width: int) -> DataFrame:
    """The rows of ``samples`` (subject, i, ...) that lie in any window (subject, start) of ``width`` samples, each once."""
    marks = starts.select("subject", F.col("start").alias("i"), F.lit(True).alias("is_start")).distinct()
    last = F.max(F.when(F.col("is_start"), F.col("i"))).over(Window.partitionBy("subject").orderBy("i").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return samples.unionByName(marks, allowMissingColumns=True).withColumn("last", last).filter(F.col("is_start").isNull() & (F.col("i") - F.col("last") < width)).drop("last", "is_start")


def segment_windows(segments: DataFrame, width: int, step: int) -> DataFrame:
    """``segments`` (first, last, ...) with start: each start of ``width`` samples, ``step`` apart, that fit before last; overlapping segments repeat them."""
    end = F.col("last") - width
    return segments.filter(end >= F.col("first")).withColumn("start", F.explode(F.sequence(F.col("first"), end, F.lit(step).cast("long"))))


def spans(samples: DataFrame, panes: int, step: int) -> DataFrame:
    """(pid, sid, s, total): windows of any number of panes, by a frame over panes."""
    pane = samples.groupBy("pid", "sid", F.floor(F.col("i") / step).alias("pane")).agg(F.count("*").alias("n"), F.sum("x").alias("total"))
    w = Window.partitionBy("pid", "sid").orderBy("pane").rowsBetween(0, panes - 1)
    out = pane.withColumns({"m": F.sum("n").over(w), "total": F.sum("total").over(w)})
    return out.filter(F.col("m") == panes * step).select("pid", "sid", (F.col("pane") * step).alias("s"), "total")


def event_segments(tags: DataFrame, sessions: DataFrame, half: int, margin: int, rate: float = 4.0) -> DataFrame:
    """(pid, sid, tag_t, first, last): 2 * ``half`` samples around each tag of a recording with ``margin`` samples on either side.

    A tag's position truncates its seconds first.
    """
    at = (F.floor(F.col("tag_t") - F.col("t0")) * rate).cast("long")
    placed = tags.join(sessions.select("pid", "sid", "t0", "t1", "n"), ["pid", "sid"]).filter("tag_t > t0 and tag_t < t1").withColumn("at", at)
    keep = (F.col("at") - margin >= 0) & (F.col("at") + margin <= F.col("n")) & (F.col("at") - half >= 0) & (F.col("at") + half <= F.col("n"))
    return placed.filter(keep).select("pid", "sid", "tag_t", (F.col("at") - half).alias("first"), (F.col("at") + half).alias("last"))


def stretches(tags: DataFrame, sessions: DataFrame, trim: float, least: float) -> DataFrame:
    """(pid, sid, lo, hi): what lies between neighbouring bounds (start, tags, end), ``trim`` seconds shorter on both ends, ``least`` long or more."""
    ends = sessions.select("pid", "sid", F.explode(F.array("t0", "t1")).alias("b"))
    bounds = ends.unionByName(tags.select("pid", "sid", F.col("tag_t").alias("b")))
    w = Window.partitionBy("pid", "sid").orderBy("b")
    cut = bounds.withColumn("next", F.lead("b").over(w)).select("pid", "sid", (F.col("b") + trim).alias("lo"), (F.col("next") - trim).alias("hi"))
    return cut.filter(F.col("hi") - F.col("lo") >= least)
