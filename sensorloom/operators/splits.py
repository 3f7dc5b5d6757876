"""Overlap groups, leak-free splits and folds.  Random choices order by an MD5 of seed and key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written
from .scans import DAY, FEW_ROWS, running, width_for


def shuffled(seed: int, *keys: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.concat_ws(":", *[F.col(k).cast("string") for k in keys])).cast("binary"))


#: Ranges into which rows are dealt to be numbered.
RANGES = 256


def ranged(value: Column, bounds: list[float]) -> Column:
    """How many of the ascending ``bounds`` are at most ``value``, by halving; one more than all of them for null."""
    def half(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value < bounds[mid], half(lo, mid)).otherwise(half(mid + 1, hi))

    return F.when(value.isNull(), len(bounds) + 1).otherwise(half(0, len(bounds)))


def numbered(rows: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` with a column ``name``: their place, from 0, in the order of the numeric column ``key``.

    Rows are dealt by approximate quantiles of the key; each range is numbered by itself, behind the count of those before
    it.  The bounds are numbers once they are found, so counts and places are of the same ranges.  Null keys come last.
    """
    bounds = sorted(set(rows.select(F.col(key).cast("double").alias("k")).approxQuantile("k", [i / RANGES for i in range(1, RANGES)], 0.25 / RANGES)))
    dealt = rows.withColumn("range", ranged(F.col(key).cast("double"), bounds))
    counts = {r["range"]: r["count"] for r in dealt.groupBy("range").count().collect()}  # a row for each range
    before, total = {}, 0
    for r in sorted(counts):
        before[r], total = total, total + counts[r]
    first = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("range")) if before else F.lit(0)
    place = F.row_number().over(Window.partitionBy("range").orderBy(F.col(key).asc_nulls_last())) - 1
    return dealt.withColumn(name, (first + place).cast("long")).drop("range")


def placed_by_time(rows: DataFrame, keys: list[str], t: str, *ties: str, bucket: float = DAY) -> DataFrame:
    """``rows`` with place, from 1 by time in their group, and places, the group's rows.

    Rows are numbered inside buckets of time, behind the counts of the buckets before, so only the buckets of a group
    are put in order.  Rows without a time come first, in a bucket of their own; null keys are keys like others.
    """
    found = running(rows, keys, t, bucket, [F.col(t).asc_nulls_first(), *map(F.col, ties)], sums={"place": F.lit(1)})
    return found.withColumn("place", F.col("place") + 1).withColumnRenamed("place_all", "places")


def overlap_groups(sessions: DataFrame, bucket: float = 30 * DAY, few: int = FEW_ROWS) -> DataFrame:
    """``sessions`` (pid, sid, t0, t1, ...) with gid: recordings of a participant that overlap, directly or through others; touching is none.

    The latest end so far and the number of groups so far are handed on between buckets of starts.  A row for each recording is
    written first, as both scans and their summaries read it.  Participants of up to ``few`` recordings are put in order at once.
    """
    sessions = written(sessions, "recordings")
    width = width_for(sessions, ["pid"], bucket, few)
    order = [F.col("t0"), F.col("t1"), F.col("sid")]
    reached = running(sessions, ["pid"], "t0", width, order, tops={"reach": F.col("t1")})
    first = F.when(F.col("reach").isNull() | (F.col("t0") >= F.col("reach")), 1).otherwise(0)
    found = running(reached.withColumn("first", first).drop("reach"), ["pid"], "t0", width, order, sums={"gid": F.col("first")})
    return found.withColumn("gid", (F.col("gid") + F.col("first") - 1).cast("long")).drop("first", "gid_all")


def chrono_split(groups: DataFrame, share: float = 0.2, bucket: float = 30 * DAY, few: int = FEW_ROWS) -> DataFrame:
    """``groups`` (pid, gid, t0, weight) with split: the last groups, until they hold ``share`` of the weight, are test."""
    groups = written(groups, "groups")
    found = running(groups, ["pid"], "t0", width_for(groups, ["pid"], bucket, few), [F.desc("t0"), F.desc("gid")], sums={"after": F.col("weight")}, descending=True)
    return found.withColumn("split", F.when(F.col("after") < share * F.col("after_all"), "test").otherwise("train")).drop("after", "after_all")


def group_folds(groups: DataFrame, folds: int = 5, bucket: float = 30 * DAY, few: int = FEW_ROWS) -> DataFrame:
    """``groups`` (pid, gid, t0, weight) with fold: chronological, by the running share of the weight."""
    groups = written(groups, "groups")
    found = running(groups, ["pid"], "t0", width_for(groups, ["pid"], bucket, few), [F.col("t0"), F.col("gid")], sums={"run": F.col("weight")})
    share = (F.col("run") + F.col("weight")) * folds / F.col("run_all")
    return found.withColumn("fold", F.greatest(F.lit(0), F.ceil(share) - 1).cast("long")).drop("run", "run_all")


def window_folds(rows: DataFrame, folds: int, *order: str, bucket: float = 4 * DAY) -> DataFrame:
    """``rows`` (pid, ...) with fold: floor of place times folds over rows of the participant.

    ``order`` begins with a number, of which ``bucket`` are numbered together: sample numbers of a day at 4 Hz, if nothing is said.
    """
    found = placed_by_time(rows, ["pid"], order[0], *order[1:], bucket=bucket)
    return found.withColumn("fold", F.floor((F.col("place") - 1) * folds / F.col("places")).cast("long")).drop("place", "places")


def random_group_split(groups: DataFrame, share: float, seed: int) -> DataFrame:
    """``groups`` (pid, gid, stress) with split: test groups at random, of those with and without stress apart, at least one with stress on either side."""
    w = Window.partitionBy("pid", "stress")
    n = F.count("*").over(w)
    wanted = F.bround(n * share)
    k = F.when(F.col("stress"), F.greatest(F.lit(0), F.least(F.greatest(wanted, F.lit(1)), n - 1))).otherwise(wanted)
    return groups.withColumn("split", F.when(F.row_number().over(w.orderBy(shuffled(seed, "pid", "gid"), "gid")) <= k, "test").otherwise("train"))


def stratified_split(rows: DataFrame, strata: list[str], key: str, share: float, seed: int) -> DataFrame:
    """``rows`` with split: round-half-even of ``share`` of each stratum is test.

    Rows are ranked inside slices of their random order, behind the counts of the slices before, so that a stratum with most
    of the rows is many tasks' work.
    """
    dealt = rows.withColumn("order", shuffled(seed, key)).withColumn("slice", F.substring("order", 1, 3))
    w = Window.partitionBy(*strata)
    counts = dealt.groupBy(*strata, "slice").agg(F.count("*").alias("n"))  # 4,096 rows of a stratum at most
    before = F.coalesce(F.sum("n").over(w.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slices = counts.select(*[F.col(c).alias(f"{c}_") for c in strata], F.col("slice").alias("slice_"), before.alias("before"), F.bround(F.sum("n").over(w) * share).alias("wanted"))
    same = F.col("slice") == F.col("slice_")
    for c in strata:
        same &= F.col(c).eqNullSafe(F.col(f"{c}_"))
    place = F.row_number().over(Window.partitionBy(*strata, "slice").orderBy("order", key))
    ranked = dealt.join(slices, same).withColumn("place", F.col("before") + place)
    return ranked.withColumn("split", F.when(F.col("place") <= F.col("wanted"), "test").otherwise("train")).select(*rows.columns, "split")


def first_rows(rows: DataFrame, keys: list[str], order: list[Column], n: int | Column, deal: list[str]) -> DataFrame:
    """The first ``n`` rows of each group in an order, with a column place from 1; groups are thinned where they are before they meet.

    n: a number, or a column of the group's rows.  Rows are dealt by a hash of the columns ``deal``, each part keeps its
    first n, and those of all parts meet.
    """
    for by in ([*keys, F.pmod(F.xxhash64(*deal), F.lit(256))], list(keys)):
        rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("place") <= n)
    return rows


def tail_split(rows: DataFrame, block: str, order: str, k: Column) -> DataFrame:
    """``rows`` with split: the last ``k`` of each block are test."""
    return rows.withColumn("split", F.when(F.row_number().over(Window.partitionBy(block).orderBy(F.desc(order))) <= k, "test").otherwise("train"))


def guarded_split(groups: DataFrame, share: float = 0.2) -> DataFrame:
    """``groups`` (pid, gid, t0, weight, stress) with split: as ``chrono_split``, then with stress on either side where it can be.

    Without stress in the test part, it grows backwards up to the latest group with stress; then, without stress left to
    train on, the test part loses its earliest groups up to and with the first that has stress.
    """
    w = Window.partitionBy("pid")
    stress, test, me = F.col("stress"), F.col("split") == "test", F.struct("t0", "gid")
    one = chrono_split(groups, share).withColumns({"edge": F.max(F.when(stress, me)).over(w), "n": F.count_if(stress & test).over(w)})
    one = one.withColumn("split", F.when((F.col("n") == 0) & (me >= F.col("edge")), "test").otherwise(F.col("split")))
    two = one.withColumns({"edge": F.min(F.when(stress & test, me)).over(w), "n": F.count_if(stress & ~test).over(w)})
    return two.withColumn("split", F.when((F.col("n") == 0) & (me <= F.col("edge")), "train").otherwise(F.col("split"))).drop("edge", "n")


def leaks(rows: DataFrame) -> DataFrame:
    """(pid, leak): violations in ``rows`` (pid, sid, gid, t0, split).

    Groups on both sides; recordings of the training part that are in the test part, too (a semi join that should be empty);
    participants whose training does not start before the test; rows without a split.  The rows are written first, as all
    checks read them: what made them runs once, and a task holds one check's groups only.
    """
    rows = written(rows.select("pid", "sid", "gid", "t0", "split"), "splits")
    both = rows.groupBy("pid", "gid").agg(F.count_distinct("split").alias("n")).filter("n > 1").select("pid", F.lit("group on both sides").alias("leak"))
    part = lambda s: rows.filter(F.col("split") == s)
    shared = part("train").select("pid", "sid").distinct().join(part("test").select("pid", "sid"), ["pid", "sid"], "left_semi").select("pid", F.lit("recording on both sides").alias("leak"))
    late = rows.groupBy("pid").agg(F.max(F.when(F.col("split") == "train", F.col("t0"))).alias("a"), F.min(F.when(F.col("split") == "test", F.col("t0"))).alias("b")).filter("a >= b").select("pid", F.lit("training after test").alias("leak"))
    none = rows.filter("split is null").select("pid", F.lit("no split").alias("leak"))
    return both.unionByName(shared).unionByName(late).unionByName(none)
