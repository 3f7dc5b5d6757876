"""Running values in two levels: what lies before a bucket of the order first, then the rows of each bucket by themselves.

Only summaries of buckets are put in order by group, so a group that holds most of the rows is many tasks' work.  A bucket
holds what arrives in its width, at any length of a recording.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

DAY = 86_400.0
#: The bucket of rows without a place in the order.
NOWHERE = -(2**62)
#: Most narrow rows of a group that one task puts in order.
FEW_ROWS = 100_000


def dealt(rows: DataFrame, at: Column, width: float) -> DataFrame:
    """``rows`` with __k, the number of their bucket; null has one of its own before all others, NaN one behind them, as in Spark's order."""
    v = at.cast("double")
    return rows.withColumn("__k", F.when(F.isnan(v), -NOWHERE).otherwise(F.coalesce(F.floor(v / width), F.lit(NOWHERE))))


def carry(rows: DataFrame, keys: list[str], summary: dict[str, Column], found: Callable[[WindowSpec], dict[str, Column]], descending: bool = False) -> DataFrame:
    """``rows`` (with __k) and the columns that ``found`` makes of the summaries of their group's buckets.

    summary: aggregates of a bucket.  found: given the window over a group's buckets in order, columns over their
    summaries.  Null keys are keys like others.
    """
    names = [f"__key_{n}" for n in range(len(keys))]
    buckets = rows.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col("__k").alias("__bucket")).agg(*[c.alias(n) for n, c in summary.items()])
    in_order = Window.partitionBy(*names).orderBy(F.desc("__bucket") if descending else F.asc("__bucket"))
    sums = buckets.select(*names, "__bucket", *[c.alias(n) for n, c in found(in_order).items()])
    same = F.col("__k") == F.col("__bucket")
    for k, n in zip(keys, names, strict=True):
        same &= F.col(k).eqNullSafe(F.col(n))
    return rows.join(sums, same, "left").drop(*names, "__bucket")


def width_for(rows: DataFrame, keys: list[str], width: float, few: int = FEW_ROWS) -> float | None:
    """``width``, or None where no group of ``rows`` has more than ``few`` rows; they are counted."""
    most = rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    return width if most > few else None


def running(
    rows: DataFrame, keys: list[str], at: str, width: float | None, order: list[Column], sums: dict[str, Column] | None = None, tops: dict[str, Column] | None = None, descending: bool = False
) -> DataFrame:
    """``rows`` with, for each name, the sum (0 of none) or the largest value (null of none) of its column over the rows before in the group.

    at: the numeric column that the order begins with; order: the whole order, downwards in ``at`` if ``descending``.
    Sums have name_all, too, the sum of the whole group.  Rows without ``at`` come first upwards and last downwards.  Without a
    ``width`` there is one level, for groups that are known to be small (``width_for``).
    """
    sums, tops = sums or {}, tops or {}
    if width is None:
        group = Window.partitionBy(*keys)
        past = group.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        made = {n: F.coalesce(F.sum(c).over(past), F.lit(0)) for n, c in sums.items()} | {n: F.max(c).over(past) for n, c in tops.items()}
        return rows.withColumns(made | {f"{n}_all": F.sum(c).over(group) for n, c in sums.items()})
    inside = Window.partitionBy(*keys, "__k").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)

    def before(w: WindowSpec) -> dict[str, Column]:
        past = w.rowsBetween(Window.unboundedPreceding, -1)
        of = {f"__before_{n}": F.sum(f"__sum_{n}").over(past) for n in sums} | {f"__before_{n}": F.max(f"__sum_{n}").over(past) for n in tops}
        return of | {f"{n}_all": F.sum(f"__sum_{n}").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) for n in sums}

    summary = {f"__sum_{n}": F.sum(c) for n, c in sums.items()} | {f"__sum_{n}": F.max(c) for n, c in tops.items()}
    both = carry(dealt(rows, F.col(at), width), keys, summary, before, descending)
    made = {n: F.coalesce(f"__before_{n}", F.lit(0)) + F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()}
    made |= {n: F.greatest(F.col(f"__before_{n}"), F.max(c).over(inside)) for n, c in tops.items()}
    return both.withColumns(made).drop("__k", *[f"__before_{n}" for n in [*sums, *tops]])
