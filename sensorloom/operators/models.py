"""Small models for every group at once: sums of outer products on Spark, one small solve for each group.

A group (a participant, a fold, a job of a grid, or everything) may hold any share of the rows: tasks add up what their
rows give, and only matrices as wide as the features meet.  Parameters are tables, joined to the rows by group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..shared import written
from . import metrics
from .splits import first_rows, placed_by_time

#: Groups whose sums a task holds before it hands them on.
HELD = 4_096


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product of two array columns."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def group_sums(rows: DataFrame, keys: list[str], part: Callable[[pd.DataFrame], np.ndarray]) -> DataFrame:
    """(keys, sums): for each task and group the sum of ``part`` (rows of the group to an array of any shape), as bytes of doubles."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def out() -> pd.DataFrame:
            frame = pd.DataFrame(list(held), columns=keys) if keys else pd.DataFrame(index=range(len(held)))
            return frame.assign(sums=[v.tobytes() for v in held.values()])

        for batch in batches:
            for key, some in batch.groupby(keys, dropna=False) if keys else [((), batch)]:
                got = part(some)
                held[key] = held[key] + got if key in held else got
            if len(held) > HELD:
                yield out()
                held.clear()
        if held:
            yield out()

    return rows.mapInPandas(summed, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "sums binary"]))


def solved(sums: DataFrame, keys: list[str], solve: Callable[[np.ndarray], dict], schema: str) -> DataFrame:
    """(keys, schema): ``solve`` of each group's added sums (a flat array of doubles)."""
    kinds = {f.name: f.dataType.simpleString() for f in sums.schema.fields}

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(b) for b in pdf["sums"]], axis=0)
        return pd.DataFrame({k: [pdf[k].iloc[0]] for k in keys} | {k: [v] for k, v in solve(total).items()})

    return sums.groupBy(*keys).applyInPandas(added, ", ".join([*(f"{k} {kinds[k]}" for k in keys), schema]))


def standardised(rows: DataFrame, keys: list[str], features: list[str], train: Column) -> DataFrame:
    """``rows`` with x: their features less the mean and over the population deviation (1 where it is 0) of the group's ``train`` rows, and a 1."""
    stats = rows.filter(train).groupBy(*keys).agg(*[f(c).alias(f"{c}_{n}") for c in features for f, n in ((F.avg, "mean"), (F.stddev_pop, "sd"))])
    z = [(F.col(c) - F.col(f"{c}_mean")) / F.when(F.col(f"{c}_sd") > 0, F.col(f"{c}_sd")).otherwise(1.0) for c in features]
    both = rows.join(stats, keys) if keys else rows.crossJoin(F.broadcast(stats))  # one row
    return both.withColumn("x", F.array(*z, F.lit(1.0))).drop(*[f"{c}_{n}" for c in features for n in ("mean", "sd")])


def logistic(train: DataFrame, keys: list[str], width: int, c: float = 1.0, rounds: int = 12, tolerance: float = 1e-8) -> tuple[DataFrame, DataFrame]:
    """Parameters (keys, w) and history (keys, round, loss) of L2-penalised logistic regressions, one for each group.

    train: (keys, x, y, weight), x an array of ``width`` whose last place is the intercept's 1 (not penalised).  Newton
    steps, each one pass over ``train``; they end when no parameter of any group moves by ``tolerance``.  A step that does
    not lower the loss is halved.
    """
    k = width
    penalty = np.append(np.full(k - 1, 1 / c), 0.0)
    train = written(train.select(*keys, "x", "y", "weight"), "train")
    params = written(train.select(*keys).distinct().withColumns({"w": F.array_repeat(F.lit(0.0), k), "base": F.array_repeat(F.lit(0.0), k), "move": F.array_repeat(F.lit(0.0), k), "loss": F.lit(float("inf")), "step": F.lit(1.0)}), "parameters") if keys else None
    spark = train.sparkSession
    if not keys:
        zeros = [0.0] * k
        params = spark.createDataFrame([(zeros, zeros, zeros, float("inf"), 1.0)], "w array<double>, base array<double>, move array<double>, loss double, step double")
    history = None

    def part(some: pd.DataFrame) -> np.ndarray:
        x, w, y, weight = np.stack(some["x"]), some["w"].iloc[0], some["y"].to_numpy(float), some["weight"].to_numpy(float)
        z = x @ w
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        loss = float((weight * (np.logaddexp(0, z) - y * z)).sum())
        h = (x * (weight * p * (1 - p))[:, None]).T @ x
        return np.concatenate([x.T @ (weight * (p - y)), h.ravel(), [loss]])

    def solve(total: np.ndarray, now: pd.Series) -> dict:
        w, base, move = (np.array(now[c], float) for c in ("w", "base", "move"))
        loss = float(total[-1] + (penalty * w * w).sum() / 2)
        if loss > now["loss"] + 1e-12 and now["step"] > 1e-4:  # too far: half the way
            step = now["step"] / 2
            return {"w": (base - step * move).tolist(), "base": base.tolist(), "move": move.tolist(), "loss": now["loss"], "step": step, "seen": loss, "moved": float(np.abs(step * move).max())}
        g, h = total[:k] + penalty * w, total[k:-1].reshape(k, k) + np.diag(penalty + 1e-9)
        move = np.linalg.solve(h, g)
        return {"w": (w - move).tolist(), "base": w.tolist(), "move": move.tolist(), "loss": loss, "step": 1.0, "seen": loss, "moved": float(np.abs(move).max())}

    fields = "w array<double>, base array<double>, move array<double>, loss double, step double, seen double, moved double"
    kinds = {f.name: f.dataType.simpleString() for f in train.schema.fields}

    def next_of(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=[*keys, *(x.split()[0] for x in fields.split(", "))])
        now = right.iloc[0]
        total = np.sum([np.frombuffer(b) for b in left["sums"]], axis=0)
        return pd.DataFrame({c: [now[c]] for c in keys} | {c: [v] for c, v in solve(total, now).items()})

    for turn in range(rounds):
        both = train.join(params.select(*keys, "w"), keys) if keys else train.crossJoin(F.broadcast(params.select("w")))
        sums = group_sums(both, keys, part)
        if keys:
            got = sums.groupBy(*keys).cogroup(params.groupBy(*keys)).applyInPandas(next_of, ", ".join([*(f"{c} {kinds[c]}" for c in keys), fields]))
            seen = Observation()
            got = written(got.observe(seen, F.max("moved").alias("moved")), "parameters")
            moved = seen.get["moved"]
        else:  # sums of tasks: as many rows as tasks, as wide as the features
            made = next_of(sums.toPandas(), params.toPandas())
            got, moved = spark.createDataFrame(made, fields), made["moved"].max() if len(made) else 0.0
        step = got.select(*keys, F.lit(turn).alias("round"), F.col("seen").alias("loss"))
        history = step if history is None else history.unionByName(step)
        params = got.drop("seen", "moved")
        if (moved or 0.0) < tolerance:
            break
    return params.select(*keys, "w"), history


def probability(x: Column | str, w: Column | str) -> Column:
    return F.lit(1.0) / (1 + F.exp(-dot(x, w)))


def balanced(rows: DataFrame, keys: list[str], y: str = "y") -> DataFrame:
    """``rows`` with weight: rows of the group over twice the rows of their class; counted, so no group is gathered."""
    return rows.join(metrics.class_weights(rows, keys, y).drop("n"), [*keys, y])


def logistic_cv(rows: DataFrame, features: list[str], c: float = 0.5, folds: int = 5) -> DataFrame:
    """(pid, fold, y, score): out-of-fold scores of standardised, class-balanced logistic regressions, one for each participant and fold.

    Folds whose training or test part lacks a class are left out.
    """
    rows = written(rows.select("pid", F.col("fold").cast("int").alias("own"), F.col("y").cast("int").alias("y"), *features).na.drop(), "folds")
    every = rows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    test = F.col("own") == F.col("fold")
    n = [F.count_if(part & (F.col("y") == v)).alias(f"n{i}{v}") for i, part in enumerate((test, ~test)) for v in (0, 1)]
    good = every.groupBy("pid", "fold").agg(*n).filter("least(n00, n01, n10, n11) > 0").select("pid", "fold")
    z = written(standardised(every.join(good, ["pid", "fold"]), ["pid", "fold"], features, ~test).select("pid", "fold", "own", "y", "x"), "standardised")
    train = balanced(z.filter(~test), ["pid", "fold"])
    w, _ = logistic(train, ["pid", "fold"], len(features) + 1, c)
    return z.filter(test).join(w, ["pid", "fold"]).select("pid", F.col("fold").cast("long").alias("fold"), "y", probability("x", "w").alias("score"))


def pooled(rows: DataFrame, features: list[str], c: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Scores (rows' columns, score) of one model fitted on all rows of split train, balanced, and its history (round, loss)."""
    z = written(standardised(rows, [], features, F.col("split") == "train"), "standardised")
    sizes = z.filter("split = 'train'").groupBy("y").count().collect()  # two rows
    total = sum(r["count"] for r in sizes)
    weight = F.lit(0.0)
    for r in sizes:
        weight = F.when(F.col("y") == r["y"], total / (2 * r["count"])).otherwise(weight)
    w, history = logistic(z.filter("split = 'train'").withColumn("weight", weight), [], len(features) + 1, c)
    return z.crossJoin(F.broadcast(w)).withColumn("score", probability("x", "w")).drop("x", "w"), history  # one row of parameters


def ridge(train: DataFrame, keys: list[str], penalty: float) -> DataFrame:
    """(keys, w): multi-output ridge regressions of arrays y on arrays x, one for each group; w holds the weights of each output, one after another."""

    def part(some: pd.DataFrame) -> np.ndarray:
        x, y = np.stack(some["x"]), np.stack(some["y"])
        return np.concatenate([[x.shape[1], y.shape[1]], (x.T @ np.column_stack([x, y])).ravel()]) if len(some) else np.zeros(0)

    def solve(total: np.ndarray) -> dict:
        parts = len(total) - 2  # d * (d + h), behind sums of d and of h
        share = total[1] / total[0]
        d = int(round(np.sqrt(parts / (1 + share))))
        m = total[2:].reshape(d, -1)
        return {"w": np.linalg.solve(m[:, :d] + penalty * np.eye(d), m[:, d:]).T.ravel().tolist()}

    return solved(group_sums(train.select(*keys, "x", "y"), keys, part), keys, solve, "w array<double>")


def forecasts(x: Column | str, w: Column | str, outputs: Column) -> Column:
    """The outputs of a ridge regression for arrays x."""
    return F.transform(F.sequence(F.lit(0), outputs - 1), lambda k: dot(x, F.slice(w, k * F.size(x) + 1, F.size(x))))


def pretext_rows(windows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, train, x, y): windows and the samples behind them, less the mean and over the deviation of all samples of the group's
    training windows; the last tenth of each group in time is not for training."""
    rows = placed_by_time(windows, keys, "t_start", "sid", "s").select(*keys, "x", "yf", (F.col("place") <= F.col("places") - F.floor(F.col("places") / 10)).alias("train"))
    total, squares = F.aggregate("x", F.lit(0.0), lambda s, v: s + v), F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)
    sums = rows.filter("train").groupBy(*keys).agg(F.sum(F.size("x")).alias("m"), F.sum(total).alias("t"), F.sum(squares).alias("q"))
    mean, sd = F.col("t") / F.col("m"), F.sqrt(F.greatest(F.col("q") / F.col("m") - F.pow(F.col("t") / F.col("m"), 2), F.lit(0.0)))
    scaled = rows.join(sums.select(*keys, mean.alias("mu"), F.when(sd > 0, sd).otherwise(1.0).alias("sd")), keys)
    z = lambda c: F.transform(c, lambda v: (v - F.col("mu")) / F.col("sd"))
    return scaled.select(*keys, "train", F.concat(z("x"), F.array(F.lit(1.0))).alias("x"), z("yf").alias("y"))


def ridge_pretext(windows: DataFrame, penalty: float = 1.0) -> DataFrame:
    """(pid, n_train, n_val, rmse): next samples from a window's own, by multi-output ridge regression; the last tenth in time validates.

    Participants without a window to validate on are left out.
    """
    rows = written(pretext_rows(windows, ["pid"]), "pretext")
    w = ridge(rows.filter("train"), ["pid"], penalty)
    error = F.aggregate(F.zip_with(forecasts("x", "w", F.size("y")), "y", lambda p, v: (p - v) * (p - v)), F.lit(0.0), lambda s, v: s + v)
    tested = rows.filter("not train").join(w, "pid").groupBy("pid").agg(F.sqrt(F.sum(error) / F.sum(F.size("y"))).alias("rmse"))
    n = rows.groupBy("pid").agg(F.count_if("train").alias("n_train"), F.count_if(~F.col("train")).alias("n_val"))
    return n.join(tested, "pid").select("pid", "n_train", "n_val", "rmse")


def label_curve(rows: DataFrame, features: list[str], sizes: list[int], repeats: int, seed: int = 0) -> DataFrame:
    """(n_labels, repeat, n_used, auc): models fitted on few labels of the training split, scored on the test split.

    rows: (key, y, split, features).  Each repeat orders the training rows of each class by an MD5; a job takes the first of
    them, half its labels of either class.  Only rows that a job takes are copied to it; the test rows are scored by every
    job where they are.  Jobs that lack a class have no auc.
    """
    spark = rows.sparkSession
    rows = written(rows.na.drop().select("key", "y", "split", *features), "labelled")
    jobs = F.broadcast(spark.createDataFrame([(n, r) for n in sizes for r in range(repeats)], "n_labels int, repeat int"))
    order = F.md5(F.concat_ws(":", F.lit(seed), "repeat", "key").cast("binary"))
    tried = rows.filter("split = 'train'").withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("order", order)
    tried = first_rows(tried, ["repeat", "y"], [F.col("order"), F.col("key")], max(sizes), ["key"])
    half = F.floor(F.col("n_labels") / 2)
    taken = tried.join(jobs, "repeat").filter(F.when(F.col("y") == 1, F.col("place") <= half).otherwise(F.col("place") <= F.col("n_labels") - half))
    z = written(taken.select("n_labels", "repeat", "key", "y", *features), "taken")
    used = z.groupBy("n_labels", "repeat").agg(F.count("*").alias("n_used"), F.count_distinct("y").alias("classes"))
    keys = ["n_labels", "repeat"]
    fit = z.join(used.filter("classes = 2").select(*keys), keys)
    stats = fit.groupBy(*keys).agg(*[f(c).alias(f"{c}_{n}") for c in features for f, n in ((F.avg, "mean"), (F.stddev_pop, "sd"))])
    scaled = F.array(*[(F.col(c) - F.col(f"{c}_mean")) / F.when(F.col(f"{c}_sd") > 0, F.col(f"{c}_sd")).otherwise(1.0) for c in features], F.lit(1.0))
    w, _ = logistic(fit.join(F.broadcast(stats), keys).select(*keys, scaled.alias("x"), "y", F.lit(1.0).alias("weight")), keys, len(features) + 1)
    models = F.broadcast(w.join(stats, keys))  # one row for each job of the grid
    scores = rows.filter("split = 'test'").crossJoin(models).select(*keys, "y", dot(scaled, "w").alias("score"))
    every = spark.createDataFrame([(n, r) for n in sizes for r in range(repeats)], "n_labels int, repeat int").join(used, keys, "left")
    return every.join(metrics.auc(scores, keys).select(*keys, "auc"), keys, "left").select(*keys, F.coalesce("n_used", F.lit(0)).cast("long").alias("n_used"), "auc")
