"""Queries that train networks of convolutions: forecasts first, then heads over frozen or free encoders, alone or joined."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import layers
from ..operators import metrics, models, networks, splits
from ..operators import beats as heart
from ..operators import windows as cutting
from ..operators import labels as rules
from ..shared import written
from ..sources.tables import table
from .catalog import SEED, beats, cohorts, cut, one_recording, query, rounded, whole

WIDE, STEPS, RATE = 10, 12, 0.02
KERNELS = (4, 3, 2, 3)
ROW = ("user", "sid", "s")  # what names a window; its hash is its row number
encoder_only = lambda name: not name.startswith("head.")


def forecaster(inputs: dict[str, tuple[int, int]]) -> layers.Network:
    return layers.Network({c: layers.encoder(KERNELS) for c in inputs}, layers.dense_head((12, 8), 1), inputs, "mse")


def classifier(inputs: dict[str, tuple[int, int]]) -> layers.Network:
    return layers.Network({c: layers.encoder(KERNELS) for c in inputs}, layers.dense_head((8, 8), 1), inputs, "bce")


def moved(x: str, mean: Column, sd: Column) -> Column:
    return F.transform(x, lambda v: (v - mean) / sd)


def of_lines(field: str) -> Column:
    """The first four values of an order's lines, on a scale that suits a network."""
    return F.transform(F.slice("v", 1, 4), lambda r: F.log1p(F.abs(r[field])) / 10)


def split_windows(w: DataFrame, columns: list[str]) -> DataFrame:
    """Windows (pid, sid, s, ``columns``, yf arrays) of cohorts, scaled by the training part's values, the last fifth in time for tests."""
    rows = cohorts(w.withColumn("user", F.col("pid")))
    placed = splits.placed_by_time(rows, ["pid"], "t_start", "user", "s").withColumn("split", F.when(F.col("place") * 5 > F.col("places") * 4, "test").otherwise("train")).drop("place", "places")
    sums = [f.alias(f"{k}_{c}") for c in columns for k, f in (("n", F.sum(F.size(c))), ("t", F.sum(models.dot(c, F.transform(c, lambda v: F.lit(1.0))))), ("q", F.sum(models.dot(c, c))))]
    stats = placed.filter("split = 'train'").groupBy("pid").agg(*sums)
    both = placed.join(stats, "pid")
    for c in columns:
        mean = F.col(f"t_{c}") / F.col(f"n_{c}")
        sd = F.sqrt(F.greatest(F.col(f"q_{c}") / F.col(f"n_{c}") - mean * mean, F.lit(1e-12)))
        both = both.withColumns({x: moved(x, mean, sd) for x in (c, "yf" if c == "x" else f"{c}_yf")})
    return written(both.drop(*[f"{k}_{c}" for c in columns for k in "ntq"]).withColumns({"row": F.xxhash64(*ROW), "label": F.array(F.col("any").cast("double"))}), "network-windows")


def scores(data: DataFrame, net: layers.Network, layers_of: DataFrame) -> DataFrame:
    made = networks.outputs(data, net, ["pid"], layers_of)
    return made.select("pid", F.col("y")[0].cast("int").alias("y"), F.col("out")[0].alias("score"))


def weighted(rows: DataFrame) -> DataFrame:
    return models.balanced(rows.withColumn("any", F.col("any").cast("int")), ["pid"], "any")


@query("q99_conv_transfer")
def q99(spark: SparkSession, d: str) -> DataFrame:
    # forecast the next sample from every training window; a head over that encoder, frozen, against the same network all free
    rows = split_windows(cut(spark, d), ["x"])
    inputs = {"x": (WIDE, 1)}
    train, test = rows.filter("split = 'train'"), rows.filter("split = 'test'")
    pre, head = forecaster(inputs), classifier(inputs)
    encoder, _ = networks.fit(networks.blocks(train, ["pid"], ["x"], "yf", "row"), pre, ["pid"], STEPS, RATE, seed=SEED)
    error = networks.rmse(networks.outputs(networks.blocks(test, ["pid"], ["x"], "yf", "row"), pre, ["pid"], encoder), ["pid"]).select("pid", "rmse")
    data, tests = networks.blocks(weighted(train), ["pid"], ["x"], "label", "row", "weight"), networks.blocks(test, ["pid"], ["x"], "label", "row")
    out = None
    for name, start, frozen in (("frozen", encoder.filter("layer like 'x.%'"), encoder_only), ("free", None, lambda n: False)):
        fitted, _ = networks.fit(data, head, ["pid"], STEPS, RATE, start, frozen, SEED)
        one = metrics.auc(scores(data, head, fitted), ["pid"]).select("pid", F.col("auc").alias("train_auc")).join(metrics.auc(scores(tests, head, fitted), ["pid"]).select("pid", F.col("auc").alias("test_auc"), "n", "n_pos"), "pid")
        one = one.withColumn("model", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return rounded(out.join(error, "pid"), 4)


@query("q100_conv_pooled")
def q100(spark, d):
    # two convolutions, the largest value over time, dense layers with dropout, two classes; one network for all, scored by split
    w = cut(spark, d).withColumn("key", F.concat_ws("/", "pid", "s")).withColumns({"user": F.col("pid"), "y": F.col("any").cast("int")})
    rows = splits.stratified_split(w.select("key", "user", "sid", "s", "y", F.transform("x", lambda v: v / 100 - 0.5).alias("x")), ["y"], "key", 0.3, SEED)
    rows = written(rows.withColumns({"row": F.xxhash64(*ROW), "label": F.array(F.col("y").cast("double"))}), "pooled-windows")
    net = layers.pooled_network(WIDE, (12, 8), (16, 8, 8))
    data = networks.blocks(models.balanced(rows.filter("split = 'train'"), ["split"]), [], ["x"], "label", "row", "weight", batches=2)
    fitted, _ = networks.fit(data, net, [], 2 * STEPS, RATE, seed=SEED)
    made = networks.outputs(networks.blocks(rows, ["split"], ["x"], "label", "row"), net, [], fitted)
    scored = made.select("row", F.col("y")[0].cast("int").alias("y"), F.col("out")[1].alias("score")).join(rows.select("row", "split"), "row")
    both = scored.withColumn("p", (F.col("score") >= 0.5).cast("int"))
    return rounded(metrics.confusion(both, ["split"], "p", "y").join(metrics.auc(both, ["split"]).select("split", "auc"), "split"), 4)


@query("q101_conv_fusion")
def q101(spark, d):
    # an encoder of the signal and one of the heart, each pretrained on its own forecast; heads over one or both, frozen
    b = one_recording(beats(spark, d))
    both = heart.tachogram(whole(spark, d, rules.before_only), b).filter("rr is not null").withColumnRenamed("rr", "h")
    rows = split_windows(cutting.windows(both, 5, 1, None, ("h",)), ["x", "h"])
    train, test = rows.filter("split = 'train'"), rows.filter("split = 'test'")
    encoders = []
    for c, ahead in (("x", "yf"), ("h", "h_yf")):
        data = networks.blocks(train, ["pid"], [c], ahead, "row")
        encoders.append(networks.fit(data, forecaster({c: (WIDE, 1)}), ["pid"], STEPS, RATE, seed=SEED)[0].filter(F.col("layer").startswith(f"{c}.")))
    start, out = reduce(DataFrame.unionByName, encoders), None
    for name, columns in (("signal", ["x"]), ("signal+heart", ["x", "h"])):
        net = classifier({c: (WIDE, 1) for c in columns})
        fitted, _ = networks.fit(networks.blocks(weighted(train), ["pid"], columns, "label", "row", "weight"), net, ["pid"], STEPS, RATE, start, encoder_only, SEED)
        one = metrics.auc(scores(networks.blocks(test, ["pid"], columns, "label", "row"), net, fitted), ["pid"]).withColumn("inputs", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return rounded(out, 4)


@query("q102_conv_items")
def q102(spark, d):
    # six items at once from six short signals of an order, an encoder for each; the error of each item
    signals = ["l_quantity", "l_discount", "l_tax", "l_extendedprice", "l_partkey", "l_suppkey"]
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[F.col(c).cast("double").alias(c) for c in signals])
    orders = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", *signals))).alias("v")).filter("size(v) >= 4")
    rows = orders.select("l_orderkey", *[of_lines(c).alias(c) for c in signals]).withColumn("items", F.array(*[F.aggregate(c, F.lit(0.0), lambda s, v: s + v) / 4 for c in signals]))
    rows = written(rows, "items")
    inputs = {c: (4, 1) for c in signals}
    net = layers.Network({c: [layers.Conv(2, 3), layers.Leaky()] for c in signals}, layers.dense_head((12,), 6), inputs, "mse")
    held = F.col("l_orderkey") % 10 == 0
    fitted, _ = networks.fit(networks.blocks(rows.filter(~held), [], signals, "items", "l_orderkey", batches=2), net, [], 2 * STEPS, RATE, seed=SEED)
    return rounded(networks.item_errors(networks.outputs(networks.blocks(rows.filter(held), [], signals, "items", "l_orderkey"), net, [], fitted), []), 4)
