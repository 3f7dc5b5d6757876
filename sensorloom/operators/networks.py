"""Networks trained on Spark: tasks add up gradients of their rows, the driver moves the parameters, every group at once.

A group is a participant, a fold, or everything, and may hold any share of the rows.  Rows are packed into blocks once;
a step reads the blocks, adds gradients by task and group, then by group, and only arrays of parameters' size meet.
Parameters are tables of layers, so a run can keep them (``sensors.saved``), load them, and freeze what it likes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.layers import Adam, Network, Uniform
from ..shared import written
from . import models

#: Rows of a block, and bytes of all groups' parameters that driver and tasks hold.
BLOCK, MOST = 1_024, 256_000_000
#: Bytes of blocks that a worker gets at a time; it holds them some three times over, and an executor has a worker for each core.
HANDED = 8_000_000


@contextmanager
def handed(spark: SparkSession) -> Iterator[None]:
    """What runs inside hands a worker ``HANDED`` bytes at a time, unless the session has a size of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(name, None) is not None
    if not own:
        spark.conf.set(name, HANDED)
    try:
        yield
    finally:
        if not own:
            spark.conf.unset(name)


def kinds(df: DataFrame, keys: list[str]) -> str:
    of = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return "".join(f"{k} {of[k]}, " for k in keys)


def blocks(rows: DataFrame, keys: list[str], inputs: list[str], y: str, row: str, weight: str | None = None, batches: int = 1) -> DataFrame:
    """``rows`` in blocks (keys, batch, rows, y, weight, inputs: bytes of doubles) of one group and batch each, written.

    ``row`` is a whole number that names a row; it says which of the ``batches`` a row is in, and seeds its dropout, so
    neither depends on how rows are dealt out.  Rows with a null among keys, inputs, y or weight are left out.
    """
    batch = F.pmod(F.xxhash64("__row"), F.lit(batches)).cast("int")
    took = rows.select(*keys, F.col(row).cast("long").alias("__row"), F.col(y).cast("array<double>").alias("__y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("__w"), *[F.col(c).cast("array<double>").alias(c) for c in inputs])
    took = took.na.drop().withColumn("batch", batch)

    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list[pd.DataFrame]] = {}

        def block(key: tuple, parts: list[pd.DataFrame]) -> dict:
            some = pd.concat(parts)
            stacked = lambda c: np.stack([np.asarray(v, float) for v in some[c]]).tobytes()
            return dict(zip([*keys, "batch"], key, strict=True)) | {"n": len(some), "row": some["__row"].to_numpy(np.int64).tobytes(), "y": stacked("__y"), "weight": some["__w"].to_numpy(float).tobytes()} | {f"in_{c}": stacked(c) for c in inputs}

        for frame in frames:
            full = []
            for key, some in frame.groupby([*keys, "batch"]):
                held.setdefault(key, []).append(some)
                if sum(map(len, held[key])) >= BLOCK:
                    full.append(block(key, held.pop(key)))
            if full:
                yield pd.DataFrame(full)
        if held:
            yield pd.DataFrame([block(k, v) for k, v in held.items()])

    return written(took.mapInPandas(packed, kinds(took, keys) + "batch int, n int, row binary, y binary, weight binary, " + ", ".join(f"in_{c} binary" for c in inputs)), "blocks")


def unpacked(net: Network, block) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, y, weight, row) of a block."""
    xs = {c: np.frombuffer(getattr(block, f"in_{c}")).reshape(block.n, *net.inputs[c]) for c in net.encoders}
    return xs, np.frombuffer(block.y).reshape(block.n, -1), np.frombuffer(block.weight), np.frombuffer(block.row, np.int64)


def groups_of(rows: DataFrame, keys: list[str]) -> list[tuple]:
    return [tuple(r) for r in rows.select(*keys).distinct().collect()] if keys else [()]


def layer_table(spark: SparkSession, net: Network, keys: list[str], kind: str, params: dict[tuple, np.ndarray], frozen: Callable[[str], bool]) -> DataFrame:
    """(keys, layer, shape, values, trained): a row for each array of each group."""
    out = [(*key, name, list(v.shape), v.ravel().tolist(), not frozen(name)) for key, flat in params.items() for name, v in net.named(flat).items()]
    return spark.createDataFrame(out, kind + "layer string, shape array<int>, values array<double>, trained boolean")


def loaded(table: DataFrame, net: Network, keys: list[str], groups: list[tuple], seed: int) -> dict[tuple, np.ndarray]:
    """Parameters of each group: those of ``table`` (keys, layer, shape, values) where it has them, in the right shape (ValueError otherwise), else new ones."""
    start = {g: net.start(seed) for g in groups}
    for r in table.filter(F.col("layer").isin(list(net.shapes))).collect() if table is not None else []:  # groups times layers, as bounded as below
        key = tuple(r[k] for k in keys)
        if key in start:
            if tuple(r["shape"]) != net.shapes[r["layer"]]:
                raise ValueError(f"{r['layer']} has the shape {tuple(r['shape'])}, not {net.shapes[r['layer']]}")
            start[key][r["layer"]] = np.array(r["values"]).reshape(r["shape"])
    return {g: net.flat(p) for g, p in start.items()}


def fit(data: DataFrame, net: Network, keys: list[str], steps: int, rate: float = 1e-3, start: DataFrame | None = None, frozen: Callable[[str], bool] = lambda _: False, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Layers (keys, layer, shape, values, trained) and history (keys, step, loss) of a network for each group of ``data`` (of ``blocks``).

    Each step reads one of the batches of ``data`` and takes the mean of its rows' weighted losses.  ``start`` has layers to begin
    with; layers that are ``frozen`` stay bit for bit.  ValueError where all groups' parameters are more than driver and
    tasks should hold: fit fewer groups at once then.
    """
    spark, kind = data.sparkSession, kinds(data, keys)
    groups = groups_of(data, keys)
    batches = 1 + (data.agg(F.max("batch")).first()[0] or 0)
    if len(groups) * net.size * 8 > MOST:
        raise ValueError(f"{len(groups)} groups of {net.size} parameters; fit fewer at once")
    params = loaded(start, net, keys, groups, seed)
    moves = net.flat({n: np.full(s, not frozen(n)) for n, s in net.shapes.items()}) > 0
    adam = {g: Adam(net.size, rate, moves) for g in groups}
    history = []
    for step in range(steps):
        now = spark.sparkContext.broadcast(params)  # MOST bytes at most

        def part(some: pd.DataFrame, now=now, step=step) -> np.ndarray:
            total = np.zeros(net.size + 2)
            for block in some.itertuples():
                xs, y, weight, row = unpacked(net, block)
                key = tuple(getattr(block, k) for k in keys)
                loss, grads = net.gradient(net.named(now.value[key]), xs, y, weight, Uniform(seed * 1_000_003 + step * 1_009, row), frozen)
                total += np.concatenate([net.flat(grads), [loss, weight.sum()]])
            return total

        sums = models.group_sums(data.filter(F.col("batch") == step % batches), keys, part)
        added = models.solved(sums, keys, lambda v: {"total": v.tobytes()}, "total binary")
        with handed(spark):
            met = added.collect()  # an array of parameters' size for each group
        for r in met:
            key, total = tuple(r[k] for k in keys), np.frombuffer(r["total"])
            if total[-1] > 0:
                history.append((*key, step, float(total[-2] / total[-1])))
                params[key] = adam[key].step(params[key], total[:-2] / total[-1])
        now.unpersist()
    losses = spark.createDataFrame(history, kind + "step int, loss double")
    return layer_table(spark, net, keys, kind, params, frozen), losses


def outputs(data: DataFrame, net: Network, keys: list[str], layers: DataFrame) -> DataFrame:
    """(keys, row, y, out): what the networks of ``layers`` make of each row of ``data`` (of ``blocks``), written; probabilities where the loss is of classes.

    Groups that ``layers`` lacks have no rows.
    """
    params = loaded(layers, net, keys, groups_of(layers, keys), 0)
    if len(params) * net.size * 8 > MOST:
        raise ValueError(f"{len(params)} groups of {net.size} parameters; score fewer at once")
    now = data.sparkSession.sparkContext.broadcast(params)

    def made(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for block in frame.itertuples():
                key = tuple(getattr(block, k) for k in keys)
                if key in now.value:
                    xs, y, _, row = unpacked(net, block)
                    out, _ = net.forward(net.named(now.value[key]), xs)
                    if net.loss == "bce":
                        out = 1 / (1 + np.exp(-np.clip(out, -500, 500)))
                    elif net.loss == "softmax":
                        out = np.exp(out - out.max(axis=1, keepdims=True))
                        out /= out.sum(axis=1, keepdims=True)
                    yield pd.DataFrame({k: [v] * block.n for k, v in zip(keys, key, strict=True)} | {"row": row, "y": list(y), "out": list(out)})

    with handed(data.sparkSession):
        return written(data.mapInPandas(made, kinds(data, keys) + "row long, y array<double>, out array<double>"), "outputs")


def rmse(made: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, rmse) over all outputs of ``outputs``' rows."""
    error = F.aggregate(F.zip_with("out", "y", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    return made.groupBy(*keys).agg(F.count("*").alias("n"), F.sqrt(F.sum(error) / F.sum(F.size("y"))).alias("rmse"))


def item_errors(made: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, item, rmse): the error of each output."""
    each = made.select(*keys, F.posexplode(F.zip_with("out", "y", lambda a, b: (a - b) * (a - b))).alias("item", "e"))
    return each.groupBy(*keys, "item").agg(F.sqrt(F.avg("e")).alias("rmse"))
