"""Networks: gradients against finite differences, steps on Spark against NumPy, frozen parts, branches."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sensorloom.functions import layers
from sensorloom.functions.layers import Adam, Conv, Dense, Dropout, Flatten, GlobalMax, Leaky, Network, Uniform
from sensorloom.operators import networks
from sensorloom.sources import sensors

T = 9
NETS = {
    "forecast": Network({"x": layers.encoder((4, 3, 2, 3))}, layers.dense_head((5, 4), 3), {"x": (T, 1)}, "mse"),
    "two": Network({"x": [*layers.encoder((3, 2, 2, 3)), Flatten()], "h": [Conv(3, 2), Leaky(), GlobalMax()]}, layers.dense_head((4,), 1), {"x": (T, 1), "h": (5, 2)}, "bce"),
    "pooled": layers.pooled_network(T + 4, (6, 5), (7, 6, 5)),
    "same": layers.pooled_network(T, (3, 4), (5, 4), same=True),
    "items": Network({n: [Conv(2, 3), Leaky()] for n in "abc"}, layers.dense_head((4,), 6), {n: (5, 1) for n in "abc"}, "mse"),
}


def data_of(net, n=12, seed=3):
    rng = np.random.default_rng(seed)
    xs = {c: rng.normal(size=(n, *s)) for c, s in net.inputs.items()}
    y = rng.normal(size=(n, net.outputs)) if net.loss == "mse" else rng.integers(0, 2, (n, 1)).astype(float)
    return xs, y, rng.uniform(0.5, 2, n), np.arange(n) * 7


@pytest.mark.parametrize("name", NETS)
@pytest.mark.parametrize("training", [False, True])
def test_gradient_is_that_of_finite_differences(name, training):
    net = NETS[name]
    xs, y, weight, row = data_of(net)
    draw = lambda: Uniform(5, row) if training else None
    w = net.flat(net.start(1)) + 0.01
    _, grads = net.gradient(net.named(w), xs, y, weight, draw())
    got, e = net.flat(grads), 1e-6
    for k in np.random.default_rng(0).choice(net.size, min(net.size, 150), replace=False):
        step = np.eye(1, net.size, k)[0] * e
        high, low = (net.gradient(net.named(w + s), xs, y, weight, draw())[0] for s in (step, -step))
        assert abs(got[k] - (high - low) / (2 * e)) < 1e-5 * max(1, abs(got[k]))


def test_convolution_is_a_sum_of_products():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3, 8, 2))
    for width in (1, 2, 5):
        for same in (True, False):
            p = {"w": rng.normal(size=(width, 2, 4)), "b": rng.normal(size=4)}
            y, _ = Conv(4, width, same).forward(p, x, None)
            before = (width - 1) // 2 if same else 0
            for t in range(y.shape[1]):
                want = p["b"] + sum(x[:, t - before + k] @ p["w"][k] for k in range(width) if 0 <= t - before + k < 8)
                assert np.allclose(y[:, t], want)


def test_dropout_hangs_on_rows_not_places():
    x, row = np.ones((2_000, 10)), np.arange(2_000) * 3
    one, _ = Dropout(0.25).forward({}, x, Uniform(1, row))
    back, _ = Dropout(0.25).forward({}, x[::-1], Uniform(1, row[::-1]))
    assert (one[::-1] == back).all() and abs((one == 0).mean() - 0.25) < 0.02 and abs(one.mean() - 1) < 0.03
    assert (Dropout(0.25).forward({}, x, None)[0] == 1).all()


def test_without_a_branch_it_is_the_single_network():
    two = NETS["two"]
    p = two.start(4)
    xs, *_ = data_of(two)
    wide = int(np.prod(two.shapes["head.0.w"])) // two.shapes["head.0.w"][1]
    own = wide - 3  # the other encoder ends in three channels
    p["head.0.w"][own:] = 0
    one = Network({"x": two.encoders["x"]}, two.head, {"x": two.inputs["x"]}, "bce")
    q = {n: v for n, v in p.items() if not n.startswith("h.")} | {"head.0.w": p["head.0.w"][:own]}
    assert np.allclose(two.forward(p, xs)[0], one.forward(q, {"x": xs["x"]})[0], atol=1e-12)


def frame(net, n=90, seed=1):
    xs, y, weight, _ = data_of(net, n, seed)
    return pd.DataFrame({"pid": (np.arange(n) % 3).tolist(), "row": np.arange(n), "y": y.tolist(), "weight": weight} | {c: v.reshape(n, -1).tolist() for c, v in xs.items()})


def plainly(net, rows, steps, rate, frozen=lambda _: False, w=None, batches=None, seed=0):
    w = net.flat(net.start(seed)) if w is None else w
    adam = Adam(net.size, rate, net.flat({n: np.full(s, not frozen(n)) for n, s in net.shapes.items()}) > 0)
    for step in range(steps):
        some = rows if batches is None else rows[batches == step % (batches.max() + 1)]
        xs = {c: np.stack(some[c]) for c in net.encoders}
        loss, g = net.gradient(net.named(w), xs, np.stack(some.y), some.weight.to_numpy(), Uniform(seed * 1_000_003 + step * 1_009, some.row.to_numpy()), frozen)
        w = adam.step(w, net.flat(g) / some.weight.sum())
    return w


def vectors(net, table, keys=("pid",)):
    out = {}
    for r in table.collect():
        out.setdefault(tuple(r[k] for k in keys), {})[r["layer"]] = np.array(r["values"]).reshape(r["shape"])
    return {k: net.flat(p) for k, p in out.items()}


@pytest.mark.parametrize("name", ["two", "pooled", "items"])
def test_steps_on_spark_are_those_in_numpy(spark, monkeypatch, name):
    monkeypatch.setattr(networks, "BLOCK", 11)
    net, pdf = NETS[name], frame(NETS[name])
    got = []
    for parts in (1, 8):
        rows = spark.createDataFrame(pdf).repartition(parts)
        table, history = networks.fit(networks.blocks(rows, ["pid"], list(net.encoders), "y", "row", "weight"), net, ["pid"], 3, 0.01)
        got.append(vectors(net, table))
        assert history.count() == 9
    for (pid,), w in got[0].items():
        assert np.abs(w - got[1][(pid,)]).max() < 1e-9
        assert np.abs(w - plainly(net, pdf[pdf.pid == pid], 3, 0.01)).max() < 1e-9


def test_batches_and_one_group(spark):
    net, pdf = NETS["forecast"], frame(NETS["forecast"])
    data = networks.blocks(spark.createDataFrame(pdf), [], ["x"], "y", "row", "weight", batches=4)
    table, _ = networks.fit(data, net, [], 6, 0.01)
    of = {r.row: r.batch for r in spark.createDataFrame(pdf[["row"]]).select("row", F.pmod(F.xxhash64(F.col("row").cast("long")), F.lit(4)).alias("batch")).collect()}
    assert np.abs(vectors(net, table, ())[()] - plainly(net, pdf, 6, 0.01, batches=pdf.row.map(of).to_numpy())).max() < 1e-9
    made = networks.outputs(data, net, [], table).toPandas().set_index("row").sort_index()
    want = net.forward(net.named(vectors(net, table, ())[()]), {"x": np.stack(pdf.x)})[0]
    assert np.allclose(np.stack(made.out), want, atol=1e-12)
    error = np.stack(pdf.y) - want
    assert abs(networks.rmse(networks.outputs(data, net, [], table), []).first().rmse - np.sqrt((error**2).mean())) < 1e-12
    by_item = {r["item"]: r.rmse for r in networks.item_errors(networks.outputs(data, net, [], table), []).collect()}
    assert np.allclose([by_item[k] for k in range(3)], np.sqrt((error**2).mean(axis=0)))


def test_frozen_layers_stay_and_the_twins_move(spark, tmp_path):
    net, pdf = NETS["forecast"], frame(NETS["forecast"])
    data = networks.blocks(spark.createDataFrame(pdf), ["pid"], ["x"], "y", "row")
    kept = sensors.saved(spark, str(tmp_path / "encoder"), lambda: networks.fit(data, net, ["pid"], 2, 0.05)[0])
    again = sensors.saved(spark, str(tmp_path / "encoder"), lambda: pytest.fail("it is there already"))
    head = Network({"x": net.encoders["x"]}, layers.dense_head((3,), 1), net.inputs, "bce")
    y = pdf.assign(y=[[float(v[0] > 0)] for v in pdf.y])
    data = networks.blocks(spark.createDataFrame(y), ["pid"], ["x"], "y", "row")
    encoder_of = again.filter("layer like 'x.%'")
    frozen, _ = networks.fit(data, head, ["pid"], 3, 0.05, encoder_of, lambda n: n.startswith("x."))
    free, _ = networks.fit(data, head, ["pid"], 3, 0.05, encoder_of)
    before = {(r.pid, r.layer): r["values"] for r in kept.collect()}
    for r in frozen.collect():
        assert r.trained == (not r.layer.startswith("x.")) and (r.trained or r["values"] == before[r.pid, r.layer])
    assert all(r["values"] != before[r.pid, r.layer] for r in free.filter("layer like 'x.%'").collect())


def test_shapes_and_sizes_are_checked(spark, monkeypatch):
    net, pdf = NETS["forecast"], frame(NETS["forecast"])
    data = networks.blocks(spark.createDataFrame(pdf), ["pid"], ["x"], "y", "row")
    other = networks.fit(data, Network({"x": layers.encoder((2, 3, 2, 3))}, layers.dense_head((5, 4), 3), {"x": (T, 1)}), ["pid"], 1)[0]
    with pytest.raises(ValueError, match="shape"):
        networks.fit(data, net, ["pid"], 1, start=other)
    monkeypatch.setattr(networks, "MOST", 100)
    with pytest.raises(ValueError, match="fewer"):
        networks.fit(data, net, ["pid"], 1)
    with pytest.raises(ValueError, match="loss"):
        Network({"x": []}, [Dense(1)], {"x": (2, 1)}, "huber")


def test_rows_with_nulls_are_left_out(spark):
    net = NETS["forecast"]
    pdf = frame(net, 6)
    rows = spark.createDataFrame(pdf).withColumn("y", F.when(F.col("row") > 1, F.col("y")))
    assert networks.blocks(rows, ["pid"], ["x"], "y", "row").agg(F.sum("n")).first()[0] == 4
    assert networks.blocks(rows.limit(0), ["pid"], ["x"], "y", "row").count() == 0


def test_workers_get_few_blocks_at_a_time(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(networks, "HANDED", 50_000, raising=False)
    net, name, sums, writes = NETS["forecast"], "spark.sql.execution.arrow.maxBytesPerBatch", networks.models.group_sums, networks.written
    rows = spark.range(0, 200_000, numPartitions=1).select("id", *[F.array_repeat(F.lit(0.5), n).alias(c) for c, n in (("x", T), ("y", 3))])
    data = networks.blocks(rows, [], ["x"], "y", "id", batches=2)
    least, sizes = data.filter("batch = 0").count(), []

    def watched(rows, keys, part):
        def noted(some):
            with open(tmp_path / "sizes", "a") as f:
                f.write(f"{len(some)}\n")
            return part(some)

        return sums(rows, keys, noted)

    def noted_write(df, *a):
        sizes.append(spark.conf.get(name))
        return writes(df, *a)

    monkeypatch.setattr(networks.models, "group_sums", watched)
    monkeypatch.setattr(networks, "written", noted_write)
    table, _ = networks.fit(data, net, [], 1, 0.01)
    assert least >= 10 and max(map(int, (tmp_path / "sizes").read_text().split())) == 1
    assert networks.outputs(data, net, [], table).count() == 200_000 and sizes == ["50000"]
    assert spark.conf.get(name, None) is None
