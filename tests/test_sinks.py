"""Readers and sinks of results, windows, reports, models and configurations."""

import json

from pyspark.sql import functions as F

from sensorloom.sources import sensors


def test_results_by_file_name(spark, tmp_path):
    for model, loss in (("ssl_all", 0.5), ("cnn_smote", 0.7)):
        (tmp_path / f"history_{model}.csv").write_text(f"epoch,loss\n1,{loss}\n2,{loss / 2}\n")
    got = sensors.read_results(spark, [f"{tmp_path}/history_*.csv", f"{tmp_path}/none_*.csv"], "epoch int, loss double", r"history_(.+)_([^_]+)\.csv")
    assert sorted((r.key1, r.key2, r.epoch, r.loss) for r in got.collect()) == [("cnn", "smote", 1, 0.7), ("cnn", "smote", 2, 0.35), ("ssl", "all", 1, 0.5), ("ssl", "all", 2, 0.25)]
    none = sensors.read_results(spark, [f"{tmp_path}/none_*.csv"], "epoch int, loss double", r"history_(.+)\.csv")
    assert none.count() == 0 and none.columns == ["epoch", "loss", "key1"]


def test_windows_of_a_participant_are_replaced_alone(spark, tmp_path):
    w = spark.createDataFrame([("P1", "train", 1.0), ("P2", "train", 2.0), ("P2", "test", 3.0)], "pid string, split string, x double")
    sensors.write_windows(w, f"{tmp_path}/w")
    sensors.write_windows(w.filter("pid = 'P1'").withColumn("x", F.lit(9.0)), f"{tmp_path}/w")
    assert sorted(r.x for r in sensors.read_windows(spark, f"{tmp_path}/w").collect()) == [2.0, 3.0, 9.0]
    one = sensors.read_windows(spark, f"{tmp_path}/w", ["P2"])
    assert sorted(r.x for r in one.collect()) == [2.0, 3.0] and all("pid=P2" in f for f in one.select("*", F.input_file_name().alias("f")).toPandas().f)


def test_reports(spark, tmp_path):
    r = spark.createDataFrame([(0.5, "P1", (1.0, 2.0))], "auc double, participant string, test struct<acc: double, f1: double>")
    for _ in range(2):
        sensors.write_report(r, f"{tmp_path}/r", ["participant"])
    got = spark.read.csv(f"{tmp_path}/r", header=True)
    assert got.columns == ["participant", "auc", "test_acc", "test_f1"] and got.count() == 1
    sensors.write_report(r, f"{tmp_path}/r", ["participant"], "append")
    assert spark.read.csv(f"{tmp_path}/r", header=True).count() == 2


def test_models_are_made_once(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.createDataFrame([("P1", [1.0, 2.0])], "pid string, w array<double>")

    for _ in range(2):
        assert [list(r.w) for r in sensors.saved(spark, f"{tmp_path}/m", make).collect()] == [[1.0, 2.0]]
    assert made == [1]


def test_config(spark, tmp_path):
    sensors.write_config(spark, {"window": 240, "rate": 4.0, "name": "a"}, f"{tmp_path}/c")
    assert json.loads(spark.read.text(f"{tmp_path}/c").first().value) == {"window": 240, "rate": 4.0, "name": "a"}
