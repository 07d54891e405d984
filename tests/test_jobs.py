"""Prepare and detection jobs, exact training, and training input."""

import inspect
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from fleetlens.functions import dense
from fleetlens.operators import autoencoder as ae, detection, lof, preparation
from fleetlens.plans import tables
from fleetlens.sources import traffic as src


def _raw(tmp_path, n=60):
    rng = np.random.default_rng(1)
    folder = tmp_path / "raw"
    folder.mkdir()
    for name in ("1.benign.csv", "1.mirai.ack.csv", "2.benign.csv"):
        lines = [f"{a:.4f},{b:.4f}" for a, b in rng.normal(int(name[0]), 2, (n, 2))]
        (folder / name).write_text("x,y\n" + "\n".join(lines) + "\n")
    return str(folder)


def test_prepare_goes_on_behind_the_last_whole_stage(spark, tmp_path):
    raw, root = _raw(tmp_path), str(tmp_path / "out")
    names = ["base", "splits", "scaler_device", "scaled_device", "scaler_fleet", "scaled_fleet"]
    first = preparation.prepare(spark, raw, ["x", "y"], root)
    assert first.ran == names
    assert preparation.prepare(spark, raw, ["x", "y"], root).ran == []
    os.remove(f"{first.paths['scaled_fleet']}/_SUCCESS")
    again = preparation.prepare(spark, raw, ["x", "y"], root)
    assert again.ran == ["scaled_fleet"] and again.paths == first.paths
    other = preparation.prepare(spark, raw, ["x", "y"], root, seed=7)
    assert other.ran == names[1:] and other.paths["base"] == first.paths["base"] and os.path.isdir(first.paths["splits"])
    rows = spark.read.parquet(first.paths["scaled_device"])
    counts = {(r["device_id"], r["split"]): r["count"] for r in rows.groupBy("device_id", "split").count().collect()}
    assert counts == {(1, "train"): 36, (1, "val"): 12, (1, "test_benign"): 12, (1, "test_attack"): 60, (2, "train"): 36, (2, "val"): 12, (2, "test_benign"): 12}
    for r in rows.where("split = 'train'").groupBy("device_id").agg(F.avg("x").alias("m"), F.stddev_pop("y").alias("s")).collect():
        assert r["m"] == pytest.approx(0, abs=1e-6) and r["s"] == pytest.approx(1, abs=1e-6)


def test_stored_scaler_and_raw_files_are_checked(spark, tmp_path):
    spark.createDataFrame([(1, 0.0)], "device_id int, mean_x double").write.parquet(str(tmp_path / "s"))
    with pytest.raises(TypeError):
        preparation.load_scaler(spark, str(tmp_path / "s"), ["x"])
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError):
        preparation.prepare(spark, str(tmp_path / "empty"), ["x"], str(tmp_path / "o"))


def _vectors(spark, n=240, width=4, devices=2):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        split = "test_attack" if i % 6 == 5 else ("train", "train", "train", "val", "test_benign")[i % 5]
        x = rng.normal(0, 1, width) + (3 if split == "test_attack" else 0)
        family = "mirai" if split == "test_attack" else "benign"
        rows.append((1 + i % devices, i, [float(v) for v in x.astype("float32")], split, split == "test_attack", family, family))
    return spark.createDataFrame(rows, "device_id int, id long, features array<float>, split string, is_attack boolean, attack_family string, attack_type string")


def test_each_device_is_refitted_with_its_own_k_and_metric(spark, tmp_path):
    points = _vectors(spark)
    train, val = (points.where(F.col("split") == s).select("device_id", "id", "features") for s in ("train", "val"))
    best = spark.createDataFrame([(1, 4, "manhattan"), (2, 7, "euclidean")], "device_id int, n_neighbors int, metric string")
    lof.save_model(lof.lof_refit(train, best), str(tmp_path / "m"))
    model = lof.load_model(spark, str(tmp_path / "m"))
    got = {r["id"]: r["score"] for r in lof.lof_rescore(val, model).collect()}
    for device, k, metric in ((1, 4, "manhattan"), (2, 7, "euclidean")):
        own = train.where(F.col("device_id") == device)
        alone = lof.lof_score(val.where(F.col("device_id") == device), lof.lof_fit(own, k, metric), k, metric).collect()
        assert alone and all(got[r["id"]] == pytest.approx(r["score"]) for r in alone)
    with pytest.raises(Exception, match="no trial for device_id 2"):
        lof.lof_refit(train, best.where("device_id = 1")).collect()


@pytest.mark.parametrize("fleet", [False, True])
def test_an_autoencoder_run_is_read_back_from_its_folder(spark, tmp_path, fleet):
    points = _vectors(spark)
    path = detection.detect_autoencoder(points, str(tmp_path / "run"), {"hidden_dims": [4], "latent_dim": 2}, fleet=fleet, epochs=2, batch_size=16)
    predictions, records = detection.read_run(spark, path)
    test = points.where("split like 'test_%'").count()
    assert predictions.count() == test and {r["is_attack"] for r in predictions.collect()} == {True, False}
    rows = records.orderBy("device_id").collect()
    assert [r["device_id"] for r in rows] == [1, 2] and all(r["n_scored"] == test and r["seconds"] > 0 and r["rows_per_second"] > 0 for r in rows)
    assert len({r["threshold"] for r in rows}) == (1 if fleet else 2)
    limits = {r["device_id"]: np.float32(r["threshold"]) for r in rows}
    assert all(r["y_pred"] == int(np.float32(r["score"]) > limits[r["device_id"]]) for r in predictions.collect())
    assert spark.read.parquet(f"{path}/scores").where("split = 'val'").count() == points.where("split = 'val'").count()
    points.write.parquet(str(tmp_path / "other"))
    with pytest.raises(TypeError):
        src.read_predictions(spark, str(tmp_path / "other"))


@pytest.mark.parametrize("optimizer", ["sgd", "adam"])
def test_exact_training_is_that_of_one_machine(spark, optimizer):
    points = _vectors(spark, 90, devices=1)
    config = {"hidden_dims": [3], "latent_dim": 2, "optimizer": optimizer, "learning_rate": 0.05, "l2_reg": 0.01}
    table = ae.training_table(points).repartition(4)
    models, history = ae.train(table, [(1, "m", config)], epochs=4, exact=True, restore_best=False, patience=None)
    spec = dense.complete(config, 4)
    x = np.array([r["features"] for r in points.where("split = 'train'").collect()], "float64")
    state = {"params": dense.initial(spec, 42), "t": 0, "lr": 0.05}
    state |= {"m": np.zeros_like(state["params"]), "v": np.zeros_like(state["params"])}
    for r in history.orderBy("epoch").collect():
        loss, grad = dense.gradients(spec, state["params"].copy(), x, np.random.default_rng(0))
        dense.update(spec, state, grad)
        assert r["loss"] == pytest.approx(loss)
    assert models.first()["params"] == pytest.approx(state["params"].tolist())
    with pytest.raises(ValueError):
        ae.train(table, [(1, "m", {**config, "batch_norm": True})], exact=True)


def test_batches_do_not_depend_on_how_rows_arrive(spark):
    table = ae.training_table(_vectors(spark, 400))
    plan = [(d, "m", {"hidden_dims": [4], "latent_dim": 2, "dropout_rate": 0.1}) for d in (1, 2)]
    found = []
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("7", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            _, history = ae.train(table, plan, epochs=2, batch_size=32, buffer_rows=50)
            found.append([(r["loss"], r["val_loss"]) for r in history.orderBy("device_id", "epoch").collect()])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert found[0] == [pytest.approx(r) for r in found[1]]


def test_every_query_is_a_function_of_session_and_folder():
    for name, query in entry_module.queries().items():
        assert inspect.isfunction(query) and len(inspect.signature(query).parameters) == 2, name
    assert len(tables.QUERIES) == len({id(q) for q in tables.QUERIES.values()}) >= 92
