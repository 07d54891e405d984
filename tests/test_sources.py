import csv

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F, types as T

from fleetlens.schema import base_feature, feature_columns, feature_window
from fleetlens.sources import traffic as src
from fleetlens.streaming.scoring import stream_score
from fleetlens.operators import thresholds as th


def _write(folder, name, rows):
    with open(folder / name, "w", newline="") as f:
        csv.writer(f).writerows([["a", "b"], *rows])


@pytest.fixture()
def raw(tmp_path):
    _write(tmp_path, "1.benign.csv", [[1, 2], [3, 4.5]])
    _write(tmp_path, "2.mirai.udp.csv", [[5, 6]])
    return tmp_path


def test_scan_labels_and_ingest(spark, raw, tmp_path_factory):
    rows = src.label_rows(src.scan_csv(spark, [str(raw / "1.benign.csv"), str(raw / "2.mirai.udp.csv")], ["a", "b"]))
    assert rows.schema["a"].dataType == T.FloatType()
    out = str(tmp_path_factory.mktemp("traffic"))
    src.write_traffic(rows, out)
    got = {(r["device_id"], r["attack_type"]): r["b"] for r in spark.read.parquet(out).where("a > 1").collect()}
    assert got == {(1, "benign"): 4.5, (2, "udp"): 6.0}
    # A second run replaces only the devices it brings.
    src.write_traffic(rows.where("device_id = 2").withColumn("b", F.lit(7.0).cast("float")), out)
    assert {r["b"] for r in spark.read.parquet(out).collect()} == {2.0, 4.5, 7.0}


def test_wide_copy_keeps_double(spark, raw):
    rows = src.label_rows(src.scan_csv(spark, str(raw), ["a", "b"]), as_float=False)
    assert rows.schema["b"].dataType == T.DoubleType() and rows.count() == 3


@pytest.mark.parametrize("name", ["x.csv", "1.mirai.csv", "a.benign.csv", "1.a.b.c.csv"])
def test_wrong_file_names_raise(spark, tmp_path, name):
    _write(tmp_path, name, [[1, 2]])
    with pytest.raises(PySparkException):
        src.label_rows(src.scan_csv(spark, str(tmp_path / name), ["a", "b"])).collect()


def test_malformed_rows_and_empty_lists_raise(spark, tmp_path):
    _write(tmp_path, "1.benign.csv", [["oops", 2]])
    with pytest.raises(Exception, match="(?i)malformed"):
        src.scan_csv(spark, str(tmp_path), ["a", "b"]).collect()
    with pytest.raises(ValueError):
        src.scan_csv(spark, [], ["a"])


def test_manifest_and_catalog(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text("File Name, Data Count, Feature Count\n 1.benign.csv ,10,2\n9.mirai.ack.csv,5,2\n")
    assert [r[0] for r in src.file_manifest(spark, str(path)).collect()] == ["1.benign.csv", "9.mirai.ack.csv"]
    devices = spark.createDataFrame([(1, "bell")], "device int, device_name string")
    got = {r["file_name"]: r for r in src.build_file_catalog(src.read_summary(spark, str(path)), devices).collect()}
    assert got["1.benign.csv"]["attack_type"] == "benign" and got["1.benign.csv"]["n_samples"] == 10
    assert got["9.mirai.ack.csv"]["device_name"] is None and got["9.mirai.ack.csv"]["is_attack"]
    (tmp_path / "bad.csv").write_text("Name,x\na,1\n")
    with pytest.raises(KeyError):
        src.file_manifest(spark, str(tmp_path / "bad.csv"))


def test_feature_names(spark):
    names = [("MI_dir_L0.1_weight",), ("HH_L5_pcc",), ("plain",)]
    got = spark.createDataFrame(names, "f string").select(base_feature(F.col("f")), feature_window(F.col("f"))).collect()
    assert [tuple(r) for r in got] == [("MI_dir_weight", "L0.1"), ("HH_pcc", "L5"), ("plain", None)]
    with pytest.raises(ValueError):
        feature_columns(spark.createDataFrame([(True,)], "is_attack boolean"))


def test_missing_threshold_raises(spark):
    rows = spark.createDataFrame([(1, 0.5), (2, 0.5)], "device_id int, score double")
    limits = spark.createDataFrame([(1, 0.4), (2, None)], "device_id int, threshold double")
    with pytest.raises(PySparkException):
        th.apply_thresholds(rows, limits).collect()
    assert th.apply_thresholds(rows.where("device_id = 1"), limits).first()["y_pred"] == 1


def test_threshold_compares_in_float(spark):
    row = spark.createDataFrame([(0.1,)], "s float").select(th.predict(F.col("s"), F.lit(0.1)).alias("p")).first()
    assert row["p"] == 0


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = spark.createDataFrame([(i, i % 3 + 1, i / 10) for i in range(60)], "id int, device_id int, score double")
    limits = spark.createDataFrame([(d, float(d)) for d in (1, 2, 3)], "device_id int, threshold double")
    score = lambda df: th.apply_thresholds(df, limits)
    rows.where("id < 40").repartition(3).write.parquet(source)
    stream_score(spark, source, rows.schema, score, sink, state, max_files=1).awaitTermination()
    rows.where("id >= 40").write.mode("append").parquet(source)
    stream_score(spark, source, rows.schema, score, sink, state).awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(sink).select("id", "y_pred").collect())
    assert got == sorted(tuple(r) for r in score(rows).select("id", "y_pred").collect())


def test_artifact_sizes_and_histories(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "w.bin").write_bytes(b"x" * 2_097_152)
    assert src.artifact_sizes(spark, str(tmp_path / "m")).first()["size_mb"] == 2.0
    for d in (1, 2):
        folder = tmp_path / "h" / f"device_{d}" / "base"
        folder.mkdir(parents=True)
        (folder / "history.csv").write_text("epoch,loss,val_loss\n1,0.5,0.6\n")
    got = src.scan_histories(spark, str(tmp_path / "h")).collect()
    assert sorted((r["device_id"], r["model_id"], r["epoch"]) for r in got) == [(1, "base", 1), (2, "base", 1)]


def test_the_csv_of_a_row_is_found_without_a_pattern(spark):
    paths = [
        "file:/a/1.benign.csv", "file:/a/2.mirai.udp.csv/part-0.csv", "file:/a/file_name=3.gafgyt.tcp.csv/part-0.snappy", "file:/a.csv/b/4.benign.csv",
        "file:/a/x=y=5.benign.csv/part-0", "file:/a/.csv/6.benign.csv", "file:/a/7.benign.txt", "file:/a/k=8.benign.csv", "file:/a/=.csv/p", "9.benign.csv",
    ]
    rows = spark.createDataFrame([(p,) for p in paths], "p string")
    pattern = F.regexp_extract("p", "([^/=]+\\.csv)(?:/[^/]*)?$", 1)
    found = rows.select("p", src.csv_name(F.col("p")).alias("name"), pattern.alias("by_pattern")).collect()
    assert {r["p"]: r["name"] for r in found} == {r["p"]: r["by_pattern"] for r in found}
    assert "regexp_extract" not in str(src.source_file_name())
