"""Nothing is lost without a word: caps, missing lookups, odd numbers."""

import math

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import autoencoder, evaluation, joins, lof, neighbors, ordering, sampling, scaling, thresholds
from fleetlens.session import scratch_path
from fleetlens.sources import traffic
from fleetlens.streaming.scoring import stream_score


def predictions(spark, devices=(1, 2), n=20):
    rows = [(d, f"{d}-{i}", float(i), int(i >= n // 2), int(i >= 15), "gafgyt" if i >= n // 2 else "benign", "tcp") for d in devices for i in range(n)]
    return spark.createDataFrame(rows, "device_id int, k string, score double, y_true int, y_pred int, attack_family string, attack_type string")


def test_any_number_of_criteria_keeps_its_rate(spark):
    scores = predictions(spark).select("device_id", "score")
    criteria = spark.createDataFrame([(d, f"c{i}", i / 100) for d in (1, 2) for i in range(1200)], "device_id int, criterion string, threshold double")
    got = thresholds.threshold_fpr(scores, criteria, ["device_id"]).collect()
    assert len(got) == 2400
    for r in got[::97]:
        assert r.fpr == sum(s > r.threshold for s in range(20)) / 20


def test_more_than_a_thousand_groups_are_drawn(spark):
    many = spark.range(1001).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(5)))).select(
        F.col("id").alias("g"), F.concat_ws("-", "id", "i").alias("k"), (F.col("i") >= 3).cast("int").alias("y_true"), F.lit(1).alias("y_pred")
    )
    got = sampling.prevalence_counts(many, "k", [0.5], by=["g"]).collect()
    assert len(got) == 1001 and {(r.tp, r.fp, r.n_attack) for r in got} == {(3, 3, 3)}
    assert sampling.prevalence_samples(many, "k", [0.5, 0.25], by=["g"]).groupBy("prevalence").count().collect()


def test_stream_joins_a_large_threshold_table(spark):
    source, sink = scratch_path(spark, "in"), scratch_path(spark, "out")
    predictions(spark).select("device_id", "score").write.parquet(source)
    table = spark.range(joins.LOOKUP_ROWS + 1).select(F.col("id").cast("int").alias("device_id"), F.lit(4.5).alias("threshold"))
    query = stream_score(spark, source, "device_id int, score double", lambda df: thresholds.apply_thresholds(df, table), sink)
    query.awaitTermination()
    assert spark.read.parquet(sink).groupBy().sum("y_pred").first()[0] == 30


def test_missing_lookups_are_errors(spark):
    rows = predictions(spark)
    one, both = (spark.createDataFrame([(d, 3.0) for d in ds], "device_id int, threshold double") for ds in ((1,), (1, 2)))
    limits = spark.createDataFrame([(1, 9.0)], "device_id int, hi double")
    features = rows.select("device_id", F.col("k").alias("id"), "score")
    cases = {
        "threshold": [
            lambda: evaluation.threshold_comparison(rows, one, both), lambda: evaluation.threshold_comparison(rows, both, one),
            lambda: evaluation.histogram_limits(rows, one, both), lambda: evaluation.histogram_limits(rows, both, one, zoom=True),
            lambda: evaluation.recalibrated_prevalence(rows, "k", one, [0.1]),
        ],
        "histogram limit": [lambda: evaluation.score_histogram(rows, limits)],
        "scaler": [lambda: scaling.apply_scaler(features, scaling.fit_scaler(features.where("device_id = 1"), ["score"]), ["score"])],
    }
    for what, calls in cases.items():
        for call in calls:
            with pytest.raises(Exception, match=f"{what} for device_id 2"):
                call().collect()


def test_rows_without_model_or_neighbours_are_errors(spark):
    rows = spark.createDataFrame([(1, 1, [0.0, 1.0]), (2, 2, [1.0, 0.0])], "device_id int, id long, features array<float>")
    import numpy as np

    from fleetlens.functions import dense

    spec = dense.complete({}, 2)
    models = autoencoder.model_table(spark, [(1, "net", spec, np.asarray(dense.initial(spec, 1)))])
    with pytest.raises(Exception, match="no model for device_id 2"):
        autoencoder.ae_score(rows, models).collect()
    train = spark.createDataFrame([(1, i, [float(i), 0.0]) for i in range(5)], rows.schema)
    with pytest.raises(Exception, match="no neighbours for device 2"):
        lof.lof_score(rows, lof.lof_fit(train, 2), 2).collect()


def test_negative_zero_is_zero(spark):
    train = spark.createDataFrame([(1, 1, [-0.0, 1.0]), (1, 2, [0.0, 2.0]), (1, 3, [5.0, -0.0])], "device_id int, id long, features array<float>")
    got = {r.id: [n.id for n in r.neighbors] for r in neighbors.knn_join(train, train, 1, exclude_self=True).collect()}
    assert got == {1: [2], 2: [1], 3: [1]}


def test_endless_and_missing_numbers_keep_their_order(spark):
    values = [float("-inf"), -1e308, -1.0, 0.0, 5e-324, 2.0, 1e308, float("inf"), float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = ordering.ranked_values(df, [], "v", lambda n: F.sequence(F.lit(1).cast("long"), n)).orderBy("rank").collect()
    assert [repr(r.v) for r in got] == [repr(v) for v in values] and math.isnan(got[-1].v)


def test_device_tables_are_read_whatever_their_number(spark):
    path = scratch_path(spark, "devices")
    predictions(spark, devices=range(1, 13), n=2).write.partitionBy("device_id").parquet(path)
    assert traffic.read_devices(spark, path).groupBy("device").count().count() == 12
