import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.functions.expressions import half_up
from fleetlens.operators import sampling


def _traffic(spark, sizes):
    rows = [(d, f"{d}-{attack}-{i}", attack) for d, n, attack in sizes for i in range(n)]
    return spark.createDataFrame(rows, "device_id int, k string, is_attack boolean")


@pytest.mark.parametrize("n", [0, 1, 4, 5, 49548])
def test_split_sizes_follow_the_floor_rule(spark, n):
    df = spark.range(n).select(F.lit(1).alias("device_id"), F.col("id").cast("string").alias("k"), F.lit(False).alias("is_attack"))
    got = {r[0]: r[1] for r in sampling.split_benign(df, "k").groupBy("split").count().collect()}
    train, val = int(n * 0.6), int(n * (0.6 + 0.2)) - int(n * 0.6)
    expected = {"train": train, "val": val, "test_benign": n - train - val}
    assert got == {k: v for k, v in expected.items() if v}


def test_splits_are_disjoint_complete_and_partition_independent(spark):
    df = _traffic(spark, [(1, 500, False), (2, 11, False), (2, 30, True)])
    a = {r["k"]: r["split"] for r in sampling.split_benign(df, "k").collect()}
    b = {r["k"]: r["split"] for r in sampling.split_benign(df.repartition(7), "k").collect()}
    assert len(a) == 541 and a == b
    assert {s for k, s in a.items() if k.startswith("2-True")} == {"test_attack"}
    assert a != {r["k"]: r["split"] for r in sampling.split_benign(df, "k", seed=1).collect()}


def test_sample_sizes(spark):
    df = _traffic(spark, [(1, 250, False), (2, 30, False)])
    assert sampling.sample_exact(df, "k", 0.05).count() == 14
    per = {r[0]: r[1] for r in sampling.sample_exact(df, "k", 0.05, group=["device_id"]).groupBy("device_id").count().collect()}
    assert per == {1: 12, 2: 2}  # 12.5 and 1.5 round half to even


def _predictions(spark, n_benign=200, n_attack=900):
    rows = [(f"b{i}", 0, int(i % 20 == 0)) for i in range(n_benign)] + [(f"a{i}", 1, int(i % 3 > 0)) for i in range(n_attack)]
    return spark.createDataFrame(rows, "k string, y_true int, y_pred int")


def test_prevalence_counts_equal_drawn_rows(spark):
    df = _predictions(spark)
    counts = sampling.prevalence_counts(df, "k", [0.5, 0.1, 0.001], repeats=3).collect()
    assert len(counts) == 9
    import hashlib

    attacks = [(r["k"], r["y_pred"]) for r in df.where("y_true = 1").collect()]
    for r in counts:
        need = int(r["prevalence"] / (1 - r["prevalence"]) * 200)
        order = sorted(attacks, key=lambda a: hashlib.md5(f"{a[0]}|{42 + r['repeat']}".encode()).hexdigest())
        assert (r["n_attack"], r["fp"], r["tn"]) == (need, 10, 190)
        assert r["tp"] == sum(p for _, p in order[:need]) and r["tp"] + r["fn"] == need


def test_prevalence_sample_rounds_and_checks(spark):
    df = _predictions(spark)
    assert sampling.prevalence_sample(df, "k", 0.1).where("y_true = 1").count() == 22
    with pytest.raises(ValueError):
        sampling.prevalence_sample(df, "k", 0.9)


def test_bootstrap_agrees_with_plain_resampling(spark):
    rng = np.random.default_rng(3)
    values = rng.exponential(1.0, 400).astype("float32")
    df = spark.createDataFrame([(1, float(v)) for v in values], "device_id int, score float")
    got = sampling.bootstrap_stability(df, ["device_id"], "score", {"P50": 0.5, "P90": 0.9}, repeats=3000).collect()
    for r in got:
        p = {"P50": 50, "P90": 90}[r["criterion"]]
        plain = np.array([np.percentile(rng.choice(values, 400), p) for _ in range(3000)])
        assert r["mean_threshold"] == pytest.approx(plain.mean(), rel=0.01)
        assert r["std_threshold"] == pytest.approx(plain.std(ddof=1), rel=0.08)
        assert r["ci_2_5"] == pytest.approx(np.percentile(plain, 2.5), rel=0.03)
        assert r["ci_97_5"] == pytest.approx(np.percentile(plain, 97.5), rel=0.03)


def test_seeded_orders_are_compiled(spark):
    """Repeats are hashed as rows; no lambda over an array is left in the plan."""
    rows = spark.createDataFrame([("a", 0), ("b", 1)], "k string, y_pred int").withColumn("_bound", F.lit("1"))
    orders = sampling._orders(rows, "k", ["y_pred"], 3, 42)
    assert "lambda" not in orders._jdf.queryExecution().executedPlan().toString()
    want = {(y, r, hashlib.md5(f"{k}|{42 + r}".encode()).hexdigest()) for k, y in (("a", 0), ("b", 1)) for r in range(3)}
    assert {(x["y_pred"], x["repeat"], x["order"]) for x in orders.collect()} == want


def test_prevalence_samples_are_compiled(spark):
    """Samples are picked by a comparison of rows; no lambda over an array is left in the plan."""
    rows = spark.range(60).select(F.col("id").cast("string").alias("k"), (F.col("id") % 3 > 0).cast("byte").alias("y_true"), F.lit(1).alias("y_pred"))
    samples = sampling.prevalence_samples(rows, "k", [0.5, 0.2])
    assert "lambda" not in samples._jdf.queryExecution().executedPlan().toString()
    counts = {(r["prevalence"], r["y_true"]): r["count"] for r in samples.groupBy("prevalence", "y_true").count().collect()}
    assert counts == {(0.5, 0): 20, (0.5, 1): 20, (0.2, 0): 20, (0.2, 1): 5}


def test_half_up_equals_round(spark):
    values = [0.0, -0.0, 0.5, -0.5, 1.5, 2.5, -2.5, 0.49999999999999994, 1e15 + 0.5, 4503599627370497.5, 123.45 * 100, 1.005 * 100, None]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(half_up(F.col("v")).alias("a"), F.round("v").cast("long").alias("b"))
    assert all(r["a"] == r["b"] for r in got.collect())
