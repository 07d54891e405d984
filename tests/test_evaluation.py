import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.operators import comparison, evaluation, profiling, records, scaling, thresholds as th
from fleetlens.operators.joins import skew_join


def _pred(spark, rows):
    return spark.createDataFrame(
        [(d, float(s), y, p, "benign" if y == 0 else "gafgyt", "benign" if y == 0 else t) for d, s, y, p, t in rows],
        "device_id int, score float, y_true int, y_pred int, attack_family string, attack_type string",
    )


def test_metrics_with_empty_cells(spark):
    only_attacks = _pred(spark, [(1, 1, 1, 1, "tcp"), (1, 1, 1, 0, "tcp")])
    r = evaluation.metric_table(only_attacks).first()
    assert (r["recall"], r["fpr"], r["mcc"], r["precision"], r["balanced_accuracy"]) == (0.5, 0.0, 0.0, 1.0, 0.5)
    only_benign = _pred(spark, [(1, 1, 0, 0, "")])
    r = evaluation.metric_table(only_benign).first()
    assert (r["recall"], r["precision"], r["f1"], r["specificity"], r["balanced_accuracy"]) == (0.0, 0.0, 0.0, 1.0, 1.0)


def test_auc_and_curves_with_ties(spark):
    df = _pred(spark, [(1, 1, 0, 0, ""), (1, 1, 1, 0, "tcp"), (1, 2, 1, 0, "tcp"), (1, 2, 1, 0, "udp")])
    assert evaluation.roc_auc(df, ["device_id"]).first()["auc"] == pytest.approx(5 / 6)
    points = sorted((r["fpr"], round(r["tpr"], 6)) for r in evaluation.roc_curve(df, ["device_id"]).collect())
    assert points == [(0.0, 0.0), (0.0, round(2 / 3, 6)), (1.0, 1.0)]
    assert evaluation.average_precision(df, ["device_id"]).first()["average_precision"] == pytest.approx(2 / 3 + 1 / 3 * 0.75)
    assert evaluation.pr_curve(df, ["device_id"]).where("threshold is null").first()["precision"] == 1.0


def test_a_row_without_score_comes_behind_negative_scores(spark):
    rows = [(1, None, 0), (1, -1.0, 1), (1, -2.0, 0), (1, 3.0, 1), (1, 0.0, 0)]
    df = spark.createDataFrame(rows, "device_id int, score float, y_true int")
    found = [(r["threshold"], round(r["fpr"], 3), r["tpr"]) for r in evaluation.roc_curve(df, ["device_id"]).orderBy(F.desc("threshold")).collect()]
    # The step to null repeats that to -2, so -2 is no corner.
    assert found == [(float("inf"), 0.0, 0.0), (3.0, 0.0, 0.5), (0.0, 0.333, 0.5), (-1.0, 0.333, 1.0), (None, 1.0, 1.0)]


def test_auc_is_invariant_under_monotone_maps(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 500)
    df = _pred(spark, [(1, s, int(t), 0, "tcp") for s, t in zip(rng.normal(size=500) + y, y)])
    a = evaluation.roc_auc(df, []).first()["auc"]
    b = evaluation.roc_auc(df.withColumn("score", F.exp(F.col("score").cast("double"))), []).first()["auc"]
    assert a == b and 0.6 < a < 0.9


def test_mcc_search_against_all_candidates(spark):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 300)
    s = (np.round(rng.normal(size=300) + 1.5 * y, 1)).astype("float32")
    df = _pred(spark, [(1, v, int(t), 0, "tcp") for v, t in zip(s, y)])
    best, arg = -np.inf, None
    s = s.astype(float)
    for t in np.unique(np.quantile(s, np.linspace(0, 0.9, 60))):
        p = s > t
        tp, fp, tn, fn = (p & (y == 1)).sum(), (p & (y == 0)).sum(), (~p & (y == 0)).sum(), (~p & (y == 1)).sum()
        den = np.sqrt(float(tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
        m = (tp * tn - fp * fn) / den if den else 0.0
        if m > best + 1e-12:
            best, arg = m, t
    got = evaluation.mcc_threshold(df, ["device_id"], n_candidates=60, min_quantile=0.0, max_quantile=0.9).first()
    assert got["threshold"] == pytest.approx(arg) and got["mcc"] == pytest.approx(best)


def test_histogram_equals_numpy(spark):
    rng = np.random.default_rng(5)
    s = np.append(rng.exponential(1, 400), [2.0, 0.0]).astype("float32")
    df = _pred(spark, [(1, v, 0, 0, "") for v in s])
    hist, _ = np.histogram(s.astype(float), bins=np.linspace(0, 2.0, 80))
    limits = spark.createDataFrame([(1, 2.0)], "device_id int, hi double")
    got = {r["bin"]: r["n"] for r in evaluation.score_histogram(df, limits).collect()}
    assert got == {i: int(n) for i, n in enumerate(hist) if n}


def test_ks_equals_plain_definition(spark):
    rng = np.random.default_rng(6)
    a, b = np.round(rng.normal(size=90), 1), np.round(rng.normal(0.4, 1, 60), 1)
    rows = [(1, float(v), "train") for v in a] + [(1, float(v), "val") for v in b]
    df = spark.createDataFrame(rows, "device_id int, score double, split string")
    grid = np.concatenate([a, b])
    expected = max(abs((a <= v).mean() - (b <= v).mean()) for v in grid)
    assert th.ks_report(df, ["device_id"]).first()["ks_statistic"] == pytest.approx(expected)


def test_p99_threshold_lets_at_most_one_percent_through(spark):
    df = spark.createDataFrame([(1, float(i)) for i in range(1000)], "device_id int, score double")
    table = th.threshold_fpr(df, th.threshold_criteria(df, ["device_id"]), ["device_id"])
    assert table.where("criterion = 'p99'").first()["fpr"] <= 0.01


def test_scaler_constant_column_and_moments(spark):
    df = spark.createDataFrame([(1, 1.0, 7.0), (1, 3.0, 7.0), (1, 8.0, 7.0)], "device_id int, a double, c double")
    for by in ("device_id", None):
        out = scaling.apply_scaler(df, scaling.fit_scaler(df, ["a", "c"], by), ["a", "c"], by)
        values = np.array([[r["a"], r["c"]] for r in out.collect()])
        assert values[:, 1].tolist() == [0, 0, 0]
        assert values[:, 0].mean() == pytest.approx(0, abs=1e-6) and values[:, 0].std() == pytest.approx(1, abs=1e-6)


def test_pca_shares(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 3)) @ np.diag([1, 1, 1]) + rng.normal(size=(300, 1))
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id int, a double, b double, c double")
    rows, explained = scaling.principal_components(df, ["a", "b", "c"], ["id"])
    z = (x - x.mean(0)) / x.std(0)
    expected = np.sort(np.linalg.eigvalsh(np.cov(z.T)))[::-1]
    assert [r["ratio"] for r in explained.collect()] == pytest.approx((expected / expected.sum())[:2], rel=1e-5)
    assert rows.count() == 300


def test_duplicates_on_three_keys_with_a_hot_copy(spark):
    rows = [(1.0, 1, "benign", "benign")] * 700 + [(1.0, 2, "mirai", "udp")]
    rows += [(2.0, 1, "mirai", "udp"), (2.0, 1, "mirai", "scan")] + [(float(i), 1, "gafgyt", "tcp") for i in range(10, 400)]
    df = spark.createDataFrame(rows, "x double, device_id int, attack_family string, attack_type string")
    def count(keys):
        return profiling.duplicate_mask(df, keys).where("is_duplicate").count()

    labels = ["device_id", "attack_family", "attack_type"]
    assert (count(["x", *labels]), count(["x", "device_id"]), count(["x"])) == (700, 702, 703)
    assert profiling.duplicate_mask(df, ["x"]).count() == len(rows)
    for keys, n in ((["x", *labels], 700), (["x", "device_id"], 702), (["x"], 703)):
        total = profiling.duplicate_summary(df, keys).where("device_family = 'Total'").first()
        assert (total["n_samples"], total["n_duplicates"]) == (len(rows), n)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_skew_join_equals_join(spark, how):
    big = spark.createDataFrame([(0, i) for i in range(3000)] + [(i % 50 + 1, i) for i in range(1500)] + [(None, 9)], "k int, v int")
    small = spark.createDataFrame([(i, i * 10) for i in range(0, 40)], "k int, w int")
    a = sorted(map(str, skew_join(big, small, ["k"], how).collect()))
    assert a == sorted(map(str, big.join(small, ["k"], how).select("k", "v", "w").collect()))


def test_missing_and_constant_columns(spark):
    df = spark.createDataFrame([(1.0, float("nan"), "x"), (1.0, 2.0, None)], "a double, b double, s string")
    got = {r["feature"]: (r["n_missing"], r["percent"], r["overall_percent"]) for r in profiling.missing_profile(df).collect()}
    assert got["b"][:2] == (1, 50.0) and got["s"][:2] == (1, 50.0) and got["a"][2] == pytest.approx(100 / 3)
    assert profiling.constant_features(df, ["a"]).first()["n_constant"] == 1


def test_scoring_record(spark, tmp_path):
    record = records.write_and_record(spark.range(50), str(tmp_path / "p"), strategy="LOF").first()
    assert (record["strategy"], record["n_scored"]) == ("LOF", 50) and record["rows_per_second"] > 0
    assert spark.read.parquet(str(tmp_path / "p")).count() == 50


def test_union_of_strategies_and_records(spark):
    a = spark.createDataFrame([(1, 0.5)], "device_id int, score float")
    b = spark.createDataFrame([("2", 0.25, True)], "device_id string, reconstruction_error float, is_attack boolean")
    got = {r["strategy"]: (r["device_id"], r["score"], r["is_attack"]) for r in comparison.unify({"A": a, "B": b}).collect()}
    assert got == {"A": (1, 0.5, None), "B": (2, 0.25, True)}
    hist = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.4), (1, 3, 0.4), (2, 1, None)], "device_id int, epoch int, val_loss double")
    best = {r["device_id"]: r["best_epoch"] for r in records.best_epoch(hist, ["device_id"]).collect()}
    assert best == {1: 2, 2: None}
