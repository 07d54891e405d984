import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.functions import dense
from fleetlens.operators import autoencoder as ae, lof, neighbors


def _points(spark, arrays):
    rows = [(d, i, [float(x) for x in v]) for d, vs in arrays.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "device_id int, id long, features array<float>")


def _brute(q, t, k, metric, skip):
    out = {}
    for i, x in enumerate(q):
        d = neighbors.pair_distances(np.repeat(x[None], len(t), 0), t, metric)
        order = [j for j in np.lexsort((np.arange(len(t)), d)) if not (skip and j == i)]
        out[i] = [(int(j), float(d[j])) for j in order[:k]]
    return out


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
@pytest.mark.parametrize("flat_cells", [4096, 3])
def test_knn_join_is_exact_with_many_cells_blocks_and_copies(spark, monkeypatch, metric, flat_cells):
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 16)
    monkeypatch.setattr(neighbors, "QUERY_ROWS", 30)
    rng = np.random.default_rng(0)
    clustered = np.concatenate([rng.normal(c, 0.3, (60, 3)) for c in (0, 5, 10)] + [np.full((70, 3), 2.5)])
    arrays = {1: clustered.astype("float32"), 2: rng.normal(0, 1, (9, 3)).astype("float32")}
    arrays |= {d: rng.normal(0, 1, (20 * d, 3)).astype("float32") for d in range(3, 12)}
    points = _points(spark, arrays)
    got = neighbors.knn_join(points, points, 5, metric=metric, exclude_self=True, cell_rows=24, flat_cells=flat_cells).collect()
    assert len(got) == sum(len(v) for v in arrays.values())
    for d, values in arrays.items():
        expected = _brute(values.astype("float64"), values.astype("float64"), 5, metric, True)
        for r in (r for r in got if r["device_id"] == d):
            assert [(n["id"], pytest.approx(n["dist"])) for n in r["neighbors"]] == expected[r["id"]]


def test_visits_do_not_grow_with_clustered_data(spark, monkeypatch):
    sent = {}
    for n in (2000, 8000):
        rng = np.random.default_rng(n)
        centres = rng.normal(0, 50, (n // 100, 8))
        points = _points(spark, {1: (centres[np.arange(n) % len(centres)] + rng.normal(0, 0.1, (n, 8))).astype("float32")})
        rows = {}
        keep = neighbors.staged
        monkeypatch.setattr(neighbors, "staged", lambda df, label, keep=keep, rows=rows: rows.setdefault(label, keep(df, label)))
        assert neighbors.knn_join(points, points, 5, exclude_self=True, cell_rows=200).count() == n
        monkeypatch.setattr(neighbors, "staged", keep)
        sent[n] = rows["knn-sent"].count() / n
    assert sent[8000] <= max(1.5 * sent[2000], 1.0)


def test_knn_keeps_queries_of_a_device_without_train_rows(spark):
    q, t = _points(spark, {1: [[0.0]], 2: [[1.0]]}), _points(spark, {1: [[3.0]]})
    got = {r["device_id"]: r["neighbors"] for r in neighbors.knn_join(q, t, 2).collect()}
    assert got[2] == [] and got[1][0]["dist"] == 3.0
    with pytest.raises(ValueError):
        neighbors.knn_join(q, t, 2, metric="cosine")


def test_density_by_hand(spark, tmp_path):
    train = _points(spark, {1: [[0.0], [1.0], [10.0]]})
    model = {r["id"]: r for r in lof.lof_fit(train, 1).collect()}
    assert {i: r["kdist"] for i, r in model.items()} == {0: 1.0, 1: 1.0, 2: 9.0}
    assert model[2]["lrd"] == pytest.approx(1 / 9) and model[0]["lrd"] == pytest.approx(1.0)
    lof.save_model(lof.lof_fit(train, 1), str(tmp_path / "m"))
    loaded = lof.load_model(spark, str(tmp_path / "m"))
    far = lof.lof_score(_points(spark, {1: [[20.0]]}), loaded, 1).first()["score"]
    # Nearest is 10, reach = max(10, 9); density ratio (1/9) / (1/10).
    assert far == pytest.approx((1 / 9) * 10)
    train.write.parquet(str(tmp_path / "other"))
    with pytest.raises(TypeError):
        lof.load_model(spark, str(tmp_path / "other"))


def test_fixed_small_net(spark):
    spec = dense.complete({"hidden_dims": [1], "latent_dim": 1, "activation": "linear"}, 2)
    # 2-1-1-1-2, all weights one, no bias: every output is x1 + x2.
    flat = np.concatenate([[1, 1, 0], [1, 0], [1, 0], [1, 1, 0, 0]]).astype(float)
    models = ae.model_table(spark, [(1, "c", spec, flat)])
    rows = _points(spark, {1: [[1.0, 2.0]]})
    assert list(ae.ae_reconstruct(rows, models).first()["reconstruction"]) == [3.0, 3.0]
    assert list(ae.ae_encode(rows, models).first()["latent"]) == [3.0]
    got = {e: ae.ae_score(rows, models, e).first()["score"] for e in dense.ERRORS}
    assert got == {"mse": 2.5, "mae": 1.5, "rmse": pytest.approx(2.5**0.5)}
    with pytest.raises(ValueError):
        ae.ae_score(rows, models, "huber")


@pytest.mark.parametrize("loss,bn", [("mse", False), ("mse", True), ("mae", False)])
def test_gradient_matches_differences(loss, bn):
    spec = dense.complete({"hidden_dims": [4], "latent_dim": 2, "activation": "tanh", "loss": loss, "batch_norm": bn, "l2_reg": 0.01}, 3)
    rng = np.random.default_rng(1)
    x, vector = rng.normal(size=(12, 3)), dense.initial(spec, 5)
    _, grad = dense.gradients(spec, vector.copy(), x, rng)
    for i in rng.choice(len(vector), 12, replace=False):
        step = np.zeros_like(vector)
        step[i] = 1e-5
        if bn and grad[i] == 0:
            continue
        up, down = (dense.gradients(spec, vector + s, x, rng)[0] for s in (step, -step))
        assert grad[i] == pytest.approx((up - down) / 2e-5, rel=2e-3, abs=1e-6)


def _training_rows(spark, n=400):
    rng = np.random.default_rng(2)
    z = rng.normal(size=(n, 2))
    x = np.concatenate([z, z @ np.array([[1.0, 0.5], [-1.0, 2.0]])], axis=1)
    rows = [(1 + i % 2, i, [float(v) for v in x[i]], "val" if i % 5 == 0 else "train") for i in range(n)]
    return spark.createDataFrame(rows, "device_id int, id long, features array<float>, split string")


def test_training_lowers_the_loss_for_devices_and_fleet(spark):
    rows = _training_rows(spark)
    config = {"hidden_dims": [8], "latent_dim": 2, "learning_rate": 0.01}
    for devices in ([1, 2], [ae.FLEET]):
        table = ae.training_table(rows, fleet=devices == [ae.FLEET])
        models, history = ae.train(table, [(d, "c", config) for d in devices], epochs=8, batch_size=16)
        for d in devices:
            losses = [r["val_loss"] for r in history.where(F.col("device_id") == d).orderBy("epoch").collect()]
            assert len(losses) == 8 and min(losses[-2:]) < 0.7 * losses[0]
        assert models.where("best_epoch is not null").count() == len(devices)


def test_averaging_over_tasks_learns_too(spark, monkeypatch):
    monkeypatch.setattr(ae, "ROWS_PER_TASK", 200)
    rows = _training_rows(spark, 1200)
    plan = [(1, "c", {"hidden_dims": [8], "latent_dim": 2, "learning_rate": 0.01})]
    _, history = ae.train(ae.training_table(rows), plan, epochs=10, batch_size=8)
    losses = [r["val_loss"] for r in history.orderBy("epoch").collect()]
    assert losses[-1] < 0.7 * losses[0]


def test_early_stop_and_plateau(spark):
    rows = _training_rows(spark, 60)
    plan = [(1, "c", {"hidden_dims": [4], "latent_dim": 2, "learning_rate": 1e-9})]
    _, history = ae.train(ae.training_table(rows), plan, epochs=9, patience=3, plateau={"patience": 1, "factor": 0.5, "min_lr": 0.0})
    got = history.orderBy("epoch").collect()
    assert len(got) == 4  # one improving epoch, then three without
    assert got[-1]["learning_rate"] < got[0]["learning_rate"]


def test_search_space_rules():
    found = ae.suggest({"k": {"low": 10, "high": 12}, "lr": {"low": 1e-4, "high": 1e-2, "log": True}, "bn": {"choices": [True]}}, 40)
    assert {f["k"] for f in found} == {10, 11, 12} and all(1e-4 <= f["lr"] <= 1e-2 for f in found)
    assert found == ae.suggest({"k": {"low": 10, "high": 12}, "lr": {"low": 1e-4, "high": 1e-2, "log": True}, "bn": {"choices": [True]}}, 40)
    with pytest.raises(ValueError):
        ae.suggest({"x": {"low": 0.0, "high": 1.0, "log": True}}, 1)
    with pytest.raises(ValueError):
        ae.suggest({"x": {"low": 1}}, 1)
    with pytest.raises(ValueError):
        dense.complete({"reconstruction_error": "huber"}, 3)
    with pytest.raises(ValueError):
        dense.complete({"optimizer": "lbfgs"}, 3)


def test_blocks_of_pairs_are_not_merged_into_one_task(spark):
    """Blocks are dealt to tasks of their own, however few bytes they have; distances by tiles are exact."""
    rng = np.random.default_rng(3)
    points = rng.normal(size=(700, 5)).astype("float32")
    rows = [(1 + i % 2, i, [float(x) for x in p]) for i, p in enumerate(points)]
    table = spark.createDataFrame(rows, "device_id int, id long, features array<float>")
    near = neighbors.knn_join(table, table, 4, metric="manhattan", exclude_self=True)
    assert near.rdd.getNumPartitions() >= neighbors.BLOCKS_A_CORE * spark.sparkContext.defaultParallelism
    found = {r["id"]: [n["id"] for n in r["neighbors"]] for r in near.collect()}
    far = np.abs(points[:, None].astype("float64") - points[None].astype("float64")).sum(axis=2)
    np.testing.assert_allclose(neighbors.distance_matrix(points.astype("float64"), points.astype("float64"), "manhattan"), far, rtol=1e-12)
    far[np.arange(700) % 2 != (np.arange(700) % 2)[:, None]] = np.inf
    np.fill_diagonal(far, np.inf)
    assert found == {i: list(np.lexsort((np.arange(700), far[i]))[:4]) for i in range(700)}


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_fast_distances_lose_no_neighbour_at_any_scale(spark, metric):
    """Far from the origin, tiny, huge and not finite: the slack of single precision covers its rounding."""
    import pyarrow as pa

    rng = np.random.default_rng(8)
    plain = rng.normal(size=(400, 9)).astype("float32")
    odd = plain.copy()
    odd[7], odd[9] = np.inf, np.nan
    for points in (plain, plain + np.float32(5000), plain * np.float32(1e-30), plain * np.float32(1e30), odd):
        lists = pa.array(points.tolist(), pa.list_(pa.float32()))
        number = pa.array(np.arange(400))
        train = pa.table([number, lists], ["id", "features"])
        asked = pa.table([pa.array([1] * 400, pa.int32()), number, number, lists, pa.array(np.full(400, np.inf))], ["device_id", "rid", "id", "features", "bound"])
        found = neighbors._nearest(6, metric)(asked, train).to_pylist()
        wide = points.astype("float64")
        for i in range(0, 400, 21) if points is not odd else range(20, 400, 21):
            far = neighbors.pair_distances(np.repeat(wide[i][None], 400, 0), wide, metric)
            assert [n["id"] for n in found[i]["nn"]] == list(np.lexsort((np.arange(400), far))[:6])
    # Points of single precision are taken as they are, whatever their distance from the origin.
    values, rated, slack = neighbors._rough(wide[20:], wide[20:], metric)(slice(0, 5))
    assert values.dtype == np.float32 and values.shape == (5, 380) and (slack(values[:, 0]) < 1e-3).all() and rated(3.0) in (3.0, 9.0)


def test_a_sweep_takes_one_join_per_metric_and_a_refit_none(spark, monkeypatch):
    rng = np.random.default_rng(5)
    train, val = (_points(spark, {d: rng.normal(size=(n, 3)) for d in (1, 2)}) for n in (60, 20))
    val = val.withColumn("id", F.col("id") + 1000)
    candidates = [{"number": i, "n_neighbors": k, "metric": m} for i, (k, m) in enumerate([(4, "euclidean"), (9, "manhattan"), (90, "euclidean")])]
    made, join, lists = [], lof.knn_join, {}
    monkeypatch.setattr(lof, "knn_join", lambda *a, **o: made.append(o["metric"]) or join(*a, **o))
    trials, best = lof.lof_sweep(train, val, candidates, lists=lists)
    refitted = lof.lof_refit(train, best, lists)
    assert made == ["euclidean", "manhattan"]
    assert sorted(map(str, refitted.drop("features").collect())) == sorted(map(str, lof.lof_refit(train, best).drop("features").collect()))
    monkeypatch.undo()
    for r in trials.collect():
        own, asked = (t.where(F.col("device_id") == r["device_id"]) for t in (train, val))
        scores = lof.lof_score(asked, lof.lof_fit(own, r["n_neighbors"], r["metric"]), r["n_neighbors"], r["metric"])
        assert r["value"] == pytest.approx(np.quantile([s["score"] for s in scores.collect()], 0.99), abs=1e-8)
