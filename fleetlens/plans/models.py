"""Named queries over detectors: neighbours, density, projection, autoencoders, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetlens.functions import dense
from fleetlens.operators import autoencoder as ae, detection, evaluation, lof, neighbors, sampling, scaling, thresholds as th
from fleetlens.plans import bindings as b
from fleetlens.plans.tables import stable, unsigned_zero
from fleetlens.session import scratch_path, spread, staged
from fleetlens.streaming.scoring import stream_score as start_stream

K, KNN_K = 10, 15
DEVICES = [1, 2, 3]
# The named configurations of the screening grid and the search space of the autoencoders.
_BASE = {"hidden_dims": [86, 57, 38], "latent_dim": 28}
_COMPACT = {"hidden_dims": [64, 32], "latent_dim": 16}
_REGULARIZED = {**_COMPACT, "activation": "leaky_relu", "dropout_rate": 0.1, "batch_norm": True, "l2_reg": 1e-4}
SCREENING = {
    "base_mse": {**_BASE, "loss": "mse"},
    "base_mae": {**_BASE, "loss": "mae"},
    "compact_mse": {**_COMPACT, "loss": "mse"},
    "regularized_mse": {**_REGULARIZED, "loss": "mse"},
    "regularized_mae": {**_REGULARIZED, "loss": "mae"},
}
AE_SPACE = {
    "latent_dim": {"choices": [8, 12, 16, 24, 32]},
    "learning_rate": {"low": 0.0001, "high": 0.005, "log": True},
    "dropout_rate": {"low": 0.0, "high": 0.2},
    "l2_reg": {"low": 0.0, "high": 0.0001},
    "batch_norm": {"choices": [False, True]},
}
# Fewer epochs than a full job has, over tables that are small; README has the figures of one with 100.
TRAINING = {"epochs": 8, "batch_size": 64, "patience": 5}
# The search space of the density detector, ten seeded candidates.
LOF_SPACE = {"n_neighbors": {"low": 10, "high": 200}, "metric": {"choices": ["euclidean", "manhattan"]}}
LOF_CANDIDATES = ae.suggest(LOF_SPACE, 10)
# The small net with given weights (64 - 6 - 3 - 6 - 64).
FIXED_SPEC = dense.complete({"hidden_dims": [6], "latent_dim": 3}, 64)
# Exact full-batch training that SQL can repeat.
EXACT = {"hidden_dims": [6], "latent_dim": 3, "optimizer": "sgd", "learning_rate": 0.05}
EXACT_EPOCHS = 3


def fixed_weights() -> list[dict]:
    """Layers of the given net: small rational weights from a rule."""
    widths, layers = dense.sizes(FIXED_SPEC), []
    for no, (a, c) in enumerate(zip(widths, widths[1:])):
        w = [[((i * 7 + j * 3 + no) % 11 - 5) / 16 for j in range(c)] for i in range(a)]
        layers.append({"w": w, "b": [((j + no) % 5 - 1) / 8 for j in range(c)]})
    return layers


def _fixed_models(spark: SparkSession) -> DataFrame:
    import numpy as np

    flat = np.concatenate([np.concatenate([np.ravel(p["w"]), p["b"]]) for p in fixed_weights()])
    return ae.model_table(spark, [(ae.FLEET, "fixed", FIXED_SPEC, flat)])


def _points(spark, sf_dir) -> DataFrame:
    """device_id, id, features, is_attack, split of the embedding vectors."""
    rows = spread(b.vectors(spark, sf_dir), "vec_id").withColumnRenamed("vec_id", "id")
    split = sampling.split_benign(rows.withColumn("key", F.col("id").cast("string")), "key").drop("key")
    return staged(split, "points")


def _part(points: DataFrame, condition: str) -> DataFrame:
    return points.where(condition).select("device_id", "id", "features")


def knn_join(spark, sf_dir):
    points = _points(spark, sf_dir)
    near = neighbors.knn_join(_part(points, "true"), _part(points, "true"), KNN_K, exclude_self=True)
    rows = near.select("device_id", "id", F.posexplode("neighbors").alias("pos", "nb"))
    return stable(rows.select("device_id", "id", "pos", F.col("nb.id").alias("neighbor"), F.col("nb.dist").alias("dist")))


def knn_join_manhattan(spark, sf_dir):
    points = _points(spark, sf_dir)
    near = neighbors.knn_join(
        _part(points, "split <> 'train'"), _part(points, "split = 'train'"), KNN_K, metric="manhattan"
    )
    rows = near.select("device_id", "id", F.posexplode("neighbors").alias("pos", "nb"))
    return stable(rows.select("device_id", "id", "pos", F.col("nb.id").alias("neighbor"), F.col("nb.dist").alias("dist")))


def lof_fit(spark, sf_dir):
    model = lof.lof_fit(_part(_points(spark, sf_dir), "split = 'train'"), K)
    return stable(model.select("device_id", "id", "kdist", "lrd"))


def lof_score(spark, sf_dir):
    points = _points(spark, sf_dir)
    path = scratch_path(spark, "lof-model")
    lof.save_model(lof.lof_fit(_part(points, "split = 'train'"), K), path)
    return stable(lof.lof_score(_part(points, "true"), lof.load_model(spark, path), K))


def lof_sweep(spark, sf_dir):
    points = _points(spark, sf_dir)
    trials, _ = lof.lof_sweep(_part(points, "split = 'train'"), _part(points, "split = 'val'"), LOF_CANDIDATES)
    return stable(trials.select("device_id", "number", "n_neighbors", "metric", "value"))


def lof_best_trial(spark, sf_dir):
    points = _points(spark, sf_dir)
    _, best = lof.lof_sweep(_part(points, "split = 'train'"), _part(points, "split = 'val'"), LOF_CANDIDATES)
    return stable(best)


def lof_refit_scores(spark, sf_dir):
    """Train and validation scores by the refitted best trials, after storing and loading the models."""
    points = _points(spark, sf_dir)
    train, path = _part(points, "split = 'train'"), scratch_path(spark, "lof-refit")
    lists: dict[str, DataFrame] = {}
    _, best = lof.lof_sweep(train, _part(points, "split = 'val'"), LOF_CANDIDATES, lists=lists)
    lof.save_model(lof.lof_refit(train, staged(best, "best-trials"), lists), path)
    benign = points.where("split in ('train', 'val')")
    scores = lof.lof_rescore(benign.select("device_id", "id", "features"), lof.load_model(spark, path))
    return stable(scores.join(benign.select("device_id", "id", "split"), ["device_id", "id"]))


def _scaled_points(spark, sf_dir) -> DataFrame:
    """Labelled points, scaled per device by the train split."""
    names = [f"f{i}" for i in range(64)]
    labels = b.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    points = _points(spark, sf_dir).join(labels, "id")
    wide = points.select("*", *[F.col("features")[i].alias(n) for i, n in enumerate(names)]).drop("features")
    scaled, _ = scaling.scale_splits(wide, names)
    family = F.when(F.col("label") < 7, "benign").when(F.col("label") == 8, "gafgyt").otherwise("mirai")
    kind = F.when(F.col("label") < 7, "benign").otherwise(F.concat(F.lit("type_"), F.col("label").cast("string")))
    return staged(
        scaled.select("device_id", "id", "split", "is_attack", family.alias("attack_family"), kind.alias("attack_type"), F.array(*names).alias("features")),
        "scaled-points",
    )


def _judged(spark, path: str) -> DataFrame:
    """Stored predictions next to what the record says of their device."""
    predictions, records = detection.read_run(spark, path)
    scores = F.round(F.col("score").cast("double"), 4).alias("score")
    rows = predictions.select("device_id", scores, "y_true", "y_pred", "attack_family", "attack_type", "is_attack")
    return rows.join(records.select("device_id", F.round("threshold", 4).alias("threshold"), "n_train", "n_test_benign", "n_test_attack", "n_scored"), "device_id")


def lof_detect(spark, sf_dir):
    """A density detection run over scaled splits, read back from what it stored."""
    path = detection.detect_lof(_scaled_points(spark, sf_dir), scratch_path(spark, "lof-run"), LOF_CANDIDATES)
    return _judged(spark, path)


def _exact_start(devices: list[int]) -> dict:
    import numpy as np

    flat = np.concatenate([np.concatenate([np.ravel(p["w"]), p["b"]]) for p in fixed_weights()])
    return {(d, "model"): flat for d in devices}


def ae_detect(spark, sf_dir):
    """A detection run with autoencoders trained per device, read back from what it stored."""
    path = detection.detect_autoencoder(
        _scaled_points(spark, sf_dir), scratch_path(spark, "ae-run"), EXACT,
        exact=True, epochs=EXACT_EPOCHS, start=_exact_start(DEVICES), restore_best=False, patience=None,
    )
    return _judged(spark, path)


def _exact_training(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    table = ae.training_table(_scaled_points(spark, sf_dir))
    plan = [(d, "model", EXACT) for d in DEVICES]
    return ae.train(table, plan, exact=True, epochs=EXACT_EPOCHS, start=_exact_start(DEVICES), restore_best=False, patience=None)


def ae_train_step(spark, sf_dir):
    """Parameters after full-batch steps: the gradient is a sum over the rows of all tasks."""
    models, _ = _exact_training(spark, sf_dir)
    values = models.select("device_id", F.posexplode("params").alias("pos", "value"))
    return values.select("device_id", "pos", unsigned_zero(F.round("value", 7)).alias("value"))


def _wide_vectors(spark, sf_dir) -> tuple[DataFrame, list[str]]:
    names = [f"f{i}" for i in range(64)]
    rows = b.vectors(spark, sf_dir).select("vec_id", "is_attack", *[F.col("features")[i].alias(n) for i, n in enumerate(names)])
    return rows, names


def pca_2d(spark, sf_dir):
    rows, names = _wide_vectors(spark, sf_dir)
    projected, _ = scaling.principal_components(rows, names, ["vec_id", "is_attack"])
    return projected.select("vec_id", "is_attack", F.round("pc1", 6).alias("pc1"), F.round("pc2", 6).alias("pc2"))


def pca_variance(spark, sf_dir):
    rows, names = _wide_vectors(spark, sf_dir)
    _, explained = scaling.principal_components(rows, names, ["vec_id"])
    return stable(explained)


def pca_total_variance(spark, sf_dir):
    """Trace identity behind the explained shares."""
    rows, names = _wide_vectors(spark, sf_dir)
    return scaling.standardised_total_variance(rows, names).select(F.round("total_variance", 4).alias("total_variance"))


def _vectors(spark, sf_dir) -> DataFrame:
    return spread(b.vectors(spark, sf_dir), "vec_id").select("device_id", "vec_id", "features")


def ae_reconstruct(spark, sf_dir):
    """One row per vector and output."""
    out = ae.ae_reconstruct(_vectors(spark, sf_dir), _fixed_models(spark)).select("vec_id", F.posexplode("reconstruction").alias("pos", "x"))
    return out.select("vec_id", "pos", unsigned_zero(F.round(F.col("x").cast("double"), 4)).alias("value"))


def ae_encode(spark, sf_dir):
    out = ae.ae_encode(_vectors(spark, sf_dir), _fixed_models(spark)).select("vec_id", F.posexplode("latent").alias("pos", "x"))
    return out.select("vec_id", "pos", F.round(F.col("x").cast("double"), 4).alias("value"))


def _fixed_score(error: str):
    def query(spark, sf_dir):
        out = ae.ae_score(_vectors(spark, sf_dir), _fixed_models(spark), error)
        return out.select("vec_id", F.round(F.col("score").cast("double"), 4).alias("score"))

    return query


ae_score_mse, ae_score_mae, ae_score_rmse = _fixed_score("mse"), _fixed_score("mae"), _fixed_score("rmse")


def _trained(spark, sf_dir, devices, configs, fleet=False):
    points = _points(spark, sf_dir)
    table = ae.training_table(points, fleet=fleet)
    plan = [(d, c, cfg) for d in devices for c, cfg in configs.items()]
    plateau = {"factor": 0.5, "patience": 1} if fleet else None
    return points, *ae.train(table, plan, plateau=plateau, **TRAINING)


def ae_train_device(spark, sf_dir):
    _, models, _ = _trained(spark, sf_dir, DEVICES, {"compact_mse": SCREENING["compact_mse"]})
    return models.select("device_id", "config_id", F.size("params").alias("n_params"), "best_epoch", "best_val_loss", "epochs_trained")


def ae_train_global(spark, sf_dir):
    _, models, _ = _trained(spark, sf_dir, [ae.FLEET], {"base_mse": SCREENING["base_mse"]}, fleet=True)
    return models.select("device_id", "config_id", F.size("params").alias("n_params"), "best_epoch", "best_val_loss", "epochs_trained")


def ae_history(spark, sf_dir):
    """Losses of exact training by device and epoch."""
    _, history = _exact_training(spark, sf_dir)
    return history.select("device_id", "config_id", "epoch", F.round("loss", 7).alias("loss"), F.round("val_loss", 7).alias("val_loss"), "learning_rate")


def ae_screening(spark, sf_dir):
    summary, _, _ = ae.screening(_points(spark, sf_dir), SCREENING, DEVICES, **TRAINING)
    return summary


def ae_sweep(spark, sf_dir):
    trials, _, _ = ae.sweep(
        _points(spark, sf_dir), {"hidden_dims": [64, 32]}, ae.suggest(AE_SPACE, 10), DEVICES, **TRAINING
    )
    return trials


def score_predictions(spark, sf_dir):
    """Batch scoring of the test splits: model of the device, benign p99 threshold, prediction table."""
    points = _points(spark, sf_dir)
    scored = staged(
        ae.ae_score(points.select("device_id", "id", "features", "split", "is_attack"), _fixed_models(spark)), "ae-scored"
    )
    limits = th.threshold_criteria(scored.where("split = 'val'"), ["device_id"]).where("criterion = 'p99'")
    tested = scored.where("split like 'test_%'").withColumn("y_true", F.col("is_attack").cast("byte"))
    out = th.apply_thresholds(tested, limits.select("device_id", "threshold"))
    return out.select("id", "device_id", F.round(F.col("score").cast("double"), 4).alias("score"), "y_true", "y_pred")


def stream_score(spark, sf_dir):
    """Events scored as a stream of files; equal to the batch result on the same files."""
    events = b.table(spark, sf_dir, "events")
    source, sink = scratch_path(spark, "arriving"), scratch_path(spark, "scored")
    spread(events, "event_id").write.parquet(source)
    limits = b.thresholds(spark, {d: 40.0 + d for d in range(1, 10)})

    def score(df: DataFrame) -> DataFrame:
        rows = df.select(
            "event_id",
            (F.col("user_id") % 9 + 1).cast("int").alias("device_id"),
            F.col("value").cast("float").alias("score"),
            (F.col("event_type") == "error").cast("byte").alias("y_true"),
        )
        return th.apply_thresholds(rows, limits).select("event_id", "device_id", "score", "y_true", "y_pred")

    start_stream(spark, source, events.schema, score, sink, max_files=4).awaitTermination()
    return spark.read.parquet(sink)


def alert_metrics(spark, sf_dir):
    """Device metrics of the second prediction table."""
    rows = th.apply_thresholds(b.alerts(spark, sf_dir), b.thresholds(spark, {d: 40.0 + d for d in range(1, 10)}))
    return evaluation.device_metrics(rows)


QUERIES = {
    f.__name__: f
    for f in (
        knn_join, knn_join_manhattan, lof_fit, lof_score, lof_sweep, lof_best_trial, lof_refit_scores, lof_detect, ae_detect, ae_train_step, pca_2d, pca_variance, pca_total_variance,
        ae_reconstruct, ae_encode, ae_train_device, ae_train_global, ae_history, ae_screening, ae_sweep, score_predictions,
        stream_score, alert_metrics,
    )
} | {"ae_score_mse": ae_score_mse, "ae_score_mae": ae_score_mae, "ae_score_rmse": ae_score_rmse}
