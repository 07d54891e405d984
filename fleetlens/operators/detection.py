"""Detection runs from scaled splits to stored predictions and run records.

A run fits its models, stores them, reads them back, scores the benign splits,
chooses a limit per device from validation scores, scores the test splits and
writes predictions with their declared types. Rows and seconds of the record
are observed by the job that writes. Everything a run leaves lies below one
folder: ``model``, ``scores`` (by split and device), ``limits``,
``predictions`` and ``record`` (one JSON document per device).
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, functions as F

from fleetlens.operators import autoencoder as ae, lof
from fleetlens.operators.joins import with_scalars
from fleetlens.operators.thresholds import apply_thresholds, threshold_criteria
from fleetlens.session import staged
from fleetlens.sources import traffic as src

RECORD = (
    "device_id int, threshold double, n_train long, n_test_benign long, n_test_attack long, model_size_mb double, "
    "n_scored long, seconds double, rows_per_second double"
)
LABELS = ["attack_family", "attack_type", "is_attack"]


def _finish(points: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, criterion: str, fleet: bool) -> str:
    """Scores, limits, predictions and records of a run whose models are stored; returns the folder."""
    spark, by = points.sparkSession, ["device_id"]
    benign = points.where("split in ('train', 'val')")
    # Keys travel with the rows through the scores.
    scored = staged(score(benign).join(benign.select("device_id", "id", "split"), [*by, "id"]), "benign-scores")
    src.write_scores(scored, f"{path}/scores", partition_by=["split", "device_id"])
    owner = F.lit(ae.FLEET).cast("int") if fleet else F.col("device_id")
    val = scored.where("split = 'val'").select(owner.alias("device_id"), "score")
    limits = threshold_criteria(val, by, kind="fleet" if fleet else "density").where(F.col("criterion") == criterion)
    limits.select(*by, "threshold").write.mode("overwrite").parquet(f"{path}/limits")
    stored = spark.read.parquet(f"{path}/limits")
    if fleet:
        stored = with_scalars(points.select(*by).distinct(), stored.select("threshold"))
    test = points.where("split like 'test_%'")
    labelled = score(test).join(test.select("device_id", "id", *LABELS), [*by, "id"])
    judged = apply_thresholds(labelled.withColumn("y_true", F.col("is_attack").cast("byte")), stored)
    seen, start = Observation(), time.perf_counter()
    src.write_predictions(judged.observe(seen, F.count(F.lit(1)).alias("n")), f"{path}/predictions")
    seconds, n_scored = time.perf_counter() - start, seen.get["n"]
    counts = points.groupBy(*by).agg(*[F.count_if(F.col("split") == s).alias(f"n_{s}") for s in ("train", "test_benign", "test_attack")])
    size = src.artifact_sizes(spark, f"{path}/model").first()["size_mb"]
    record = counts.join(stored, by, "left").select(
        *by, "threshold", "n_train", "n_test_benign", "n_test_attack", F.lit(size).alias("model_size_mb"), F.lit(n_scored).alias("n_scored"),
        F.lit(seconds).alias("seconds"), F.try_divide(F.lit(float(n_scored)), F.lit(seconds)).alias("rows_per_second"),
    )
    record.write.mode("overwrite").partitionBy("device_id").json(f"{path}/record")
    return path


def detect_lof(points: DataFrame, path: str, candidates: list[dict], *, quantile: float = 0.99, criterion: str = "p99") -> str:
    """Search, refit, store, load, score and judge with density models; returns the folder of the run.

    ``points`` has device_id, id, features (scaled), split and the labels. Train rows are the reference points, the
    search is judged on val rows, and each device gets the k and metric of its best trial.
    """
    spark = points.sparkSession
    part = lambda split: points.where(F.col("split") == split).select("device_id", "id", "features")
    lists: dict[str, DataFrame] = {}
    trials, best = lof.lof_sweep(part("train"), part("val"), candidates, quantile=quantile, lists=lists)
    trials.write.mode("overwrite").parquet(f"{path}/trials")
    lof.save_model(lof.lof_refit(part("train"), staged(best, "best-trials"), lists), f"{path}/model")
    model = lof.load_model(spark, f"{path}/model")
    return _finish(points, lambda rows: lof.lof_rescore(rows.select("device_id", "id", "features"), model), path, criterion, fleet=False)


def detect_autoencoder(points: DataFrame, path: str, config: dict, *, fleet: bool = False, criterion: str = "p99", **training) -> str:
    """Train, store, load, score and judge with autoencoders, one per device or one for the fleet; returns the folder."""
    spark = points.sparkSession
    devices = [ae.FLEET] if fleet else [r[0] for r in points.where("split = 'train'").select("device_id").distinct().collect()]
    models, history = ae.train(ae.training_table(points, fleet=fleet), [(d, "model", config) for d in sorted(devices)], **training)
    ae.save_models(models, f"{path}/model")
    history.write.mode("overwrite").parquet(f"{path}/history")
    loaded = ae.load_models(spark, f"{path}/model")
    score = lambda rows: ae.ae_score(rows.select("device_id", "id", "features"), loaded).drop("config_id")
    return _finish(points, score, path, criterion, fleet)


def read_run(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """(predictions, records) of a stored run."""
    return src.read_predictions(spark, f"{path}/predictions"), spark.read.schema(RECORD).json(f"{path}/record")
