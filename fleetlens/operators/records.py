"""Run records: model size, throughput, training curves and trials."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, functions as F


def write_and_record(predictions: DataFrame, path: str, **tags: str) -> DataFrame:
    """Writes a scored table and returns its record: rows, seconds and rows per second.

    The row count is observed by the writing job itself.
    """
    seen = Observation()
    start = time.perf_counter()
    predictions.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
    seconds, n = time.perf_counter() - start, seen.get["n"]
    row = (*tags.values(), n, round(seconds, 6), round(n / seconds, 4) if seconds > 0 else None)
    kinds = "".join(f"`{t}` string, " for t in tags)
    return predictions.sparkSession.createDataFrame([row], f"{kinds}n_scored long, seconds double, rows_per_second double")


def size_regression(records: DataFrame) -> DataFrame:
    """Least squares of model size on training rows, with Pearson's r."""
    y, x = F.col("model_size_mb"), F.col("n_train").cast("double")
    return records.agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.corr(y, x).alias("r"),
        F.regr_r2(y, x).alias("r2"),
    )


def scalability_table(records: DataFrame) -> DataFrame:
    """Size, models, rows, seconds and rows per second by strategy; null rate at zero seconds."""
    totals = records.groupBy("strategy").agg(
        F.sum("model_size_mb").alias("model_size_mb"),
        F.count("*").alias("n_models"),
        F.sum("n_scored").alias("n_scored"),
        F.sum("seconds").alias("seconds"),
    )
    return totals.withColumn("rows_per_second", F.try_divide(F.col("n_scored").cast("double"), F.col("seconds")))


def training_curves(history: DataFrame, models: list[str]) -> DataFrame:
    """Mean and sample deviation of both losses over devices, by model and epoch."""
    return (
        history.where(F.col("model_id").isin(models))
        .groupBy("model_id", "epoch")
        .agg(
            F.avg("loss").alias("loss_mean"),
            F.stddev_samp("loss").alias("loss_std"),
            F.avg("val_loss").alias("val_loss_mean"),
            F.stddev_samp("val_loss").alias("val_loss_std"),
            F.count_distinct("device_id").alias("n_devices"),
        )
    )


def best_epoch(history: DataFrame, by: list[str]) -> DataFrame:
    """First epoch with the least validation loss; null when there is none."""
    scored = F.when(F.col("val_loss").isNotNull(), F.struct("val_loss", "epoch"))
    return history.groupBy(*by).agg(
        F.min_by("epoch", scored).alias("best_epoch"), F.min("val_loss").alias("best_val_loss")
    )


def best_trial(trials: DataFrame, by: list[str], params: list[str]) -> DataFrame:
    """Parameters of the trial with the least objective; ties go to the earliest."""
    found = F.min_by(F.struct("number", "value", *params), F.struct("value", "number"))
    return trials.groupBy(*by).agg(found.alias("b")).select(*by, "b.*")
