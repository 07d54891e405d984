"""Standard scaling per device or over the fleet, and a two-component projection."""

from __future__ import annotations

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from fleetlens.operators.joins import lookup_join, required


def fit_scaler(train: DataFrame, columns: list[str], by: str | None = "device_id") -> DataFrame:
    """Wide parameter table: mean and population deviation per feature.

    A zero deviation becomes 1. ``by=None`` fits one scaler for the fleet.
    """
    stats = [
        x
        for c in columns
        for x in (
            F.avg(F.col(c).cast("double")).alias(f"mean_{c}"),
            F.stddev_pop(F.col(c).cast("double")).alias(f"scale_{c}"),
        )
    ]
    fitted = (train.groupBy(by) if by else train).agg(*stats)
    safe = [F.when(F.col(f"scale_{c}") == 0, 1.0).otherwise(F.col(f"scale_{c}")).alias(f"scale_{c}") for c in columns]
    return fitted.select(*([by] if by else []), *[x for c, s in zip(columns, safe) for x in (F.col(f"mean_{c}"), s)])


def scaler_long(scaler: DataFrame, columns: list[str], by: str | None = "device_id") -> DataFrame:
    """The same parameters as rows (by, pos, feature, mean, scale)."""
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("pos"),
                F.lit(c).alias("feature"),
                F.col(f"mean_{c}").alias("mean"),
                F.col(f"scale_{c}").alias("scale"),
            )
            for i, c in enumerate(columns)
        ]
    )
    return scaler.select(*([by] if by else []), F.inline(rows))


def apply_scaler(df: DataFrame, scaler: DataFrame, columns: list[str], by: str | None = "device_id") -> DataFrame:
    """(x - mean) / scale as float32 in place; other columns pass through."""
    if by:
        joined = lookup_join(df, scaler.withColumn("_known", F.lit(True)), [by], "left")
        joined = joined.where(required("_known", "scaler", by))
        mean, scale = (lambda c: F.col(f"mean_{c}")), (lambda c: F.col(f"scale_{c}"))
    else:
        row, joined = scaler.first(), df
        mean, scale = (lambda c: F.lit(row[f"mean_{c}"])), (lambda c: F.lit(row[f"scale_{c}"]))
    scaled = {c: ((F.col(c).cast("double") - mean(c)) / scale(c)).cast("float").alias(c) for c in columns}
    return joined.select(*[scaled.get(c, F.col(c)) for c in df.columns])


def scale_splits(splits: DataFrame, columns: list[str], by: str | None = "device_id") -> tuple[DataFrame, DataFrame]:
    """Fit on the train split, apply to all four; returns (scaled, parameters)."""
    scaler = fit_scaler(splits.where("split = 'train'"), columns, by)
    return apply_scaler(splits, scaler, columns, by), scaler


def principal_components(df: DataFrame, columns: list[str], keep: list[str], k: int = 2) -> tuple[DataFrame, DataFrame]:
    """Project standardised features on k components.

    Returns the projected rows (keep, pc1..pck) and the explained shares. Each
    component is oriented so that its largest loading is positive.
    """
    scaled = apply_scaler(df, fit_scaler(df, columns, None), columns, None)
    vectors = VectorAssembler(inputCols=columns, outputCol="v").transform(scaled)
    model = PCA(k=k, inputCol="v", outputCol="p").fit(vectors)
    loadings = model.pc.toArray()
    signs = [1.0 if max(loadings[:, j], key=abs) > 0 else -1.0 for j in range(k)]
    projected = model.transform(vectors).withColumn("p", vector_to_array("p"))
    rows = projected.select(*keep, *[(F.col("p")[j] * F.lit(signs[j])).alias(f"pc{j + 1}") for j in range(k)])
    shares = [(f"PC{j + 1}", float(model.explainedVariance[j]), float(model.explainedVariance[j]) * 100) for j in range(k)]
    explained = df.sparkSession.createDataFrame(shares, "component string, ratio double, percent double")
    return rows, explained


def standardised_total_variance(df: DataFrame, columns: list[str]) -> DataFrame:
    """Total sample variance of the standardised features (trace of the covariance)."""
    scaled = apply_scaler(df, fit_scaler(df, columns, None), columns, None)
    total = sum((F.var_samp(F.col(c).cast("double")) for c in columns[1:]), F.var_samp(F.col(columns[0]).cast("double")))
    return scaled.agg(total.alias("total_variance"))
