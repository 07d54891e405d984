"""Several detection strategies side by side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.functions.expressions import metric_columns, ratio
from fleetlens.operators.evaluation import average_precision, metric_table, pr_curve
from fleetlens.operators.sampling import prevalence_counts, prevalence_samples


def unify(tables: dict[str, DataFrame]) -> DataFrame:
    """One table from per-strategy predictions: common score name and device type, strategy tag.

    Columns missing in a table become null.
    """
    tagged = []
    for strategy, table in tables.items():
        if "reconstruction_error" in table.columns:
            table = table.withColumnRenamed("reconstruction_error", "score")
        tagged.append(
            table.withColumn("device_id", F.col("device_id").cast("int")).withColumn("strategy", F.lit(strategy))
        )
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def in_order(column: str, order: list[str]) -> Column:
    """Sort key that follows a given list of labels."""
    return F.array_position(F.array(*[F.lit(x) for x in order]), F.col(column))


def strategy_global(predictions: DataFrame, order: list[str]) -> DataFrame:
    table = metric_table(predictions, ["strategy"], ["mcc", "recall", "fpr"])
    return table.orderBy(in_order("strategy", order))


def strategy_device_mcc(predictions: DataFrame, order: list[str]) -> DataFrame:
    """Device rows by strategy columns of MCC."""
    table = metric_table(predictions, ["device_id", "strategy"], ["mcc"])
    return table.groupBy("device_id").pivot("strategy", order).agg(F.first("mcc")).orderBy("device_id")


def strategy_attack_recall(predictions: DataFrame, order: list[str]) -> DataFrame:
    """Attack rows by strategy columns of recall."""
    attacks = predictions.where("y_true = 1")
    table = metric_table(attacks, ["attack_family", "attack_type", "strategy"], ["recall"])
    label = F.concat_ws(" - ", "attack_family", "attack_type").alias("attack")
    return table.groupBy(label).pivot("strategy", order).agg(F.first("recall")).orderBy("attack")


def operational_metrics(
    predictions: DataFrame, key: str, order: list[str], prevalences: list[float], *, seed: int = 42
) -> DataFrame:
    """Precision, recall, MCC, FPR and false alarms per 100 000 benign rows.

    Each (strategy, prevalence) is judged on all benign rows and one exact
    draw of attacks; too small an attack pool is an error.
    """
    counts = prevalence_counts(predictions, key, prevalences, by=["strategy"], seed=seed, rounding="round")
    return (
        counts.select("strategy", "prevalence", *metric_columns(["precision", "recall", "mcc", "fpr"]), "fp", "tn")
        .withColumn("fp_per_100k_benign", F.round(ratio(F.col("fp"), F.col("fp") + F.col("tn")) * 100000, 6))
        .drop("fp", "tn")
        .orderBy(in_order("strategy", order), "prevalence")
    )


def sampled_strategies(predictions: DataFrame, key: str, prevalences: list[float], *, seed: int = 42) -> DataFrame:
    """The prevalence samples of all strategies, tagged with strategy and prevalence."""
    return prevalence_samples(predictions, key, prevalences, by=["strategy"], seed=seed)


def strategy_pr_curve(samples: DataFrame) -> DataFrame:
    return pr_curve(samples, ["strategy", "prevalence"])


def strategy_average_precision(samples: DataFrame) -> DataFrame:
    return average_precision(samples, ["strategy", "prevalence"])
