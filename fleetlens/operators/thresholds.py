"""Thresholds from benign scores and their use in scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.functions.expressions import ratio
from fleetlens.operators.joins import lookup_join, required, with_scalars
from fleetlens.operators.ordering import cumulative, quantiles

# The quantiles of the score summaries and of the criteria.
SUMMARY_PROBS = {"p50": 0.5, "p95": 0.95, "p99": 0.99, "p99_5": 0.995}
CRITERIA_PROBS = {"p99": 0.99, "p99_5": 0.995, "p99_9": 0.999}


def predict(score: Column, threshold: Column) -> Column:
    """1 where the float32 score is strictly above the threshold taken as float32."""
    return (score.cast("float") > threshold.cast("float")).cast("byte")


def with_threshold(scored: DataFrame, thresholds: DataFrame, by: str = "device_id") -> DataFrame:
    """Adds the device's threshold; a missing or null one is an error."""
    found = lookup_join(scored, thresholds.select(by, "threshold"), [by], "left")
    return found.withColumn("threshold", required("threshold", "threshold", by))


def apply_thresholds(scored: DataFrame, thresholds: DataFrame, by: str = "device_id") -> DataFrame:
    """(Re)predicts every row with the threshold of its device."""
    return with_threshold(scored, thresholds, by).withColumn("y_pred", predict(F.col("score"), F.col("threshold")))


def score_group() -> Column:
    """benign / gafgyt tcp+udp / other attacks."""
    return (
        F.when(F.col("y_true") == 0, "benign")
        .when((F.col("attack_family") == "gafgyt") & F.col("attack_type").isin("tcp", "udp"), "gafgyt tcp/udp")
        .otherwise("other attacks")
    )


def _joined(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Per-group results side by side (both sides have one row per group)."""
    return left.join(right, by) if by else with_scalars(left, right)


def score_summary(scores: DataFrame, by: list[str], value: str = "score") -> DataFrame:
    """mean, population deviation, min, exact quantiles and max per group."""
    v = F.col(value).cast("double")
    moments = scores.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    )
    return _joined(moments, quantiles(scores, by, value, SUMMARY_PROBS), by)


def boxplot_stats(scores: DataFrame, by: list[str], value: str = "score") -> DataFrame:
    """Quartiles, 1.5 IQR whiskers (extreme values inside the fences) and flier count."""
    box = quantiles(scores, by, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}).select(
        "*",
        (F.col("q1") - (F.col("q3") - F.col("q1")) * 1.5).alias("low_fence"),
        (F.col("q3") + (F.col("q3") - F.col("q1")) * 1.5).alias("high_fence"),
    )
    v = F.col(value).cast("double")
    inside = (v >= F.col("low_fence")) & (v <= F.col("high_fence"))
    fences = lookup_join(scores, box.select(*by, "low_fence", "high_fence"), by)
    ends = fences.groupBy(*by).agg(
        F.min(F.when(inside, v)).alias("whisker_low"),
        F.max(F.when(inside, v)).alias("whisker_high"),
        F.count_if(~inside).alias("n_fliers"),
    )
    return box.drop("low_fence", "high_fence").join(ends, by)


def ks_statistic(scores: DataFrame, by: list[str], value: str = "score") -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic of train against val scores."""
    is_train, is_val = (F.col("split") == "train").cast("long"), (F.col("split") == "val").cast("long")
    both = scores.where("split in ('train', 'val')")
    curve = cumulative(both, by, value, {"train": is_train, "val": is_val})
    sizes = both.groupBy(*by).agg(F.sum(is_train).alias("n_train"), F.sum(is_val).alias("n_val"))
    gaps = lookup_join(curve, sizes, by) if by else with_scalars(curve, sizes)
    gap = F.abs(ratio(F.col("cum_train"), F.col("n_train")) - ratio(F.col("cum_val"), F.col("n_val")))
    return gaps.groupBy(*by).agg(F.max(gap).alias("ks_statistic"))


def ks_report(scores: DataFrame, by: list[str], value: str = "score") -> DataFrame:
    """KS statistic with mean, median, population deviation and max of both splits."""
    v = F.col(value).cast("double")
    both = scores.where("split in ('train', 'val')")
    parts = [(s, F.when(F.col("split") == s, v)) for s in ("train", "val")]
    moments = both.groupBy(*by).agg(
        *[f(c).alias(f"{s}_{n}") for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("max", F.max)) for s, c in parts]
    )
    medians = quantiles(both, [*by, "split"], value, {"median": 0.5})
    wide = medians.groupBy(*by).agg(
        *[F.max(F.when(F.col("split") == s, F.col("median"))).alias(f"{s}_median") for s in ("train", "val")]
    )
    return _joined(_joined(ks_statistic(scores, by, value), moments, by), wide, by)


def threshold_criteria(val_scores: DataFrame, by: list[str], value: str = "score", kind: str = "density") -> DataFrame:
    """(by, criterion, threshold) from validation scores of benign rows.

    ``density``: high quantiles and the two IQR fences. ``reconstruction``:
    quantiles and mean + 3 population deviations. ``fleet``: the same with the
    sample deviation.
    """
    v = F.col(value).cast("double")
    probs = dict(CRITERIA_PROBS)
    if kind == "density":
        table = quantiles(val_scores, by, value, {**probs, "q1": 0.25, "q3": 0.75})
        iqr = F.col("q3") - F.col("q1")
        extra = {"iqr_1_5": F.col("q3") + iqr * 1.5, "iqr_3": F.col("q3") + iqr * 3.0}
    else:
        spread = F.stddev_samp(v) if kind == "fleet" else F.stddev_pop(v)
        moments = val_scores.groupBy(*by).agg((F.avg(v) + spread * 3.0).alias("mean_3std"))
        table = _joined(quantiles(val_scores, by, value, probs), moments, by)
        extra = {"mean_3std": F.col("mean_3std")}
    rows = {**{p: F.col(p) for p in probs}, **extra}
    return table.select(
        *by, F.inline(F.array(*[F.struct(F.lit(k).alias("criterion"), c.alias("threshold")) for k, c in rows.items()]))
    )


def threshold_fpr(val_scores: DataFrame, criteria: DataFrame, by: list[str], value: str = "score") -> DataFrame:
    """Adds to each criterion the share of benign validation scores above it.

    The thresholds join the cumulative counts as rows of weight zero, so any
    number of criteria takes one pass and no score row is multiplied.
    """
    one = lambda n: F.lit(n).cast("long")
    scores = val_scores.select(*by, F.col(value).cast("double").alias("score"), one(1).alias("n"), one(0).alias("mark"))
    points = criteria.select(*by, F.col("threshold").cast("double").alias("score"), one(0).alias("n"), one(1).alias("mark"))
    curve = cumulative(scores.unionByName(points), by, "score", {m: F.col(m) for m in ("n", "mark")})
    below = curve.where("mark > 0").select(*by, F.col("score").alias("threshold"), "cum_n")
    totals = scores.groupBy(*by).agg(F.sum("n").alias("total"))
    known = _joined(below, totals, by).select(*by, "threshold", ratio(F.col("total") - F.col("cum_n"), F.col("total"), None).alias("fpr"))
    table = criteria.select(*by, "criterion", F.col("threshold").cast("double").alias("threshold"))
    return table.join(known, [*by, "threshold"], "left").select(*by, "criterion", "threshold", "fpr").withColumn(
        "fpr_percent", F.col("fpr") * 100
    )


def criteria_pivot(table: DataFrame, criteria: list[str], value: str, by: str = "device_id") -> DataFrame:
    return table.groupBy(by).pivot("criterion", criteria).agg(F.first(value))
