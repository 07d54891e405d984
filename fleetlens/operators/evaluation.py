"""Detection quality over a scored prediction table.

A prediction table has device_id, score, y_true, y_pred, attack_family and
attack_type. Every metric starts from four conditional counts that combine
map-side, so a hot device or family costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetlens.functions.expressions import confusion_cells, mcc, metric_columns, nine_metrics, ratio
from fleetlens.operators.joins import lookup_join, required, with_scalars
from fleetlens.operators.ordering import cumulative, quantile_grid, quantiles
from fleetlens.operators.sampling import prevalence_counts
from fleetlens.operators.thresholds import score_group, with_threshold

ATTACK_LABEL = "concat(attack_family, ' - ', attack_type)"


# ---- confusion and metric tables -----------------------------------------


def confusion_matrix(predictions: DataFrame) -> DataFrame:
    """All four cells with their share of the true class in percent."""
    cells = predictions.agg(*confusion_cells())
    rows = [(0, 0, "tn", "fp"), (0, 1, "fp", "tn"), (1, 0, "fn", "tp"), (1, 1, "tp", "fn")]
    return cells.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(t).alias("y_true"),
                        F.lit(p).alias("y_pred"),
                        F.col(cell).alias("n"),
                        (ratio(F.col(cell), F.col(cell) + F.col(other)) * 100).alias("row_percent"),
                    )
                    for t, p, cell, other in rows
                ]
            )
        )
    )


def metric_table(predictions: DataFrame, by: list[str] | None = None, names: list[str] | None = None) -> DataFrame:
    """The nine detection metrics, overall or per group."""
    by = by or []
    return predictions.groupBy(*by).agg(*confusion_cells()).select(*by, *metric_columns(names))


def global_metrics(predictions: DataFrame) -> DataFrame:
    """The overall metrics as rows (metric, value), to four decimals."""
    names = list(nine_metrics(*[F.col(c) for c in ("tp", "fp", "tn", "fn")]))
    table = metric_table(predictions, names=names)
    return table.unpivot([], names, "metric", "value").withColumn("value", F.bround("value", 4))


def device_metrics(predictions: DataFrame) -> DataFrame:
    """Metrics per device with the mean recall over devices alongside."""
    table = metric_table(predictions, ["device_id"])
    # One row per device is left: the window holds the aggregate, not the predictions.
    return table.withColumn("mean_recall", F.round(F.avg("recall").over(Window.partitionBy(F.lit(0))), 9))


def attack_detection(predictions: DataFrame, by: list[str]) -> DataFrame:
    """Samples, hits, misses, recall and miss rate of attack rows per group."""
    n, tp = F.count("*"), F.sum(F.col("y_pred").cast("long"))
    return (
        predictions.where("y_true = 1")
        .groupBy(*by)
        .agg(n.alias("n_samples"), tp.alias("true_positives"))
        .select(
            *by,
            "n_samples",
            "true_positives",
            (F.col("n_samples") - F.col("true_positives")).alias("false_negatives"),
            F.round(ratio(F.col("true_positives"), F.col("n_samples")), 9).alias("recall"),
            F.round(ratio(F.col("n_samples") - F.col("true_positives"), F.col("n_samples")), 9).alias("fnr"),
        )
    )


def family_metrics(predictions: DataFrame) -> DataFrame:
    return attack_detection(predictions, ["attack_family"]).orderBy(F.desc("recall"), "attack_family")


def type_metrics(predictions: DataFrame) -> DataFrame:
    table = attack_detection(predictions, ["attack_family", "attack_type"])
    return table.withColumn("attack_label", F.expr(ATTACK_LABEL)).orderBy("recall", "attack_label")


def extreme_type_metrics(predictions: DataFrame, devices: list[int]) -> DataFrame:
    """Detection by attack type on a few chosen devices."""
    chosen = predictions.where(F.col("device_id").isin(devices))
    table = attack_detection(chosen, ["device_id", "attack_family", "attack_type"])
    return table.withColumn("attack_label", F.expr(ATTACK_LABEL)).orderBy("device_id", "recall", "attack_label")


def extreme_recall_pivot(table: DataFrame, devices: list[int]) -> DataFrame:
    """Attack rows by device columns, ordered by mean recall over present devices."""
    wide = table.groupBy("attack_label").pivot("device_id", devices).agg(F.first("recall"))
    cells = [F.col(f"`{d}`") for d in devices]
    present = sum((c.isNotNull().cast("int") for c in cells[1:]), cells[0].isNotNull().cast("int"))
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cells[1:]), F.coalesce(cells[0], F.lit(0.0)))
    return wide.select(
        "attack_label",
        *[c.alias(f"device_{d}") for c, d in zip(cells, devices)],
        F.round(ratio(total, present), 9).alias("mean_recall"),
    ).orderBy(F.desc("mean_recall"), "attack_label")


# ---- threshold search ----------------------------------------------------


def _counts_above(predictions: DataFrame, points: DataFrame, by: list[str]) -> DataFrame:
    """tp/fp/tn/fn at every point, predicting 1 for scores strictly above it.

    The points join the cumulative counts as rows of weight zero, so a single
    pass serves all of them.
    """
    rows = predictions.select(*by, F.col("score").cast("double").alias("score"), F.col("y_true").cast("long").alias("pos"), (1 - F.col("y_true")).cast("long").alias("neg"), F.lit(0).cast("long").alias("mark"))
    marks = points.select(*by, F.col("threshold").alias("score"), *[F.lit(v).cast("long").alias(k) for k, v in (("pos", 0), ("neg", 0), ("mark", 1))])
    curve = cumulative(rows.unionByName(marks), by, "score", {m: F.col(m) for m in ("pos", "neg", "mark")})
    totals = rows.groupBy(*by).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    marked = curve.where("mark > 0")
    marked = lookup_join(marked, totals, by) if by else with_scalars(marked, totals)
    return marked.select(
        *by,
        F.col("score").alias("threshold"),
        (F.col("all_pos") - F.col("cum_pos")).alias("tp"),
        (F.col("all_neg") - F.col("cum_neg")).alias("fp"),
        F.col("cum_neg").alias("tn"),
        F.col("cum_pos").alias("fn"),
    )


def linspace(low: float, high: float, n: int) -> list[float]:
    step = (high - low) / (n - 1)
    return [low + i * step for i in range(n - 1)] + [high]


def mcc_threshold(
    predictions: DataFrame, by: list[str], *, n_candidates: int, min_quantile: float, max_quantile: float
) -> DataFrame:
    """The MCC-best threshold over a grid of score quantiles; ties keep the lowest."""
    probs = linspace(min_quantile, max_quantile, n_candidates)
    grid = quantile_grid(predictions, by, "score", probs)
    points = grid.select(*by, F.col("quantile").alias("threshold")).distinct()
    counts = _counts_above(predictions, points, by).withColumn(
        "mcc", mcc(F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn"))
    )
    best = F.max_by(F.struct("threshold", "mcc"), F.struct(F.round("mcc", 12).alias("m"), (-F.col("threshold")).alias("t")))
    return counts.groupBy(*by).agg(best.alias("b")).select(*by, "b.threshold", "b.mcc")


def threshold_comparison(predictions: DataFrame, current: DataFrame, optimal: DataFrame, by: str = "device_id") -> DataFrame:
    """Recall, FPR, precision and MCC per device at two threshold tables.

    Both comparisons use the score in double, as the search does.
    """
    names = ("current_threshold", "optimal_threshold")
    pair = current.select(by, F.col("threshold").alias(names[0])).join(optimal.select(by, F.col("threshold").alias(names[1])), by, "full")
    rows = lookup_join(predictions, pair, [by], "left")
    rows = rows.withColumns({n: required(n, n.replace("_", " "), by) for n in names})
    s, y = F.col("score").cast("double"), F.col("y_true")
    cells = []
    for which in ("current", "optimal"):
        over = s > F.col(f"{which}_threshold")
        cells += [
            F.count_if((y == 1) & over).alias(f"{which}_tp"),
            F.count_if((y == 0) & over).alias(f"{which}_fp"),
            F.count_if((y == 0) & ~over).alias(f"{which}_tn"),
            F.count_if((y == 1) & ~over).alias(f"{which}_fn"),
        ]
    table = rows.groupBy(by, "current_threshold", "optimal_threshold").agg(*cells)
    out = []
    for which in ("current", "optimal"):
        found = nine_metrics(*[F.col(f"{which}_{c}") for c in ("tp", "fp", "tn", "fn")])
        out += [F.round(found[m], 9).alias(f"{which}_{m}") for m in ("recall", "fpr", "precision", "mcc")]
    return table.select(
        by, F.round("current_threshold", 9).alias("current_threshold"), F.round("optimal_threshold", 9).alias("optimal_threshold"), *out
    )


# ---- histograms ----------------------------------------------------------


def histogram_limits(predictions: DataFrame, current: DataFrame, optimal: DataFrame, *, zoom: bool = False, by: str = "device_id") -> DataFrame:
    """Upper plot limit per device: max of q99.5 and both thresholds, or twice the larger threshold."""
    pair = current.select(by, F.col("threshold").alias("c")).join(optimal.select(by, F.col("threshold").alias("o")), by, "full")
    if not zoom:
        pair = quantiles(predictions, [by], "score", {"q": 0.995}).join(pair, by, "left")
    pair = pair.withColumns({"c": required("c", "current threshold", by), "o": required("o", "optimal threshold", by)})
    return pair.select(by, (F.greatest("c", "o") * 2.0 if zoom else F.greatest("q", "c", "o")).alias("hi"))


def score_histogram(predictions: DataFrame, limits: DataFrame, *, bins: int = 79, by: str = "device_id") -> DataFrame:
    """Density histogram per device and score group over equal bins of [0, hi].

    Bins are closed on the left; the last one also holds hi.
    """
    v, hi = F.col("score").cast("double"), F.col("hi")
    step = hi / float(bins)
    guess = F.least(F.floor(v / step), F.lit(bins - 1))
    # Settle rounding at the edges against edge(i) = i * step.
    bin_no = (
        F.when(v < guess.cast("double") * step, guess - 1)
        .when((guess < bins - 1) & (v >= (guess + 1).cast("double") * step), guess + 1)
        .otherwise(guess)
        .cast("int")
    )
    rows = lookup_join(predictions, limits, [by], "left").withColumn("hi", required("hi", "histogram limit", by)).where((v >= 0) & (v <= hi))
    counts = rows.groupBy(by, score_group().alias("score_group"), bin_no.alias("bin")).agg(
        F.count("*").alias("n"), F.max("hi").alias("hi")
    )
    inside = F.sum("n").over(Window.partitionBy(by, "score_group"))
    return counts.select(
        by,
        "score_group",
        "bin",
        F.round(F.col("bin") * step, 9).alias("left_edge"),
        "n",
        F.round(F.col("n") / (inside * step), 9).alias("density"),
    )


# ---- curves --------------------------------------------------------------


def _curve(predictions: DataFrame, by: list[str], lead: bool = False) -> DataFrame:
    """Cumulative positives and negatives by descending score, with totals; reads the source once."""
    y = F.col("y_true").cast("long")
    return cumulative(predictions, by, "score", {"pos": y, "neg": 1 - y}, descending=True, lead=lead, totals=True)


def _with_end(curve: DataFrame, by: list[str], point: Column, end: Column) -> DataFrame:
    """The points of a curve; the first cell of each group brings the group's end point along."""
    is_first = (F.col("cum_pos") == F.col("pos")) & (F.col("cum_neg") == F.col("neg"))
    points = curve.select(*by, F.inline(F.when(is_first, F.array(end, point)).otherwise(F.array(point))))
    if by:
        return points
    # Without groups an empty table has its end point all the same.
    alone = curve.sparkSession.range(1).select(F.inline(F.array(end)))
    return points if not curve.isEmpty() else alone


def roc_curve(predictions: DataFrame, by: list[str]) -> DataFrame:
    """(by, threshold, fpr, tpr); points on a straight run between neighbours are left out.

    Starts with (0, 0) at an infinite threshold.
    """
    curve = _curve(predictions, by, lead=True)
    is_first = (F.col("cum_pos") == F.col("pos")) & (F.col("cum_neg") == F.col("neg"))
    corner = (
        is_first
        | F.col("next_pos").isNull()
        | (F.col("next_pos") != F.col("pos"))
        | (F.col("next_neg") != F.col("neg"))
    )
    point = F.struct(
        F.col("score").cast("double").alias("threshold"),
        F.round(ratio(F.col("cum_neg"), F.col("all_neg")), 9).alias("fpr"),
        F.round(ratio(F.col("cum_pos"), F.col("all_pos")), 9).alias("tpr"),
    )
    origin = F.struct(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return _with_end(curve.where(corner), by, point, origin)


def roc_auc(predictions: DataFrame, by: list[str]) -> DataFrame:
    """Area under the ROC curve by trapezoids over the distinct scores."""
    area = F.sum(F.col("neg").cast("double") * (F.col("cum_pos") * 2 - F.col("pos")).cast("double"))
    return (
        _curve(predictions, by)
        .groupBy(*by)
        .agg(area.alias("a"), F.max("all_pos").alias("p"), F.max("all_neg").alias("n"))
        .select(*by, F.round(ratio(F.col("a"), F.col("p").cast("double") * F.col("n").cast("double") * 2.0), 9).alias("auc"))
    )


def pr_curve(predictions: DataFrame, by: list[str]) -> DataFrame:
    """(by, threshold, precision, recall) per distinct score, closed by (1, 0)."""
    point = F.struct(
        F.col("score").cast("double").alias("threshold"),
        F.round(ratio(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")), 9).alias("precision"),
        F.round(ratio(F.col("cum_pos"), F.col("all_pos")), 9).alias("recall"),
    )
    end = F.struct(F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return _with_end(_curve(predictions, by), by, point, end)


def average_precision(predictions: DataFrame, by: list[str]) -> DataFrame:
    """Sum over thresholds of (recall step) x precision."""
    step = F.col("pos").cast("double") * ratio(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg"))
    return (
        _curve(predictions, by)
        .groupBy(*by)
        .agg(F.sum(step).alias("s"), F.max("all_pos").alias("p"))
        .select(*by, F.round(ratio(F.col("s"), F.col("p")), 9).alias("average_precision"))
    )


# ---- prevalence ----------------------------------------------------------


def prevalence_sensitivity(
    predictions: DataFrame, key: str, prevalences: list[float], *, repeats: int = 30, seed: int = 42
) -> DataFrame:
    """Mean and sample deviation of precision, recall, FPR and MCC per prevalence."""
    counts = prevalence_counts(predictions, key, prevalences, repeats=repeats, seed=seed)
    metrics = counts.select("prevalence", "repeat", *metric_columns(["precision", "recall", "fpr", "mcc"], None))
    return metrics.groupBy("prevalence").agg(
        *[
            F.round(f(m), 9).alias(f"{m}_{n}")
            for m in ("precision", "recall", "fpr", "mcc")
            for n, f in (("mean", F.avg), ("std", F.stddev_samp))
        ]
    )


def recalibrated_prevalence(
    predictions: DataFrame, key: str, thresholds: DataFrame, prevalences: list[float], **options
) -> DataFrame:
    """Prevalence sensitivity after re-predicting with other thresholds (in double)."""
    over = F.col("score").cast("double") > F.col("threshold")
    again = with_threshold(predictions.drop("threshold"), thresholds)
    return prevalence_sensitivity(again.withColumn("y_pred", over.cast("byte")), key, prevalences, **options)
