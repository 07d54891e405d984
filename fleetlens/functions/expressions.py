"""Column expressions shared by the operators; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Sub-buckets per power of two. A bucket spans 0.27 % of its value, so it can
# hold at most about 46 000 distinct float32 values.
STEPS_PER_OCTAVE = 256
# Shifts every bucket of a positive double above zero (2^-1074 is the smallest).
BUCKET_SHIFT = 1080 * STEPS_PER_OCTAVE


def hash_order(salt: Column | str | int, *keys: Column | str) -> Column:
    """Portable pseudo-random sort key: md5 over the row key and a salt."""
    salt = salt if isinstance(salt, Column) else F.lit(str(salt))
    return F.md5(F.concat_ws("|", *[c if isinstance(c, Column) else F.col(c) for c in keys], salt.cast("string")))


def half_up(value: Column) -> Column:
    """Nearest whole number as a long, halves away from zero: as ``round``, without its detour by decimals."""
    size = F.abs(value)
    whole = F.floor(size)
    return (F.signum(value) * (whole + F.when(size - whole.cast("double") >= 0.5, 1).otherwise(0))).cast("long")


def hash_bucket(order: Column | str, cores: int) -> Column:
    """Leading hex digits of a hash order: 4 096 or, on a large cluster, 65 536 even buckets.

    The number of buckets only balances work; results do not depend on it.
    """
    return F.substring(order, 1, 3 if cores < 256 else 4)


def value_bucket(value: Column | str) -> Column:
    """Monotone bucket number of a double.

    It depends on the value alone, so recomputed tasks agree without any
    sampling, and ordering by (bucket, value) equals ordering by value.
    Infinities have buckets of their own, null comes first and NaN last, as Spark sorts them.
    """
    value = F.col(value) if isinstance(value, str) else value
    size = F.floor(F.log2(F.abs(value)) * F.lit(float(STEPS_PER_OCTAVE))) + F.lit(BUCKET_SHIFT)
    endless = F.lit(2 * BUCKET_SHIFT)
    return (
        F.when(value.isNull(), -endless - 1)
        .when(F.isnan(value), endless + 1)
        .when(F.abs(value) == float("inf"), F.signum(value) * endless)
        .when(value > 0, size)
        .when(value < 0, -size)
        .otherwise(F.lit(0))
        .cast("long")
    )


# Keys per power of two of ``value_key``.
KEYS_PER_OCTAVE = 1 << 51


def value_key(value: Column | str) -> Column:
    """Monotone 64-bit number of a double that tells at most two neighbouring values alike.

    Exponent and leading bits of the mantissa, taken by arithmetic on powers of two, which is exact.
    """
    value = F.col(value) if isinstance(value, str) else value
    octave = F.floor(F.log2(F.abs(value)))
    part = F.floor((F.abs(value) / F.pow(F.lit(2.0), octave.cast("double")) - 1.0) * float(KEYS_PER_OCTAVE))
    size = (octave + 1076) * F.lit(KEYS_PER_OCTAVE) + part
    endless = F.lit(2200 * KEYS_PER_OCTAVE)
    return (
        F.when(F.isnan(value), endless + 1)
        .when(value == float("inf"), endless)
        .when(value == float("-inf"), -endless)
        .when(value > 0, size)
        .when(value < 0, -size)
        .otherwise(F.lit(0))
        .cast("long")
    )


def ratio(top: Column, bottom: Column, default: float | None = 0.0) -> Column:
    """top / bottom in double, ``default`` where the divisor is zero."""
    quotient = F.try_divide(top.cast("double"), bottom.cast("double"))
    return quotient if default is None else F.coalesce(quotient, F.lit(default))


def is_cell(y_true: int, y_pred: int) -> Column:
    return (F.col("y_true") == y_true) & (F.col("y_pred") == y_pred)


def confusion_cells() -> list[Column]:
    """Aggregates for the four cells of a confusion matrix."""
    return [
        F.count_if(is_cell(1, 1)).alias("tp"),
        F.count_if(is_cell(0, 1)).alias("fp"),
        F.count_if(is_cell(0, 0)).alias("tn"),
        F.count_if(is_cell(1, 0)).alias("fn"),
    ]


def mcc(tp: Column, fp: Column, tn: Column, fn: Column) -> Column:
    """Matthews correlation; 0 when a margin is empty."""
    tp, fp, tn, fn = (c.cast("double") for c in (tp, fp, tn, fn))
    margin = F.sqrt((tp + fp) * (tp + fn)) * F.sqrt((tn + fp) * (tn + fn))
    return ratio(tp * tn - fp * fn, margin)


def nine_metrics(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    """The usual nine detection metrics from confusion counts."""
    recall, specificity = ratio(tp, tp + fn), ratio(tn, tn + fp)
    # Balanced accuracy averages the recall of the classes that occur.
    balanced = (
        F.when(tp + fn == 0, specificity).when(tn + fp == 0, recall).otherwise((recall + specificity) / 2)
    )
    return {
        "recall": recall,
        "fpr": ratio(fp, fp + tn),
        "balanced_accuracy": balanced,
        "mcc": mcc(tp, fp, tn, fn),
        "precision": ratio(tp, tp + fp),
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "accuracy": ratio(tp + tn, tp + fp + tn + fn),
        "specificity": specificity,
        "fnr": ratio(fn, fn + tp),
    }


def metric_columns(names: list[str] | None = None, digits: int | None = 9) -> list[Column]:
    """Metric columns over tp/fp/tn/fn, rounded for stable comparison."""
    metrics = nine_metrics(F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn"))
    picked = names or list(metrics)
    return [(metrics[n] if digits is None else F.round(metrics[n], digits)).alias(n) for n in picked]

