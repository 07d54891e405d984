"""Structure, redundancy, variance, scale and correlation profiles."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetlens.functions.expressions import ratio
from fleetlens.operators.joins import skew_join
from fleetlens.operators.ordering import quantiles
from fleetlens.schema import WINDOWS, base_feature, feature_window

LABELS = ["device_id", "attack_family", "attack_type"]


# ---- structure -----------------------------------------------------------


def structural_summary(catalog: DataFrame, n_features: int) -> DataFrame:
    """Files, samples, variables, devices, attack families and attack types."""
    attack = lambda c: F.when(F.col("is_attack"), F.col(c))
    figures = catalog.agg(
        F.count("*").alias("n_files"),
        F.sum("n_samples").alias("n_samples"),
        F.lit(n_features).cast("long").alias("n_features"),
        F.count_distinct("device").alias("n_devices"),
        F.count_distinct(attack("diagnostic")).alias("n_families"),
        F.count_distinct(attack("attack_type")).alias("n_types"),
    )
    return figures.unpivot([], figures.columns, "metric", "value")


def class_distribution(catalog: DataFrame) -> DataFrame:
    totals = catalog.agg(
        F.sum(F.when(~F.col("is_attack"), F.col("n_samples")).otherwise(0)).alias("benign"),
        F.sum(F.when(F.col("is_attack"), F.col("n_samples")).otherwise(0)).alias("attack"),
    )
    both = totals.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("class"), F.col(c).alias("n"), (F.col("benign") + F.col("attack")).alias("all"))
                    for c in ("benign", "attack")
                ]
            )
        )
    )
    return both.select("class", F.col("n").alias("n_samples"), (ratio(F.col("n"), F.col("all")) * 100).alias("percent"))


def device_class_pivot(catalog: DataFrame) -> DataFrame:
    label = F.concat(F.col("device").cast("string"), F.lit(". "), F.col("device_name"))
    return (
        catalog.groupBy("device", "device_name")
        .pivot("is_attack", [False, True])
        .agg(F.sum("n_samples"))
        .select(
            "device",
            label.alias("device_label"),
            F.coalesce(F.col("false"), F.lit(0)).alias("n_benign"),
            F.coalesce(F.col("true"), F.lit(0)).alias("n_attack"),
        )
    )


def family_share(catalog: DataFrame) -> DataFrame:
    families = catalog.where("is_attack").groupBy("diagnostic").agg(F.sum("n_samples").alias("n_samples"))
    # One row per family is left for the window.
    total = F.sum("n_samples").over(Window.partitionBy(F.lit(0)))
    return families.withColumn("percent", ratio(F.col("n_samples"), total) * 100)


def attack_type_totals(catalog: DataFrame) -> DataFrame:
    return (
        catalog.where("is_attack")
        .groupBy("diagnostic", "attack_type")
        .agg(F.sum("n_samples").alias("n_samples"))
        .select(F.concat_ws(".", "diagnostic", "attack_type").alias("attack"), "n_samples")
    )


def device_family_pivot(catalog: DataFrame, families: list[str]) -> DataFrame:
    label = F.concat(F.col("device").cast("string"), F.lit(". "), F.col("device_name"))
    return (
        catalog.groupBy("device", "device_name")
        .pivot("diagnostic", families)
        .agg(F.sum("n_samples"))
        .select("device", label.alias("device_label"), *[F.coalesce(F.col(f), F.lit(0)).alias(f) for f in families])
    )


# ---- one-pass column profiles --------------------------------------------


def _per_column(df: DataFrame, columns: list[str], measures: dict[str, callable]) -> DataFrame:
    """All measures of all columns in one aggregate, then one row per column."""
    whole = df.agg(*[F.struct(*[m(F.col(c)).alias(k) for k, m in measures.items()]).alias(c) for c in columns])
    return whole.unpivot([], columns, "feature", "m").select("feature", "m.*")


def _is_missing(c: Column, numeric: bool) -> Column:
    return (c.isNull() | F.isnan(c)) if numeric else c.isNull()


def missing_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Missing values per column and the mean share over all columns."""
    columns = columns or df.columns
    floats = {f.name for f in df.schema if f.dataType.typeName() in ("float", "double")}
    counts = df.agg(
        F.count("*").alias("_n"), *[F.count_if(_is_missing(F.col(c), c in floats)).alias(c) for c in columns]
    )
    overall = sum((F.col(c) for c in columns[1:]), F.col(columns[0])) / F.lit(float(len(columns)))
    return (
        counts.withColumn("_all", ratio(overall, F.col("_n")) * 100)
        .unpivot(["_n", "_all"], columns, "feature", "n_missing")
        .select(
            "feature",
            "n_missing",
            (ratio(F.col("n_missing"), F.col("_n")) * 100).alias("percent"),
            F.col("_all").alias("overall_percent"),
        )
        .orderBy(F.desc("percent"), "feature")
    )


def feature_variance(df: DataFrame, columns: list[str]) -> DataFrame:
    """Sample variance per feature."""
    return _per_column(df, columns, {"variance": lambda c: F.var_samp(c.cast("double"))})


def both_ends(table: DataFrame, by: str, n: int = 20) -> DataFrame:
    """The n smallest and n largest rows, tagged with the end they come from."""
    low = table.orderBy(F.asc(by), "feature").limit(n).withColumn("end", F.lit("smallest"))
    high = table.orderBy(F.desc(by), F.desc("feature")).limit(n).withColumn("end", F.lit("largest"))
    return low.unionByName(high)


def constant_features(df: DataFrame, columns: list[str]) -> DataFrame:
    return feature_variance(df, columns).agg(F.count_if(F.col("variance") == 0).alias("n_constant"))


def long_format(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """(feature, value) rows; feeds counts that are combined before any shuffle."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(*(keep or []), F.inline(pairs))


def scale_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std, min, exact quartiles, max, range and IQR per feature."""
    double = lambda f: (lambda c: f(c.cast("double")))
    moments = _per_column(
        df,
        columns,
        {
            "count": F.count,
            "mean": double(F.avg),
            "std": double(F.stddev_samp),
            "min": double(F.min),
            "max": double(F.max),
        },
    )
    quartiles = quantiles(long_format(df, columns), ["feature"], "value", {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    return moments.join(quartiles, "feature").select(
        "*", (F.col("max") - F.col("min")).alias("range"), (F.col("q3") - F.col("q1")).alias("iqr")
    )


def low_variance_profile(df: DataFrame, columns: list[str], below: float = 1.0) -> DataFrame:
    """Scale profile of the features whose sample variance is under a bound."""
    variances = feature_variance(df, columns).where(F.col("variance") < below).select("feature").collect()
    kept = [r["feature"] for r in variances]
    return scale_profile(df, [c for c in columns if c in kept]).drop("range", "iqr")


# ---- duplicates ----------------------------------------------------------


def duplicate_mask(df: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``is_duplicate``: true for every member of a group of equal keys.

    Group sizes are pre-aggregated. Only keys that repeat are joined back, and
    a key copied very often is handled by the hot side of ``skew_join``.
    """
    repeated = df.groupBy(*keys).agg(F.count("*").alias("_copies")).where("_copies > 1").select(*keys, F.lit(True).alias("_dup"))
    return skew_join(df, repeated, keys, "left").withColumn("is_duplicate", F.coalesce("_dup", F.lit(False))).drop("_dup")


def duplicate_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, duplicates and their share by device and family, plus a Total row.

    Two aggregates and no join back: the first counts copies per (keys, labels),
    the second sees at most one row per label of a key, whatever the copies.
    """
    labels = ["device_id", "attack_family"]
    held = [c for c in labels if c not in keys]
    cells = df.groupBy(*keys, *held).agg(F.count("*").alias("n"))
    if held:
        per_key = cells.groupBy(*keys).agg(
            F.sum("n").alias("copies"), F.collect_list(F.struct(*held, "n")).alias("cells")
        )
        cells = per_key.select(*[k for k in keys if k in labels], "copies", F.inline("cells"))
    else:
        cells = cells.withColumn("copies", F.col("n"))
    dup = F.sum(F.when(F.col("copies") > 1, F.col("n")).otherwise(0))
    name = F.when(F.grouping_id() != 0, "Total").otherwise(
        F.concat(F.lit("device_"), F.col("device_id").cast("string"), F.lit(" - "), F.col("attack_family"))
    )
    return (
        cells.groupingSets([["device_id", "attack_family"], []], "device_id", "attack_family")
        .agg(name.alias("device_family"), F.sum("n").alias("n_samples"), dup.alias("n_duplicates"))
        .select(
            "device_family",
            "n_samples",
            "n_duplicates",
            F.bround(ratio(F.col("n_duplicates"), F.col("n_samples")) * 100, 2).alias("percent"),
        )
    )


def split_label(label: Column) -> tuple[Column, Column, Column]:
    """(device text, numeric device, family) of a "device_N - family" label."""
    parts = F.split(label, " - ")
    return parts[0], F.regexp_replace(parts[0], "device_", "").cast("int"), parts[1]


def duplicate_pivot(summary: DataFrame, families: list[str]) -> DataFrame:
    """Duplicate share as device rows by family columns, in numeric device order."""
    device, number, family = split_label(F.col("device_family"))
    return (
        summary.where("device_family <> 'Total'")
        .select(number.alias("device_id"), device.alias("device"), family.alias("family"), "percent")
        .groupBy("device_id", "device")
        .pivot("family", families)
        .agg(F.first("percent"))
        .orderBy("device_id")
    )


# ---- feature grammar and correlation -------------------------------------


def feature_dimension(spark, names: list[str]) -> DataFrame:
    """(pos, feature, base, window) from the schema alone."""
    dim = spark.createDataFrame(list(enumerate(names)), "pos int, feature string")
    dotted = F.regexp_replace("feature", "_L0_", "_L0.")
    return dim.select("pos", "feature", base_feature(dotted).alias("base"), feature_window(dotted).alias("window"))


def correlation_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, abs_r) for every ordered pair, from one distributed pass.

    Only the d x d matrix of the schema's width reaches the driver.
    """
    vector = VectorAssembler(inputCols=columns, outputCol="v", handleInvalid="error").transform(
        df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    )
    matrix = Correlation.corr(vector.select("v"), "v").first()[0].toArray()
    rows = [
        (columns[i], columns[j], abs(float(matrix[i, j]))) for i in range(len(columns)) for j in range(len(columns))
    ]
    return df.sparkSession.createDataFrame(rows, "a string, b string, abs_r double")


def _with_grammar(pairs: DataFrame, dim: DataFrame) -> DataFrame:
    side = lambda s: dim.select(*[F.col(c).alias(f"{s}_{c}") for c in ("feature", "base", "window", "pos")])
    # The dimension has one row per column of the schema.
    return pairs.join(F.broadcast(side("a")), F.col("a") == F.col("a_feature")).join(
        F.broadcast(side("b")), F.col("b") == F.col("b_feature")
    )


def window_correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """|r| over the window pairs of each base feature, summarised and sorted by mean."""
    dim = feature_dimension(df.sparkSession, columns)
    pairs = _with_grammar(correlation_pairs(df, columns), dim)
    return (
        pairs.where("a_base = b_base and a_window is not null and a_pos < b_pos")
        .groupBy(F.col("a_base").alias("base"))
        .agg(
            F.avg("abs_r").alias("mean"),
            F.percentile("abs_r", F.lit(0.5)).alias("median"),
            F.min("abs_r").alias("min"),
            F.percentile("abs_r", F.lit(0.25)).alias("q1"),
            F.percentile("abs_r", F.lit(0.75)).alias("q3"),
            F.max("abs_r").alias("max"),
        )
        .orderBy("mean", "base")
    )


def feature_correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """|r| between base features inside each window, long format in base order."""
    dim = feature_dimension(df.sparkSession, columns)
    pairs = _with_grammar(correlation_pairs(df, columns), dim)
    order = F.array_position(F.array(*[F.lit(w) for w in WINDOWS]), F.col("a_window"))
    return (
        pairs.where("a_window = b_window")
        .select(F.col("a_window").alias("window"), F.col("a_base").alias("base_i"), F.col("b_base").alias("base_j"), "abs_r", order.alias("_o"))
        .orderBy("_o", "base_i", "base_j")
        .drop("_o")
    )
