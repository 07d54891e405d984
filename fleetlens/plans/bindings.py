"""How the test tables stand in for traffic, score and record tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fleetlens.functions.expressions import half_up
from fleetlens.session import spread

FEATURES = ["quantity", "extendedprice", "discount", "tax"]
STRATEGIES = ["LOF", "AE per device", "AE global"]
FAMILIES = ["benign", "gafgyt", "mirai"]
PREVALENCES = [0.10, 0.05, 0.01, 0.005, 0.001]
# Stand-ins for configured per-device thresholds.
CURRENT_THRESHOLDS = {d: round(3.0 + 0.15 * d, 2) for d in range(1, 10)}

WINDOW_BASES = ("MI_dir_weight", "HH_mean", "HpHp_std")
WINDOW_WEIGHTS = {"L5": 0.9, "L3": 0.7, "L1": 0.5, "L0_1": 0.3, "L0_01": 0.1}
WINDOW_FEATURES = [
    f"{base.rsplit('_', 1)[0]}_{w}_{base.rsplit('_', 1)[1]}" for base in WINDOW_BASES for w in WINDOW_WEIGHTS
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _traffic_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every lineitem row with labels; devices 3 and 7 know no mirai attacks."""
    family = (
        F.when(F.col("l_returnflag") == "N", "benign")
        .when((F.col("l_returnflag") == "A") | F.col("device_id").isin(3, 7), "gafgyt")
        .otherwise("mirai")
    )
    kind = (
        F.when(F.col("l_returnflag") == "N", "benign")
        .when(F.col("l_linestatus") == "F", "tcp")
        .when(F.col("l_linenumber") % 2 == 0, "udp")
        .otherwise("scan")
    )
    key = F.concat_ws(
        "|",
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        half_up(F.col("l_extendedprice") * 100),
        F.col("l_shipdate").cast("date").cast("string"),
    )
    lines = spread(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")
    rows = lines.withColumn("device_id", (F.col("l_suppkey") % 9 + 1).cast("int"))
    return rows.select(
        "*",
        key.alias("row_key"),
        (F.col("l_returnflag") != "N").alias("is_attack"),
        family.alias("attack_family"),
        kind.alias("attack_type"),
    )


def traffic(spark: SparkSession, sf_dir: str, dtype: str = "float") -> DataFrame:
    """Keyed traffic rows: four features and the labels."""
    return _traffic_rows(spark, sf_dir).select(
        "row_key",
        "device_id",
        *[F.col(f"l_{f}").cast(dtype).alias(f) for f in FEATURES],
        "is_attack",
        "attack_family",
        "attack_type",
    )


def windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifteen features named by the feature grammar: three bases in five windows."""
    pairs = [("l_quantity", "l_linenumber", 6.0), ("l_extendedprice", "l_quantity", 1500.0), ("l_discount", "l_tax", 1.5)]
    columns = []
    for base, (a, b, unit) in zip(WINDOW_BASES, pairs):
        stem, stat = base.rsplit("_", 1)
        for w, share in WINDOW_WEIGHTS.items():
            value = F.col(a).cast("double") * F.lit(share) + F.col(b).cast("double") * F.lit(unit) * F.lit(round(1 - share, 1))
            columns.append(value.alias(f"{stem}_{w}_{stat}"))
    return _traffic_rows(spark, sf_dir).select("row_key", "device_id", *columns, "attack_family")


def _boost() -> Column:
    """Pushes attack scores up so that detection is neither perfect nor blind."""
    return (
        F.when(F.col("l_returnflag") == "A", F.col("l_tax") * 20.0)
        .when(F.col("l_returnflag") == "R", F.col("l_discount") * 30.0)
        .otherwise(0.0)
    )


def _strategy_score(strategy: str) -> Column:
    price, quantity = F.col("l_extendedprice") / 30000.0, F.col("l_quantity") / 15.0
    return {
        "LOF": price + _boost(),
        "AE per device": quantity + _boost() * 1.5,
        "AE global": (price + quantity) * 0.5 + _boost() * 0.5,
    }[strategy].cast("float")


def thresholds(spark: SparkSession, values: dict[int, float] | None = None) -> DataFrame:
    return spark.createDataFrame(list((values or CURRENT_THRESHOLDS).items()), "device_id int, threshold double")


def predictions(spark: SparkSession, sf_dir: str, strategy: str = "LOF") -> DataFrame:
    """A stored prediction table of one strategy, with the thresholds of its run applied."""
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in CURRENT_THRESHOLDS.items() for x in kv]), F.col("device_id"))
    scored = _traffic_rows(spark, sf_dir).withColumn("score", _strategy_score(strategy))
    return scored.select(
        "row_key",
        "device_id",
        "score",
        F.col("is_attack").cast("byte").alias("y_true"),
        (F.col("score") > limit.cast("float")).cast("byte").alias("y_pred"),
        "attack_family",
        "attack_type",
    )


def scored(spark: SparkSession, sf_dir: str, strategy: str = "LOF") -> DataFrame:
    """Labelled scores before any threshold."""
    return predictions(spark, sf_dir, strategy).withColumn("is_attack", F.col("y_true") == 1).drop("y_true", "y_pred")


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second prediction table, from events."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        (F.col("user_id") % 9 + 1).cast("int").alias("device_id"),
        F.col("value").cast("float").alias("score"),
        (F.col("event_type") == "error").cast("byte").alias("y_true"),
        F.col("event_type").alias("attack_type"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding rows as feature vectors of three devices."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        (F.col("vec_id") % 3 + 1).cast("int").alias("device_id"),
        F.col("embedding").alias("features"),
        (F.col("label") >= 7).alias("is_attack"),
    )


def device_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Device dimension: a device is named after the supplier of its number."""
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("int").alias("device"), F.col("s_name").alias("device_name")
    )


def file_name() -> Column:
    """Synthetic source file name of a traffic row."""
    return F.when(
        F.col("is_attack"), F.concat_ws(".", F.col("device_id").cast("string"), "attack_family", "attack_type", F.lit("csv"))
    ).otherwise(F.concat_ws(".", F.col("device_id").cast("string"), F.lit("benign"), F.lit("csv")))


def file_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_name, n_samples, n_features) counted from the traffic rows."""
    return (
        traffic(spark, sf_dir)
        .groupBy(file_name().alias("file_name"))
        .agg(F.count("*").alias("n_samples"))
        .withColumn("n_features", F.lit(len(FEATURES)))
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training histories: events by device, kind (as model) and step (as epoch)."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(
            (F.col("user_id") % 9 + 1).cast("int").alias("device_id"),
            F.col("event_type").alias("model_id"),
            (F.col("event_id") % 12 + 1).cast("int").alias("epoch"),
        )
        .agg(F.round(F.avg("value"), 6).alias("loss"), F.round(F.max("value") / 10.0, 6).alias("val_loss"))
    )


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search trials: events by device and step, with derived parameters."""
    return (
        table(spark, sf_dir, "events")
        .groupBy((F.col("user_id") % 9 + 1).cast("int").alias("device_id"), (F.col("event_id") % 10).cast("int").alias("number"))
        .agg(
            F.round(F.max("value"), 4).alias("value"),
            F.count("*").alias("n_neighbors"),
            F.max("event_type").alias("metric"),
        )
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and timing records: stored bytes and rows per device and strategy."""
    rows = _traffic_rows(spark, sf_dir)
    per_device = rows.groupBy("device_id").agg(
        F.count_if(~F.col("is_attack")).alias("n_train"),
        F.count("*").alias("n_scored"),
        F.sum(F.when(~F.col("is_attack"), F.length("row_key") + 16)).alias("bytes"),
        F.sum("l_linenumber").alias("work"),
    )
    variants = F.array(
        *[
            F.struct(F.lit(s).alias("strategy"), F.lit(f).cast("double").alias("factor"), F.lit(t).cast("double").alias("rate"))
            for s, f, t in (("LOF", 1.0, 0.0), ("AE per device", 0.25, 0.001), ("AE global", 0.0625, 0.002))
        ]
    )
    return per_device.select("*", F.inline(variants)).select(
        "strategy",
        "device_id",
        "n_train",
        "n_scored",
        (F.col("bytes") * F.col("factor") / 1048576.0).alias("model_size_mb"),
        (F.col("work") * F.col("rate")).alias("seconds"),
    )
