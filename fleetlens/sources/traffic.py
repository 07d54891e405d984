"""Scans and sinks for labelled traffic files, catalogs, records and artefacts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from fleetlens.operators.joins import lookup_join
from fleetlens.schema import PREDICTION_SCHEMA

LABEL_SCHEMA = "struct<device_id:int,is_attack:boolean,attack_family:string,attack_type:string>"


def file_labels(name: Column) -> Column:
    """Labels out of "<device>.benign.csv" or "<device>.<family>.<type>.csv"; other names raise."""
    parts = F.split(F.regexp_replace(name, "\\.csv$", ""), "\\.")
    device = F.try_element_at(parts, F.lit(1)).try_cast("int")
    second, third = F.try_element_at(parts, F.lit(2)), F.try_element_at(parts, F.lit(3))
    n = F.size(parts)

    def labels(attack: bool, family: Column, kind: Column) -> Column:
        return F.struct(
            device.alias("device_id"),
            F.lit(attack).alias("is_attack"),
            family.alias("attack_family"),
            kind.alias("attack_type"),
        )

    wrong = F.raise_error(F.concat(F.lit("unexpected traffic file name: "), name)).cast(LABEL_SCHEMA)
    return (
        F.when((n == 2) & (second == "benign") & device.isNotNull(), labels(False, F.lit("benign"), F.lit("benign")))
        .when((n == 3) & device.isNotNull(), labels(True, second, third))
        .otherwise(wrong)
    )


def source_file_name() -> Column:
    """Name of the CSV behind a row: the file itself, or the folder holding its parts.

    Cut out by plain functions: a pattern would be tried at every character of the path, for every row.
    """
    return csv_name(F.col("_metadata.file_path"))


def csv_name(path: Column) -> Column:
    """The last "<name>.csv" that is a folder right above the file, or the file; empty if there is none."""

    def name(level: int) -> Column:
        part = F.substring_index(F.substring_index(F.substring_index(path, "/", level), "/", 1), "=", -1)
        return F.when(part.endswith(".csv") & (F.length(part) > len(".csv")), part)

    return F.coalesce(name(-2), name(-1), F.lit(""))


def scan_csv(spark: SparkSession, paths: str | list[str], features: list[str], dtype: T.DataType | None = None) -> DataFrame:
    """Numeric CSV files with a header and a declared schema; malformed rows fail the job.

    Adds ``file_name``.
    """
    paths = [paths] if isinstance(paths, str) else paths
    if not paths:
        raise ValueError("the list of traffic files is empty")
    schema = T.StructType([T.StructField(f, dtype or T.DoubleType()) for f in features])
    reader = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("recursiveFileLookup", True)
    return reader.csv(paths).select("*", source_file_name().alias("file_name"))


def label_rows(scanned: DataFrame, *, as_float: bool = True) -> DataFrame:
    """Labels from the file name; features as float32 unless the wide copy is wanted."""
    features = [c for c in scanned.columns if c != "file_name"]
    kept = [F.col(c).cast("float").alias(c) if as_float else F.col(c) for c in features]
    return scanned.select(*kept, file_labels(F.col("file_name")).alias("l")).select(*features, "l.*")


def write_traffic(traffic: DataFrame, path: str, *, compression: str = "snappy", whole: bool = False) -> None:
    """One partitioned table; only the devices at hand are replaced, or with ``whole`` the table.

    Rebalancing keeps files few and still splits a device too large for one task.
    """
    (
        traffic.hint("rebalance", "device_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static" if whole else "dynamic")
        .option("compression", compression)
        .partitionBy("device_id")
        .parquet(path)
    )


def write_raw_csv(rows: DataFrame, path: str) -> None:
    """Raw copy: one folder per source file, named after it."""
    balanced = rows.hint("rebalance", "file_name")
    balanced.write.mode("overwrite").option("header", True).partitionBy("file_name").csv(path)


def write_splits(splits: DataFrame, path: str) -> None:
    balanced = splits.hint("rebalance", "device_id", "split")
    balanced.write.mode("overwrite").partitionBy("device_id", "split").parquet(path)


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """File names of the summary CSV, blanks stripped from header and values."""
    table = spark.read.option("header", True).csv(path)
    table = table.withColumnsRenamed({c: c.strip() for c in table.columns})
    if "File Name" not in table.columns:
        raise KeyError(f"column 'File Name' not found in {table.columns}")
    return table.select(F.trim("File Name").alias("file_name"))


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """Summary CSV as (file_name, n_samples, n_features)."""
    table = spark.read.option("header", True).csv(path)
    table = table.withColumnsRenamed({c: c.strip() for c in table.columns})
    return table.select(
        F.trim("File Name").alias("file_name"),
        F.trim("Data Count").cast("long").alias("n_samples"),
        F.trim("Feature Count").cast("int").alias("n_features"),
    )


def build_file_catalog(summary: DataFrame, devices: DataFrame) -> DataFrame:
    """Catalog rows in their fixed column order; device names joined from the left.

    Spark broadcasts the device table by its own size estimate.
    """
    parts = F.split("file_name", "\\.")
    is_attack = parts[1] != "benign"
    rows = summary.select(
        "file_name",
        parts[0].cast("int").alias("device"),
        is_attack.alias("is_attack"),
        parts[1].alias("diagnostic"),
        F.when(is_attack, parts[2]).otherwise("benign").alias("attack_type"),
        "n_samples",
        "n_features",
    )
    return rows.join(devices, "device", "left").select(
        "file_name", "device", "device_name", "is_attack", "diagnostic", "attack_type", "n_samples", "n_features"
    )


def scan_projected(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Column-pruned Parquet scan as float32."""
    return spark.read.parquet(path).select(*[F.col(c).cast("float").alias(c) for c in columns])


def split_counts(splits: DataFrame) -> DataFrame:
    """Rows per device and split; on the partitioned table no data column is read."""
    return splits.groupBy("device_id", "split").agg(F.count("*").alias("n_rows"))


def artifact_sizes(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Size in MB (4 decimals) of a file or folder tree; contents are not read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    )
    return files.select("path", "length").agg(
        F.count("*").alias("n_files"), F.bround(F.sum("length") / (1024 * 1024), 4).alias("size_mb")
    )


def union_devices(tables: dict[int, DataFrame]) -> DataFrame:
    """Per-device result tables stacked, each tagged with its device."""
    return reduce(lambda a, b: a.unionByName(b), [t.withColumn("device", F.lit(d)) for d, t in tables.items()])


def read_devices(spark: SparkSession, path: str) -> DataFrame:
    """All per-device tables below a folder partitioned by device, tagged with their device."""
    return spark.read.parquet(path).withColumn("device", F.col("device_id").cast("int")).drop("device_id")


def write_run_summaries(rows: DataFrame, path: str) -> None:
    """Nested summaries: one JSON document per device, in a folder of its own."""
    rows.write.mode("overwrite").partitionBy("device_id").json(path)


def read_run_summaries(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The documents of a run, one row per device, with the number of devices of their experiment."""
    documents = spark.read.schema(schema).json(path)
    sizes = documents.groupBy("experiment").agg(F.count("*").alias("n_devices"))
    return lookup_join(documents, sizes, ["experiment"])


def scan_histories(spark: SparkSession, path: str) -> DataFrame:
    """Training histories under .../device_<n>/<model>/..., tagged from the path."""
    where = F.col("_metadata.file_path")
    return (
        spark.read.schema("epoch int, loss double, val_loss double")
        .option("header", True)
        .option("recursiveFileLookup", True)
        .csv(path)
        .select(
            F.regexp_extract(where, "device_(?:id=)?([0-9]+)", 1).cast("int").alias("device_id"),
            F.regexp_extract(where, "(?:/model_id=|/)([^/=]+)/[^/]+$", 1).alias("model_id"),
            "epoch",
            "loss",
            "val_loss",
        )
    )


def write_scores(scored: DataFrame, path: str, column: str = "score", partition_by: list[str] | None = None) -> None:
    """Score sink: files with one float column, below folders named by ``partition_by``."""
    kept = scored.select(F.col(column).cast("float").alias(column), *(partition_by or []))
    kept.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(path)


def write_scores_with_metadata(scored: DataFrame, metadata: list[str], path: str, column: str = "score") -> None:
    """Scores next to the metadata of the same row (keys travel with it)."""
    scored.select(F.col(column).cast("float").alias(column), *metadata).write.mode("overwrite").parquet(path)


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Prediction sink with its declared types, benign and attack rows in folders of their own."""
    declared = [F.col(f.name).cast(f.dataType).alias(f.name) for f in PREDICTION_SCHEMA]
    predictions.select(*declared).write.mode("overwrite").partitionBy("is_attack").parquet(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """A stored prediction table; other columns or types than the declared ones are an error."""
    table = spark.read.parquet(path)
    if "is_attack" in table.columns:
        # Folder names are text.
        table = table.withColumn("is_attack", F.col("is_attack").cast("boolean"))
    found = {f.name: f.dataType.simpleString() for f in table.schema}
    wrong = [f.name for f in PREDICTION_SCHEMA if found.get(f.name) != f.dataType.simpleString()]
    if wrong:
        raise TypeError(f"not a prediction table, wrong or missing columns {wrong}")
    return table.select(*[f.name for f in PREDICTION_SCHEMA])
