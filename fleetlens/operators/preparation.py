"""The prepare job: raw files to ingested, split and scaled tables.

The job is a graph of stages. A stage writes below a folder that carries the
fingerprint of its options and of the stages it reads, so other options or
other raw files give another version beside the old one, and a restart goes on
behind the last stage that was written whole (Spark's success mark). Scaler
parameters are stages of their own and are read back by those that apply them.

    raw -> base -> splits -> scaler (per device, fleet) -> scaled (per device, fleet)
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from fleetlens.operators import sampling, scaling
from fleetlens.sources import traffic as src

KEY = "_row"


@dataclass
class Stages:
    """Runs stages below ``root`` unless their version is there already."""

    spark: SparkSession
    root: str
    paths: dict[str, str] = field(default_factory=dict)
    prints: dict[str, str] = field(default_factory=dict)
    ran: list[str] = field(default_factory=list)

    def run(self, name: str, write: Callable[[str], None], inputs: list[str], **options) -> str:
        said = json.dumps([options, [self.prints[i] for i in inputs]], sort_keys=True)
        self.prints[name] = hashlib.sha1(said.encode()).hexdigest()[:16]
        path = f"{self.root.rstrip('/')}/{name}/version={self.prints[name]}"
        if not self._is_whole(path):
            write(path)
            self.ran.append(name)
        self.paths[name] = path
        return path

    def _is_whole(self, path: str) -> bool:
        jvm = self.spark._jvm
        mark = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return bool(mark.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(mark))


def raw_fingerprint(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of the raw files; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    seen = files.agg(F.count("*").alias("n"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")).alias("h")).first()
    if not seen["n"]:
        raise ValueError("the list of traffic files is empty")
    return f"{seen['n']}-{seen['h']}"


def save_scaler(scaler: DataFrame, path: str) -> None:
    scaler.write.mode("overwrite").parquet(path)


def load_scaler(spark: SparkSession, path: str, columns: list[str], by: str | None = "device_id") -> DataFrame:
    """Stored parameters; a table that lacks a feature is an error."""
    table = spark.read.parquet(path)
    wanted = [*([by] if by else []), *[f"{n}_{c}" for c in columns for n in ("mean", "scale")]]
    missing = [c for c in wanted if c not in table.columns]
    if missing:
        raise TypeError(f"not a scaler for these features, missing columns {missing}")
    return table.select(*wanted)


def _stored(spark: SparkSession, path: str, features: list[str]) -> DataFrame:
    """A partitioned traffic table with a key for each of its rows, the same whenever it is read."""
    table = spark.read.parquet(path)
    key = F.concat_ws("|", F.col("_metadata.file_name"), F.col("_metadata.row_index").cast("string"))
    return table.select(F.col("device_id").cast("int").alias("device_id"), *features, "is_attack", "attack_family", "attack_type", key.alias(KEY))


def prepare(
    spark: SparkSession, raw: str, features: list[str], root: str, *, train_size: float = 0.6, val_size: float = 0.2, seed: int = 42, compression: str = "snappy"
) -> Stages:
    """Runs what is missing; the result names the folder of every stage and those that ran.

    ``scaled_device`` and ``scaled_fleet`` are partitioned by device and split, like ``splits``.
    """
    stages = Stages(spark, root)
    stages.prints["raw"] = raw_fingerprint(spark, raw)

    def base(path: str) -> None:
        scanned = src.scan_csv(spark, raw, features, T.DoubleType())
        src.write_traffic(src.label_rows(scanned), path, compression=compression, whole=True)

    def splits(path: str) -> None:
        rows = _stored(spark, stages.paths["base"], features)
        marked = sampling.split_benign(rows, KEY, train_size=train_size, val_size=val_size, seed=seed)
        src.write_splits(marked.drop(KEY), path)

    def read_splits() -> DataFrame:
        table = spark.read.parquet(stages.paths["splits"])
        return table.withColumn("device_id", F.col("device_id").cast("int"))

    stages.run("base", base, ["raw"], features=features, compression=compression)
    stages.run("splits", splits, ["base"], train_size=train_size, val_size=val_size, seed=seed)
    for layout, by in (("device", "device_id"), ("fleet", None)):
        scaler, scaled = f"scaler_{layout}", f"scaled_{layout}"

        def fit(path: str, by=by) -> None:
            save_scaler(scaling.fit_scaler(read_splits().where("split = 'train'"), features, by), path)

        def apply(path: str, by=by, scaler=scaler) -> None:
            stored = load_scaler(spark, stages.paths[scaler], features, by)
            src.write_splits(scaling.apply_scaler(read_splits(), stored, features, by), path)

        stages.run(scaler, fit, ["splits"], layout=layout)
        stages.run(scaled, apply, ["splits", scaler], layout=layout)
    return stages
