"""Session helpers: local sessions for tests and the shared scratch folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", name: str = "fleetlens") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    partitions = os.cpu_count() if cores == "*" else int(cores)
    # Python workers find the package where this process found it.
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        os.environ["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("FLEETLENS_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    ``spark.checkpoint.dir`` wins; a local folder is made only where the
    setting is absent and the master is this machine alone, as in tests.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not configured:
        current = context._jsc.sc().getCheckpointDir()
        if not current.isDefined() and not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = current.get() if current.isDefined() else tempfile.mkdtemp(prefix="fleetlens-")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a stage's result to the shared folder and go on from the written table.

    Later passes then read the stored columns they need instead of repeating
    the stage, and a lost executor costs one file read.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.partitionBy(*(partition_by or [])).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-repartition a scan that has fewer splits than the cluster has cores.

    A table of normal size has more splits than cores and passes unshuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)


def ship_package(spark: SparkSession) -> str:
    """Sends this package to the executors, for clusters on which it is not installed; returns the archive."""
    package = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(
        os.path.join(tempfile.mkdtemp(prefix="fleetlens-"), "fleetlens"), "zip", os.path.dirname(package), os.path.basename(package)
    )
    spark.sparkContext.addPyFile(archive)
    return archive
