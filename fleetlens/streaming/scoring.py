"""Scoring of newly arriving files with the plan that scores stored ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from fleetlens.session import scratch_path


def stream_score(
    spark: SparkSession,
    source: str,
    schema,
    score: Callable[[DataFrame], DataFrame],
    sink: str,
    checkpoint: str | None = None,
    *,
    max_files: int | None = None,
) -> StreamingQuery:
    """Starts a query that scores every file now present below ``source`` and stops.

    ``score`` is a stateless DataFrame function; the checkpoint makes a restarted
    query take up only files it has not finished.
    """
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return (
        score(reader.parquet(source))
        .writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint or scratch_path(spark, "stream-checkpoint"))
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
