"""Appending what is new: a file stream that runs until it has caught up, and remembers what it has seen."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def append_new(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """Reads JSON files of a folder that no earlier call has read, and appends their transformed rows as Parquet, each once."""
    stream = transform(spark.readStream.schema(schema).json(source))
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink).awaitTermination()
