"""A stream that writes each key once, whatever file or run it comes in."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Times keep all their digits on the way through the state.
_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _first(key: tuple, frames, state):
    if state.exists:
        return
    least = None
    for f in frames:
        row = f.sort_values(["_at", "_row"]).iloc[0]
        if least is None or (row["_at"], row["_row"]) < (least["_at"], least["_row"]):
            least = row
    state.update((True,))
    yield pd.DataFrame({"_row": [least["_row"]]})


def append_once(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, key: str, known: DataFrame | None = None, transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """Reads JSON files of a folder that no earlier call has read, and appends as Parquet the rows whose key no earlier
    row had; runs until it has caught up. Of rows with one key that come at once, the one of the file first by time of
    change and name is written, then the least as text. A null key is a key like others.

    The state is one flag a key, by hash of the key, kept with the checkpoint on the shared folder and in RocksDB on
    executors, so that it need not fit in memory. known(key): keys that were written before there was a state. transform is
    applied to the rows that are kept."""
    at = F.concat_ws("|", F.unix_micros("_metadata.file_modification_time").cast("string"), "_metadata.file_path").alias("_at")
    read = spark.readStream.schema(schema).json(source).select("*", at)
    kind = read.drop("_at").schema
    if known is not None:
        seen = known.select(F.col(key).alias("_known")).where("_known is not null").distinct()
        read = read.join(seen, read[key] == seen["_known"], "left_anti")
    packed = read.select(F.col(key).alias("_key"), "_at", F.to_json(F.struct(*(F.col(f"`{c}`") for c in kind.names)), _TIMES).alias("_row"))
    once = packed.groupBy("_key").applyInPandasWithState(_first, "_row string", "seen boolean", "append", "NoTimeout")
    out = transform(once.select(F.from_json("_row", kind, _TIMES).alias("r")).select("r.*"))
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, STORE)
    try:
        out.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink).awaitTermination()
    finally:
        spark.conf.set(provider, before)
