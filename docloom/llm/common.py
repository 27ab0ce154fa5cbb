"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space and 0x09-0x0D, as bytes.split() and str.count() see them.
SPACES = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a local one only on a single machine, where that is unset (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="docloom-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Removes a table that materialise() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(f).getParent()
        if path.getName().startswith("docloom-"):
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id long, text string), so that other columns, whatever their names, neither clash nor are read."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """Zero-copy slices of a batch whose strings (or binaries) in column hold about `most` bytes at most, one row at least."""
    n = batch.num_rows
    if not n:
        return
    size = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
    start, held = 0, 0
    for i, x in enumerate(size):
        if i > start and held + x > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += x
    yield batch.slice(start, n - start)


def join_counted(rows: DataFrame, facts: DataFrame, key: str, count: str) -> DataFrame:
    """rows with what facts say of their key, each of which facts hold once and with the number of its rows in `count`.
    Keys of over a thousandth of all rows are broadcast, less than a thousand whatever the input; the others are shuffled."""
    most = (facts.agg(F.sum(count)).first()[0] or 0) // 1000
    heavy = F.broadcast(facts.where(F.col(count) > most))
    rest = rows.join(F.broadcast(facts.where(F.col(count) > most).select(key)), key, "left_anti").join(facts.where(F.col(count) <= most), key)
    return rows.join(heavy, key).unionByName(rest)
