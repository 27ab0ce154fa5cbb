"""Numbers in a global order, and which-row-wins rules, without gathering a table in one task."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own only on a single machine, where none is set."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="docloom-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def numbered(df: DataFrame, order: list[Column], name: str, start: int = 0) -> DataFrame:
    """df with the place of each row in the order, from start on. Rows are dealt by ranges, counted a range, and
    numbered within it; only the counts of the ranges meet in one place. Ties must be cut by the order itself."""
    dealt = checkpointed(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.join(offsets, "_part").withColumn(name, F.col("_before") + inside - 1 + start).drop("_part", "_before")


def last_wins(df: DataFrame, key: list[str], order: Column | str) -> DataFrame:
    """Of rows with one key, the one with the greatest order; partial aggregation, no sort. The order must tell rows apart."""
    rest = [c for c in df.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.col(order) if isinstance(order, str) else order).alias("_b")
    return df.groupBy(*key).agg(best).select(*key, "_b.*")


def first_wins(df: DataFrame, key: list[str], order: Column | str) -> DataFrame:
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.col(order) if isinstance(order, str) else order).alias("_b")).select(*key, "_b.*")


def in_order(value: Column | str, order: Column | str) -> Column:
    """Aggregate: an array of values by ascending order."""
    v, o = (F.col(x) if isinstance(x, str) else x for x in (value, order))
    return F.transform(F.array_sort(F.collect_list(F.struct(o.alias("o"), v.alias("v")))), lambda s: s["v"])
