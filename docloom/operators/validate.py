"""Checks: as errors while rows flow, and as tables of what is wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def require(df: DataFrame, ok: Column, message: str) -> DataFrame:
    """df, failing on the first row for which ok is not true."""
    return df.where(F.when(F.coalesce(ok, F.lit(False)), True).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def dependency_violations(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n_values) of keys with several values; empty keys and values do not count."""
    rows = df.where((F.col(key) != "") & (F.col(value) != "")).select(F.col(key).alias("key"), F.col(value).alias("value")).distinct()
    return rows.groupBy("key").agg(F.count("*").alias("n_values")).where("n_values > 1")


def map_stats(df: DataFrame, key: str, target: str) -> DataFrame:
    """One row: rows, rows without key, rows without target, distinct keys, keys with several targets."""
    k, t = F.coalesce(F.col(key), F.lit("")), F.coalesce(F.col(target), F.lit(""))
    rows = df.agg(F.count("*").alias("n_rows"), F.count_if(k == "").alias("missing_key"), F.count_if((k != "") & (t == "")).alias("missing_target"))
    pairs = df.where((k != "") & (t != "")).select(k.alias("k"), t.alias("t")).distinct().groupBy("k").agg(F.count("*").alias("n"))
    return rows.join(F.broadcast(pairs.agg(F.count("*").alias("n_keys"), F.count_if(F.col("n") > 1).alias("n_conflicts"))))


def pair_violations(pairs: DataFrame) -> DataFrame:
    """(query_key, chosen, rejected, reason) of preference pairs(query_key, prompt, chosen, rejected, positives) that break a rule."""
    one = F.min("prompt").over(Window.partitionBy("query_key", "chosen")) == F.max("prompt").over(Window.partitionBy("query_key", "chosen"))
    reason = F.when(F.coalesce(F.col("prompt"), F.lit("")) == "", "no_prompt").when(~one, "several_prompts").when(F.coalesce(F.col("rejected"), F.lit("")) == "", "no_rejected").when(F.array_contains("positives", F.col("rejected")), "rejected_positive").when(F.col("chosen") == F.col("rejected"), "same")
    return pairs.withColumn("reason", reason).where("reason is not null").select("query_key", "chosen", "rejected", "reason")


def unsorted(df: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """Rows of df that stand before their predecessor by the columns; within slices of the order, so nothing is gathered."""
    key = F.struct(*columns)
    before = F.lag(key).over(Window.partitionBy("_slice").orderBy(order))
    sliced = df.withColumn("_slice", F.floor(F.col(order) / 1024))
    inside = sliced.withColumn("_before", before)
    # the last row of each slice goes before the first of the next
    ends = sliced.groupBy((F.col("_slice") + 1).alias("_slice")).agg(F.max_by(key, F.col(order)).alias("_end"))
    joined = inside.join(ends, "_slice", "left").withColumn("_before", F.coalesce("_before", "_end"))
    return joined.where(F.col("_before") > key).drop("_slice", "_before", "_end")


def pair_ids(pairs: DataFrame, role: str) -> DataFrame:
    """pairs with the text id of a role (chosen or rejected) as `<role>_text_id`: that column, or the older `<role>`; a pair
    without either is an error."""
    have = [F.col(c) for c in (f"{role}_text_id", role) if c in pairs.columns]
    named = pairs.withColumn(f"{role}_text_id", F.coalesce(*have, F.lit("")))
    return require(named, F.col(f"{role}_text_id") != "", f"a pair has no {role}_text_id")
