"""Joins whose keys may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_counted(rows: DataFrame, facts: DataFrame, key: str, count: str) -> DataFrame:
    """rows with what facts say of their key, each of which facts hold once and with the number of its rows in `count`.
    Keys of over a thousandth of all rows are broadcast, less than a thousand whatever the input, and their rows stay
    where they are; the others are shuffled. Rows without facts go."""
    most = (facts.agg(F.sum(count)).first()[0] or 0) // 1000
    heavy = F.broadcast(facts.where(F.col(count) > most))
    rest = rows.join(F.broadcast(facts.where(F.col(count) > most).select(key)), key, "left_anti").join(facts.where(F.col(count) <= most), key)
    return rows.join(heavy, key).unionByName(rest)
