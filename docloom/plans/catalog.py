"""Every query of the library by name, and the SQL that must agree with it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docloom.plans.registry import ORACLES, QUERIES

MODULES = ("scans", "projections", "retrieval", "corpus", "docids", "instances", "positives", "mining", "hybrid", "decoding", "indexing")


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"docloom.plans.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return ORACLES
