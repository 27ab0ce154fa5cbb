"""Results in versions. A pointer file names the version that counts, and what it was made from.

A version is written whole before the pointer changes, and the pointer is replaced by one atomic rename, so a reader finds
the old result or the new one at any time, after any crash. The version before stays, for readers that still hold it."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "CURRENT"


class Stale(RuntimeError):
    """What is there was made from other inputs or with other parameters."""


def _path(spark: SparkSession, at: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def fingerprint(params: dict, *inputs: DataFrame) -> str:
    """A digest of parameters and inputs: of the files that an input reads, their paths, lengths and times; of an input
    without files, its rows, in any order. What an input does with its files must be among the parameters."""
    said: list = [params]
    for df in inputs:
        files = sorted(df.inputFiles())
        if files:
            status = [_path(df.sparkSession, f) for f in files]
            said.append([(f, s.getLen(), s.getModificationTime()) for f, (p, fs) in zip(files, status) for s in [fs.getFileStatus(p)]])
        else:
            h = F.xxhash64(*(F.col(f"`{c}`") for c in df.columns))
            said.append([str(df.schema.simpleString()), *df.agg(F.count("*"), F.bit_xor(h), F.sum(h.cast("decimal(38,0)")).cast("string")).first()])
    return hashlib.sha256(json.dumps(said, sort_keys=True, default=str).encode()).hexdigest()


def current(spark: SparkSession, at: str) -> dict | None:
    """What the pointer at a folder says (version, fingerprint, previous), or None where nothing was published."""
    path, fs = _path(spark, f"{at}/{POINTER}")
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _point(spark: SparkSession, at: str, says: dict) -> None:
    jvm = spark.sparkContext._jvm
    fresh, fs = _path(spark, f"{at}/.{POINTER}-{uuid.uuid4().hex}")
    stream = fs.create(fresh, False)
    stream.write(bytearray(json.dumps(says).encode()))
    stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    qualified = lambda p: fs.makeQualified(_path(spark, p)[0])
    context.rename(qualified(fresh.toString()), qualified(f"{at}/{POINTER}"), how)


def sweep(spark: SparkSession, at: str, age_s: float = 86_400) -> int:
    """Removes versions that neither the pointer nor its predecessor names and that are older than age_s, as crashed runs
    leave them; returns how many."""
    says, (path, fs) = current(spark, at) or {}, _path(spark, at)
    if not fs.exists(path):
        return 0
    keep, gone = {says.get("version"), says.get("previous")}, 0
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        if name.startswith("v-") and name not in keep and status.getModificationTime() < (time.time() - age_s) * 1000:
            gone += fs.delete(status.getPath(), True)
    return gone


def publish(spark: SparkSession, at: str, mark: str, write: Callable[[str], object]) -> str:
    """Runs write(folder of a new version) and lets the pointer name it; returns the folder."""
    version = f"v-{uuid.uuid4().hex}"
    write(f"{at}/{version}")
    before = current(spark, at)
    _point(spark, at, {"version": version, "fingerprint": mark, "previous": before and before["version"]})
    sweep(spark, at)
    return f"{at}/{version}"


def reuse(spark: SparkSession, at: str, mark: str) -> str:
    """The folder of the current version, if it was made from the same inputs with the same parameters."""
    says = current(spark, at)
    if says is None:
        raise FileNotFoundError(f"nothing to reuse at {at}")
    if says["fingerprint"] != mark:
        raise Stale(f"{at} was made from other inputs or with other parameters")
    return f"{at}/{says['version']}"


def made(spark: SparkSession, at: str, mark: str, write: Callable[[str], object]) -> str:
    """The current version if it fits, else a new one."""
    try:
        return reuse(spark, at, mark)
    except (FileNotFoundError, Stale):
        return publish(spark, at, mark, write)
