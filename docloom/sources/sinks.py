"""Writers. Spark's committer publishes a folder of parts at once; nothing is visible before that."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from docloom.operators.numbering import numbered


def jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> int:
    """JSON lines; returns how many, counted while they were written."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).option("ignoreNullFields", False).json(path)
    return seen.get["n"]


def tsv(df: DataFrame, path: str, gzip: bool = False, mode: str = "overwrite") -> None:
    """Tab-separated text without header or quotes; tabs and line breaks in values become blanks."""
    flat = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), "[\t\r\n]+", " ") for c in df.columns]
    text = df.select(F.concat_ws("\t", *flat).alias("value"))
    (text.write.mode(mode).option("compression", "gzip" if gzip else "none")).text(path)


def json_array(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON array, an element a line. It is one file by its format, so one task writes it; use jsonl() for large tables."""
    rows = df.select(F.to_json(F.struct(*df.columns)).alias("v"))
    joined = rows.agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list("v"), ",\n"), F.lit("\n]")).alias("value"))
    joined.coalesce(1).write.mode(mode).text(path)


def triples(df: DataFrame, path: str, columns: tuple[str, ...] = ("qid", "pos", "neg")) -> None:
    tsv(df.select(*columns), path)


def stats(df: DataFrame, path: str) -> None:
    """A one-row table as one JSON object."""
    df.coalesce(1).write.mode("overwrite").json(path)


def resume(df: DataFrame, path: str, key: str) -> int:
    """Appends the rows of df whose key is not at path yet; returns how many."""
    spark = df.sparkSession
    try:
        done = spark.read.json(path).select(key).distinct()
        df = df.join(done, key, "left_anti")
    except Exception as e:  # nothing written yet
        if "PATH_NOT_FOUND" not in str(e) and "UNRESOLVED_COLUMN" not in str(e):
            raise
    return jsonl(df, path, "append")


def split_by(df: DataFrame, ok) -> tuple[DataFrame, DataFrame]:
    """(rows for which ok holds, the others), nulls among the others."""
    sure = F.coalesce(ok, F.lit(False))
    return df.where(sure), df.where(~sure)


def listed(df: DataFrame, path: str, gzip: bool = False) -> None:
    """(id, array) rows as id, tab, values joined by commas: tables of codes and of embeddings."""
    name, values = df.columns
    tsv(df.select(name, F.array_join(F.col(values).cast("array<string>"), ",").alias(values)), path, gzip)


def csv(df: DataFrame, path: str) -> None:
    """A small table, such as metrics or p-values, as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def published(spark: SparkSession, path: str, write: Callable[[str], object]) -> None:
    """Runs write(folder beside path) and then puts that folder at path. What stood there is kept until the new result is
    whole, and stays if writing fails."""
    jvm = spark.sparkContext._jvm
    at, mark = jvm.org.apache.hadoop.fs.Path(path), uuid.uuid4().hex
    fresh, old = (jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{at.getName()}.{kind}-{mark}") for kind in ("new", "old"))
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        write(fresh.toString())
        had = fs.exists(at)
        if had and not fs.rename(at, old):
            raise OSError(f"cannot move {path} away")
        if not fs.rename(fresh, at):
            if had:
                fs.rename(old, at)
            raise OSError(f"cannot move the new result to {path}")
        fs.delete(old, True)
    finally:
        fs.delete(fresh, True)


def retrieval_layout(docs: DataFrame, queries: DataFrame, truth: DataFrame, folder: str) -> None:
    """A corpus as JSON lines (id, contents), queries as qid and text, judgements as qid, 0, docid, 1, below one folder:
    docs(docid, contents), queries(qid, query), truth(qid, docid)."""
    jsonl(docs.select(F.col("docid").alias("id"), "contents"), f"{folder}/corpus")
    tsv(queries.select("qid", "query"), f"{folder}/queries")
    tsv(truth.select("qid", F.lit(0).alias("zero"), "docid", F.lit(1).alias("rel")), f"{folder}/qrels")


def embedding_matrix(vectors: DataFrame, path: str) -> int:
    """Rows of a matrix as Parquet (row, docid, embedding), numbered from 0 on in order of docid, for vectors(docid,
    embedding); returns how many rows. Vectors must have one width."""
    widths = vectors.agg(F.min(F.size("embedding")), F.max(F.size("embedding")), F.count_if(F.col("embedding").isNull()), F.count("*")).first()
    if widths[2] or widths[0] != widths[1]:
        raise ValueError(f"vectors of widths {widths[0]} to {widths[1]}, {widths[2]} null")
    numbered(vectors.select("docid", "embedding"), [F.col("docid")], "row").select("row", "docid", "embedding").write.mode("overwrite").parquet(path)
    return widths[3]
