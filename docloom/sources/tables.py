"""Tables that training and evaluation start from: preference splits, CSV splits, documents, join keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.operators.corpus import in_share
from docloom.operators.resolve import clean_preferences
from docloom.sources.readers import json_records, lines_numbered, resolve

SIDES = ("prompt", "chosen", "rejected")


def renamed_preferences(rows: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """(prompt, chosen, rejected) of rows whose columns go by other names; names: ours to theirs."""
    return rows.select(*(F.col(f"`{(names or {}).get(c, c)}`").cast("string").alias(c) for c in SIDES))


def preference_splits(spark: SparkSession, train: str, evaluation: str | None = None, percent: int = 0, seed: str = "42", names: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """train and, from its own file or as a share of train, validation: clean preferences (prompt, chosen, rejected) of
    JSON files. The share is chosen by a hash of the row, so equal rows stay together. A split without a row is an error."""

    def read(path: str) -> DataFrame:
        theirs = [(names or {}).get(c, c) for c in SIDES]
        raw = json_records(spark, path, ", ".join(f"`{c}` string" for c in theirs))
        return clean_preferences(renamed_preferences(raw, names), [])

    out = {"train": read(train)}
    if evaluation:
        out["validation"] = read(evaluation)
    elif percent:
        aside = in_share(F.concat_ws("\x1f", *SIDES), percent, seed)
        out = {"train": out["train"].where(~aside), "validation": out["train"].where(aside)}
    for name, df in out.items():
        if df.isEmpty():
            raise ValueError(f"no valid preference is left in {name}")
    return out


def _typed(text: Column, kind: T.DataType, thousands: str, decimal: str, true: tuple[str, ...], false: tuple[str, ...]) -> Column:
    if isinstance(kind, T.BooleanType) and (true or false):
        return F.when(text.isin(*true), True).when(text.isin(*false), False).otherwise(text.cast("boolean"))
    if isinstance(kind, T.NumericType):
        plain = F.replace(text, F.lit(thousands), F.lit("")) if thousands else text
        text = F.replace(plain, F.lit(decimal), F.lit(".")) if decimal != "." else plain
    return text.cast(kind)


def csv_splits(
    spark: SparkSession, files: str | list[str] | dict[str, str | list[str]], schema: str | None = None, sep: str = ",", header: bool = True, names: list[str] | None = None, only: list[str] | None = None, nulls: tuple[str, ...] = ("",), true: tuple[str, ...] = (), false: tuple[str, ...] = (), thousands: str = "", decimal: str = ".", skip: int = 0, most: int | None = None, quote: str = '"', escape: str = '"', comment: str = "", encoding: str = "UTF-8", multiline: bool = False,
) -> dict[str, DataFrame]:
    """A table a split of CSV files; a path or a list of them is the split train.

    names stand for the header, or are the columns where there is none; only: the columns to keep; schema: kinds of
    columns, text where it says nothing; nulls, true and false: texts that stand for those; skip: lines of each file to
    leave out before the header, most: rows of each file to read after it (rows are lines then). A header line is left out
    of every file."""
    if not files:
        raise ValueError("no files")
    kinds = {f.name: f.dataType for f in T.StructType.fromDDL(schema).fields} if schema else {}
    options = {"sep": sep, "quote": quote, "escape": escape, "encoding": encoding, "multiLine": multiline, "mode": "PERMISSIVE", **({"comment": comment} if comment else {})}
    by_line = bool(skip or most is not None)

    def read(path: str) -> DataFrame:
        if not by_line:
            raw = spark.read.options(header=header, enforceSchema=True, **options)
            found = spark.read.options(header=header, **options).csv(resolve(path)).columns
            columns = names or found
            return raw.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns])).csv(resolve(path))
        rows = lines_numbered(spark, path).where(F.col("line_no") > skip)
        first = rows.where(F.col("line_no") == skip + 1).select("line").first()
        if first is None:
            raise ValueError(f"{path} has no lines after {skip}")
        said = spark.createDataFrame([(first.line,)], "line string").select(F.from_csv("line", F.lit(", ".join(f"_{i} string" for i in range(first.line.count(sep) + 1))), options).alias("r")).select("r.*").first()
        columns = names or ([c for c in said if c is not None] if header else [f"_c{i}" for i, c in enumerate(said)])
        rows = rows.where(F.col("line_no") > skip + header) if header else rows
        if most is not None:
            rows = rows.where(F.col("line_no") <= skip + header + most)
        kept = rows.where(F.length("line") > 0)
        if comment:
            kept = kept.where(~F.col("line").startswith(comment))
        kind = ", ".join(f"`{c}` string" for c in columns)
        return kept.select(F.from_csv("line", F.lit(kind), options).alias("r")).select("r.*")

    def table(paths: str | list[str]) -> DataFrame:
        got = reduce(DataFrame.unionByName, (read(p) for p in ([paths] if isinstance(paths, str) else paths)))
        out = []
        for c in only or got.columns:
            text = F.when(~F.col(f"`{c}`").isin(*nulls), F.col(f"`{c}`")) if nulls else F.col(f"`{c}`")
            out.append(_typed(text, kinds.get(c, T.StringType()), thousands, decimal, true, false).alias(c))
        return got.select(*out)

    return {name: table(paths) for name, paths in (files if isinstance(files, dict) else {"train": files}).items()}


def filled(rows: DataFrame, *columns: str) -> DataFrame:
    """rows with columns as text, where null and not-a-number are empty."""

    def plain(c: str) -> Column:
        kind = rows.schema[c].dataType
        known = F.when(~F.isnan(c), F.col(c)) if isinstance(kind, (T.FloatType, T.DoubleType)) else F.col(c)
        return F.coalesce(known.cast("string"), F.lit(""))

    return rows.withColumns({c: plain(c) for c in columns})


def contents(spark: SparkSession, path: str) -> DataFrame:
    """(id, contents) of JSON files, empty where a field is missing or null."""
    return filled(json_records(spark, path, "id string, contents string"), "id", "contents")


def query_doc_pairs(rows: DataFrame, id_: str = "id", query: str = "query", doc: str = "doc") -> DataFrame:
    """(id, query, doc) of a table, empty where null."""
    return filled(rows.select(F.col(id_).alias("id"), F.col(query).alias("query"), F.col(doc).alias("doc")), "id", "query", "doc")


def join_value(rows: DataFrame, key: str) -> Column:
    """What rows are joined by, as trimmed text, empty where it is null. For url_based_id, rows that lack the column go by
    url_id; an alias never stands in for a value that is there and null."""
    names = [key, "url_id"] if key == "url_based_id" else [key]
    found = next((c for c in names if c in rows.columns), None)
    return F.lit("") if found is None else F.trim(F.coalesce(F.col(f"`{found}`").cast("string"), F.lit("")))
