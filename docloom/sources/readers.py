"""Readers of the file layouts that retrieval data comes in. All go through Spark's readers; gzip goes by suffix.

Where a rule says that the first or the last line wins, a line's place is (file, block, number): files by name,
blocks by their start, and lines as they are read within a block.
"""

from __future__ import annotations

import glob as _glob
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.text import normalize_docid, project_json
from docloom.operators.numbering import last_wins
from docloom.operators.validate import require
from docloom.sources.splitting import json_array, numbered_lines

NQ_COLUMNS = ("query", "id", "long_answer", "short_answer", "title", "abstract", "content", "document_url", "doc_tac", "language")
INSTANCES = "input_ids array<int>, query_id string, doc_id string"
PREFERENCES = "prompt string, chosen string, rejected string"
BLANK = r"\s+"


def resolve(uri: str) -> list[str]:
    """Files of a path, folder, glob or hf:dataset:<name>:<file, folder/ or glob> (below $DOCLOOM_DATASETS), sorted; an error
    if there are none. Paths are looked up where Spark reads them: in the store that their scheme names, or the session's
    own. Without a session, on this machine's disk."""
    if m := re.fullmatch(r"hf:dataset:([^:]+):(.*)", uri):
        uri = os.path.join(os.environ.get("DOCLOOM_DATASETS", "datasets"), m[1], m[2])
    spark = SparkSession.getActiveSession()
    if spark is not None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = []
        for status in fs.globStatus(path) or []:
            if status.isFile():
                found.append(status.getPath().toString())
            else:
                below = [s.getPath() for s in fs.listStatus(status.getPath()) if s.isFile()]
                found += [p.toString() for p in below if p.getName()[0] not in "._"]
    elif os.path.isdir(uri):
        found = [f for f in _glob.glob(os.path.join(uri, "*")) if os.path.isfile(f)]
    else:
        found = _glob.glob(uri)
    if not found:
        raise FileNotFoundError(uri)
    return sorted(found)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, at) of text files."""
    at = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    return spark.read.text(resolve(path)).select(F.col("value").alias("line"), at.alias("at"))


def lines_numbered(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line, path) of text files, numbered from 1 on within each."""
    return numbered_lines(spark, resolve(path))


def _fields(df: DataFrame, pattern: str, limit: int = -1) -> DataFrame:
    return df.withColumn("f", F.split("line", pattern, limit))


def field(i: int):
    return F.get("f", F.lit(i))


def queries_tsv(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(qid, query); the last line of a qid wins. Lines without exactly two fields are skipped, or with strict an error."""
    rows = _fields(lines(spark, path), "\t")
    two = F.size("f") == 2
    rows = require(rows, two, "a queries line has no two fields") if strict else rows.where(two)
    return last_wins(rows.select(field(0).alias("qid"), field(1).alias("query"), "at"), ["qid"], "at").select("qid", "query")


def qrels(spark: SparkSession, path: str, only_relevant: bool = True) -> DataFrame:
    """(qid, docid, rel) of four fields, all positives; with only_relevant those with rel 1."""
    rows = _fields(lines(spark, path), BLANK).where(F.size("f") >= 4)
    got = rows.select(field(0).alias("qid"), field(2).alias("docid"), field(3).alias("rel"))
    return got.where("rel = '1'") if only_relevant else got


def qrels_single(spark: SparkSession, path: str) -> DataFrame:
    """(qid, docid): one positive a query, the last line's."""
    rows = _fields(lines(spark, path), BLANK).where(F.size("f") >= 3)
    return last_wins(rows.select(field(0).alias("qid"), field(2).alias("docid"), "at"), ["qid"], "at").select("qid", "docid")


def run_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) for operators.runs.parse_run."""
    return lines(spark, path).select(F.col("at").alias("line_no"), "line")


def raw_docs(spark: SparkSession, path: str) -> DataFrame:
    """(docid, url, title, body) of tab-separated lines; tabs in the body stay, quotes are text."""
    rows = _fields(lines(spark, path), "\t", 4).where(F.size("f") == 4)
    return rows.select(*(field(i).alias(c) for i, c in enumerate(("docid", "url", "title", "body"))))


def nq_tsv(spark: SparkSession, path: str) -> DataFrame:
    """The ten headerless columns of flattened records; missing values are empty."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in NQ_COLUMNS])
    got = spark.read.schema(schema).option("sep", "\t").csv(resolve(path))
    return got.select(*(F.coalesce(c, F.lit("")).alias(c) for c in NQ_COLUMNS))


def json_records(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Records of files that are one JSON array of objects, or lines of JSON; bad JSON is an error, which names the file.
    Arrays are read in as many tasks as Spark cuts their files into.

    Without a schema each record is a VARIANT column `record`, so that a field may be a scalar here and a list there."""
    files = resolve(path)
    arrays = [f for f in files if _first(spark, f) == "["]
    rest = [f for f in files if f not in arrays]
    read = spark.read.option("mode", "FAILFAST")
    read = read.schema(schema) if schema else read.option("singleVariantColumn", "record")
    parts = []
    if rest:
        parts.append(read.json(rest))
    if arrays:
        whole = json_array(spark, arrays)
        known = F.try_parse_json("text")
        bad = F.raise_error(F.concat(F.lit("bad JSON in "), "path"))
        whole = whole.select(F.when(known.isNotNull(), F.col("text")).otherwise(bad).alias("text"))
        if schema:
            parts.append(whole.select(F.from_json("text", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*"))
        else:
            parts.append(whole.select(F.parse_json("text").alias("record")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _first(spark: SparkSession, path: str) -> str:
    """The first character of a file that is not blank, read by the driver from the file's first bytes, through the
    codec that its suffix asks for."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(conf).open(at)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(at)
    stream = stream if codec is None else codec.createInputStream(stream)
    try:
        while True:
            some = bytes(stream.readNBytes(4096))
            text = some.lstrip(b"\xef\xbb\xbf \t\r\n")
            if text or not some:
                return text[:1].decode("latin-1")
    finally:
        stream.close()


def json_field(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """Rows of the list, or the dict of lists, that stands under a name in JSON files; an error that lists the keys if it is not there."""
    files = resolve(path)
    as_map = spark.read.option("multiLine", True).option("singleVariantColumn", "v").json(files)
    kind = as_map.select(F.schema_of_variant(F.variant_get("v", f"$.{name}", "variant")).alias("s"), F.schema_of_variant("v").alias("whole")).limit(1).first()
    if kind is None or kind.s in (None, "VOID"):
        raise KeyError(f"no field {name} in {path}; it has {kind and kind.whole}")
    text = F.variant_get("v", f"$.{name}", "string")
    if kind.s.startswith("ARRAY"):
        return as_map.select(F.inline(F.from_json(text, f"array<struct<{schema}>>")))
    columns = T.StructType.fromDDL(schema).fields
    lists = F.from_json(text, "struct<" + ", ".join(f"{c.name}: array<{c.dataType.simpleString()}>" for c in columns) + ">")
    return as_map.select(F.inline(F.arrays_zip(*(lists[c.name].alias(c.name) for c in columns))))


def csv_table(spark: SparkSession, path: str, schema: str | None = None, **options) -> DataFrame:
    """CSV with Spark's parse options; no schema means that columns are strings."""
    read = spark.read.options(**{"header": True, **options})
    return (read.schema(schema) if schema else read).csv(resolve(path))


def docid_codes(spark: SparkSession, path: str, drop: tuple[int, ...] = ()) -> DataFrame:
    """(docid in brackets, code array<int>) of docid, tab, comma-separated ids; `drop` leaves tokens out (0 and 1 for NQ)."""
    rows = _fields(lines(spark, path), "\t").where(F.size("f") == 2)
    code = F.transform(F.split(field(1), ","), lambda x: x.cast("int"))
    return rows.select(normalize_docid(field(0)).alias("docid"), (F.filter(code, lambda x: ~x.isin(*drop)) if drop else code).alias("code"))


def embeddings(spark: SparkSession, path: str) -> DataFrame:
    """(docid in brackets, embedding array<float>)."""
    rows = _fields(lines(spark, path), "\t").where(F.size("f") == 2)
    return rows.select(normalize_docid(field(0)).alias("docid"), F.transform(F.split(field(1), ","), lambda x: x.cast("float")).alias("embedding"))


def instances(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INSTANCES).option("mode", "FAILFAST").json(resolve(path))


def preferences(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PREFERENCES).option("mode", "FAILFAST").json(resolve(path))


def pseudo_queries(spark: SparkSession, path: str) -> DataFrame:
    """(docid, query) of tab-separated lines or of JSON lines with doc_id and query."""
    rows = lines(spark, path)
    parsed = F.from_json("line", "doc_id string, query string")
    is_json = F.ltrim("line").startswith("{")
    tab = F.split("line", "\t", 2)
    return rows.select(F.when(is_json, parsed["doc_id"]).otherwise(F.get(tab, F.lit(0))).alias("docid"), F.when(is_json, parsed["query"]).otherwise(F.get(tab, F.lit(1))).alias("query")).where("docid is not null and query is not null")


def excluded_ids(spark: SparkSession, path: str) -> DataFrame:
    """(id) of a JSON list of ids, or of a manifest whose excluded_text_ids and model_mining_excluded_text_ids hold them."""
    whole = spark.read.option("multiLine", True).option("singleVariantColumn", "v").json(resolve(path))
    plain = F.from_json(F.to_json("v"), "array<string>")
    parts = F.from_json(F.to_json("v"), "excluded_text_ids array<string>, model_mining_excluded_text_ids array<string>")
    none = F.array().cast("array<string>")
    ids = F.when(F.schema_of_variant("v").startswith("ARRAY"), plain).otherwise(F.concat(F.coalesce(parts["excluded_text_ids"], none), F.coalesce(parts["model_mining_excluded_text_ids"], none)))
    return whole.select(F.explode(ids).alias("id")).distinct()


def json_projected(spark: SparkSession, path: str, names: dict[str, str]) -> DataFrame:
    """Fields of JSON lines under new names, as strings; lines that are no JSON or lack a field are skipped."""
    there, fields = project_json(F.col("line"), names)
    return lines(spark, path).where(there).select(*fields)


def embedding_docs(spark: SparkSession, path: str, nq: bool = False) -> DataFrame:
    """(docid, text) to embed: JSON lines with docid, in lower case, and body, or flattened records with their doc_tac."""
    if nq:
        return nq_tsv(spark, path).select(F.col("id").alias("docid"), F.col("doc_tac").alias("text"))
    return json_records(spark, path, "docid string, body string").select(F.lower("docid").alias("docid"), F.col("body").alias("text"))
