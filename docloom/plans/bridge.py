"""Logical tables (documents, queries, judgements, runs, ...) over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import bm25
from docloom.operators.numbering import checkpointed


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("docid"), "doc_id", F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("body"), "lang", "source")


def queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.concat(F.lit("q"), "item_id").alias("qid"), "item_id", F.col("text").alias("query"))


def qrels(spark: SparkSession, d: str) -> DataFrame:
    """A document is relevant to a query if it holds 60 characters of it. The second to fourth of the passage's words,
    whole in any text that holds it, are the key of a hash join; passages of fewer than five words are looked for as they are.
    Searched once and written, as metrics read it three times."""
    q = queries(spark, d).select("qid", F.substring("query", 10, 60).alias("passage")).withColumn("w", F.split("passage", " "))
    held = docs(spark, d).select("docid", "body")
    short = q.where("size(w) < 5").select("qid", "passage")
    keyed = q.where("size(w) >= 5").select("qid", "passage", F.array_join(F.slice("w", 2, 3), " ").alias("key"))
    n = F.size("w")
    three = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.concat_ws(" ", F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    keys = held.withColumn("w", F.split("body", " ")).where("size(w) >= 3").select("docid", "body", F.explode(F.array_distinct(three)).alias("key"))
    got = keys.join(keyed, "key").where(F.contains("body", "passage")).select("qid", "docid")
    if not short.isEmpty():
        got = got.unionByName(held.join(short, F.contains("body", "passage")).select("qid", "docid"))
    return checkpointed(got.select("qid", "docid", F.lit(1).alias("rel")))


def pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select(F.concat(F.lit("p"), "page_id").alias("docid"), "page_id", "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), "html")


def clicks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("qid"), F.concat(F.lit("part"), "l_partkey").alias("docid"), F.col("l_linenumber").alias("n"))


def shelf(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.concat(F.lit("part"), "p_partkey").alias("docid"), "p_partkey", F.col("p_name").alias("title"), F.col("p_brand").alias("brand"))


def run(spark: SparkSession, d: str, k: int = 200, k1: float = 0.82, b: float = 0.68) -> DataFrame:
    """BM25 run of the queries over the documents: (qid, docid, rank, score), searched once and written, as most read it twice."""
    return checkpointed(bm25.top_k(queries(spark, d), docs(spark, d).select("docid", F.col("body").alias("contents")), k, k1, b))


def originals(spark: SparkSession, d: str) -> DataFrame:
    """Code documents with their own query: first line the query, the rest the code."""
    first = F.substring_index("text", "\n", 1)
    rest = F.expr("substring(text, length(substring_index(text, '\n', 1)) + 2)")
    path = F.concat_ws("/", "source", "lang")
    return table(spark, d, "documents").select(
        "doc_id",
        F.concat(F.lit("d"), "doc_id").alias("text_id"),
        F.col("doc_id").cast("string").alias("numeric_id"),
        F.concat_ws("/", path, "doc_id").alias("url"),
        F.concat_ws("/", path, (F.col("doc_id") % 50).cast("string")).alias("structure"),
        F.col("source").alias("repo"),
        F.concat(path, F.lit(".rb")).alias("path"),
        F.concat(F.lit("f"), F.col("doc_id") % 13).alias("identifier"),
        F.col("lang").alias("language"),
        F.concat(F.lit("Query: "), first).alias("query_text"),
        F.concat(F.lit("Code: "), F.when(rest == "", "pass").otherwise(rest)).alias("code_text"),
    )


def augment(spark: SparkSession, d: str) -> DataFrame:
    """Augmented queries: the last line of each document, with ids of which some are missing."""
    n = F.col("doc_id")
    url = F.concat_ws("/", "source", "lang", "doc_id")
    return table(spark, d, "documents").select(n.alias("row_no"), n.cast("string").alias("raw_id"), F.when(n % 5 == 0, "").otherwise(n.cast("string")).alias("numeric_id"), F.when(n % 3 == 0, "").otherwise(url).alias("url"), F.substring_index("text", "\n", -1).alias("text"))


def codes(spark: SparkSession, d: str) -> DataFrame:
    """Document codes of three tokens, many of them shared."""
    return table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("docid"), F.array((F.substring("source", 4, 9).cast("int") + 2), (F.length("lang") + F.ascii("lang") % 5).cast("int"), (F.col("doc_id") % 7).cast("int")).alias("code"))
