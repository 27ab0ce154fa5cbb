"""Retrieval runs: layouts, bands, implicit ranks, contiguity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: MS MARCO sampling bands (fixed values): name, first and last rank.
MSMARCO_BANDS = (("top", 1, 100), ("mid", 101, 500), ("low", 501, 1000))


def band_of(rank: Column, bands=MSMARCO_BANDS) -> Column:
    """Name of the band that holds a rank, null outside all of them."""
    out = None
    for name, lo, hi in bands:
        inside = rank.between(lo, hi)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out


def parse_run(lines: DataFrame) -> DataFrame:
    """(qid, docid, rank, score, layout) of lines(line_no, line) in any of three layouts.

    Six fields with Q0 second are TREC; else a whole third field is a rank (score null), any other a score, with the
    place among the query's lines as rank. A document's first line in a query wins; later ones still take up a place."""
    f = F.split(F.regexp_replace("line", r"^\s+|\s+$", ""), r"\s+")
    got = lines.where(F.trim("line") != "").select("line_no", f.alias("f"))
    trec = (F.size("f") >= 6) & (F.get("f", F.lit(1)) == "Q0")
    third = F.get("f", F.lit(2))
    whole = third.try_cast("int")
    layout = F.when(trec, "trec").when(F.size("f") < 3, F.raise_error(F.lit("a run line has fewer than three fields"))).when(whole.isNotNull(), "rank").otherwise("score")
    got = got.withColumn("layout", layout).withColumn("qid", F.get("f", F.lit(0)))
    got = got.withColumn("docid", F.when(F.col("layout") == "trec", third).otherwise(F.get("f", F.lit(1))))
    place = F.row_number().over(Window.partitionBy("qid").orderBy("line_no"))
    rank = F.when(F.col("layout") == "trec", F.get("f", F.lit(3)).try_cast("int")).when(F.col("layout") == "rank", whole).otherwise(place)
    score = F.when(F.col("layout") == "trec", F.get("f", F.lit(4)).try_cast("double")).when(F.col("layout") == "score", third.try_cast("double"))
    got = got.withColumn("rank", rank).withColumn("score", score)
    first = F.row_number().over(Window.partitionBy("qid", "docid").orderBy("line_no"))
    return got.withColumn("_n", first).where("_n = 1").select("qid", "docid", "rank", "score", "layout")


def implicit_rank(rows: DataFrame) -> DataFrame:
    """rows(qid, docid, line_no) with rank, their place in the query."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("line_no")))


def noncontiguous(lines: DataFrame) -> DataFrame:
    """qids of lines(line_no, qid) whose lines do not stand together: (qid, n_islands)."""
    # a query stands together if its lines' numbers span no more than their count
    got = lines.groupBy("qid").agg(F.count("*").alias("n"), (F.max("line_no") - F.min("line_no") + 1).alias("span"))
    broken = got.where("span > n").select("qid")
    own = lines.join(broken, "qid", "left_semi").withColumn("_r", F.row_number().over(Window.partitionBy("qid").orderBy("line_no")))
    return own.groupBy("qid", (F.col("line_no") - F.col("_r")).alias("_i")).agg(F.lit(1)).groupBy("qid").agg(F.count("*").alias("n_islands"))


def minus_positives(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Hits of judged queries that are no positives of theirs."""
    judged = qrels.select("qid").distinct()
    return run.join(judged, "qid", "left_semi").join(qrels.select("qid", "docid").distinct(), ["qid", "docid"], "left_anti")
