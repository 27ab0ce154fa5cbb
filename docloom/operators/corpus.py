"""Choosing and splitting a corpus: clicks, term statistics, titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import tokenize
from docloom.operators.bm25 import Tokenizer
from docloom.operators.numbering import first_wins, numbered


def click_counts(docs: DataFrame, clicks: DataFrame) -> DataFrame:
    """(docid, clicks) of every document, 0 included, and of ids that only clicks know."""
    counted = clicks.groupBy("docid").agg(F.count("*").alias("n"))
    return docs.select("docid").join(counted, "docid", "full_outer").select("docid", F.coalesce("n", F.lit(0)).alias("clicks"))


def term_idf(docs: DataFrame, vocab: DataFrame, cut: Tokenizer = tokenize) -> DataFrame:
    """(term, df, idf) of every vocabulary term, ln(n / (df + 1)); docs(docid, title, body)."""
    whole = docs.select(F.concat_ws(" ", "title", "body").alias("text"))
    held = whole.select(F.explode(F.array_distinct(cut("text"))).alias("term"))
    df = held.join(vocab.select("term"), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    total = docs.agg(F.count("*").alias("n"))
    got = vocab.select("term").join(df, "term", "left").join(F.broadcast(total)).withColumn("df", F.coalesce("df", F.lit(0)))
    return got.select("term", "df", F.log(F.col("n") / (F.col("df") + 1)).alias("idf"))


def frequent_terms(docs: DataFrame, size: int, least: int = 20, cut: Tokenizer = tokenize) -> DataFrame:
    """(term, id): the `size` terms that most of docs(docid, body) hold, and at least `least`, with ids from 2 on in their
    own order (0 pads, 1 is the unknown). The vocabulary's size is a parameter."""
    terms = docs.select(F.explode(F.array_distinct(cut("body"))).alias("term")).groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= least)
    best = terms.orderBy(F.desc("df"), "term").limit(size)
    return best.select("term", (F.row_number().over(Window.orderBy("term")) + 1).alias("id"))


def term_tf(docs: DataFrame, first: int = 1024, cut: Tokenizer = tokenize) -> DataFrame:
    """(docid, term, tf): shares of the first tokens of each document."""
    rows = docs.select("docid", F.slice(cut("body"), 1, first).alias("toks")).select("docid", F.size("toks").alias("len"), F.explode("toks").alias("term"))
    return rows.groupBy("docid", "term", "len").agg(F.count("*").alias("n")).select("docid", "term", (F.col("n") / F.col("len")).alias("tf"))


def first_titles(rows: DataFrame, splits: tuple[str, ...]) -> DataFrame:
    """The first row of each title, by split in the given order and position: rows(split, position, title, ...)."""
    rank = F.array_position(F.array(*map(F.lit, splits)), F.col("split"))
    return first_wins(rows.withColumn("_at", F.struct(rank.alias("a"), F.col("position").alias("b"))), ["title"], "_at").drop("_at")


def title_ids(rows: DataFrame) -> DataFrame:
    """(title, title_id): numbers of titles by first appearance, from 0 on; rows(title, position)."""
    firsts = rows.groupBy("title").agg(F.min("position").alias("position"))
    return numbered(firsts, [F.col("position"), F.col("title")], "title_id").select("title", "title_id")


def in_share(key: Column, percent: int, seed: str) -> Column:
    """True for about percent of keys, the same ones always: a hash decides, so a split survives reordering."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), key), 256), 1, 8), 16, 10).cast("long") % 100 < percent
