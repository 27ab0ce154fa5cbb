"""Training instances: passages, sampled terms, queries with the codes of their documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import sentences, tokenize
from docloom.operators.bm25 import Tokenizer
from docloom.operators.numbering import in_order

END = "</s>"


def _ended(tokens: Column, longest: int) -> Column:
    return F.concat(F.slice(tokens, 1, longest - 1), F.array(F.lit(END)))


def _cut_sentences(docs: DataFrame, cut: Tokenizer) -> DataFrame:
    """(docid, title, sents): the tokens of the title and of each sentence that has any. The default tokenizer works within
    the row; another one, which may be a pandas UDF, gets the sentences as rows, which docid brings together again."""
    none = F.array().cast("array<array<string>>")
    if cut is tokenize:
        return docs.select("docid", tokenize("title").alias("title"), F.filter(F.transform(sentences("body"), lambda s: tokenize(s)), lambda t: F.size(t) > 0).alias("sents"))
    each = docs.select("docid", F.posexplode(sentences("body")).alias("i", "sentence")).select("docid", "i", cut("sentence").alias("toks"))
    own = each.where(F.size("toks") > 0).groupBy("docid").agg(in_order("toks", "i").alias("sents"))
    whole = docs.select("docid", cut("title").alias("title"), F.col("body").isNull().alias("no_body"))
    return whole.join(own, "docid", "left").select("docid", "title", F.when(~F.col("no_body"), F.coalesce("sents", none)).alias("sents"))


def passages(docs: DataFrame, longest: int = 64, most: int = 3, cut: Tokenizer = tokenize) -> DataFrame:
    """(docid, n, tokens) of docs(docid, title, body): whole sentences behind the title until a passage is full, the
    one that overflows included and cut; `most` passages a document. Sentences without tokens say nothing.

    A fold over each document's sentences; nothing leaves the row."""
    base = _cut_sentences(docs, cut)
    none = F.array().cast("array<array<string>>")
    start = F.struct(F.col("title").alias("cur"), none.alias("out"), F.lit(False).alias("open"))

    def step(acc: Column, sent: Column) -> Column:
        cur = F.concat(acc["cur"], sent)
        full = F.size(cur) >= longest - 1
        done = F.size(acc["out"]) >= most
        return F.when(done, acc).otherwise(
            F.struct(F.when(full, F.col("title")).otherwise(cur).alias("cur"), F.when(full, F.concat(acc["out"], F.array(_ended(cur, longest)))).otherwise(acc["out"]).alias("out"), (~full).alias("open"))
        )

    finish = lambda acc: F.when(acc["open"] & (F.size(acc["out"]) < most), F.concat(acc["out"], F.array(_ended(acc["cur"], longest)))).otherwise(acc["out"])
    return base.select("docid", F.posexplode(F.aggregate("sents", start, step, finish)).alias("n", "tokens"))


def sampled_terms(docs: DataFrame, idf: DataFrame, longest: int = 64, first: int = 1024, least: int = 10, cut: Tokenizer = tokenize) -> DataFrame:
    """(docid, tokens) of docs(docid, title, body): among the first tokens of title and body, occurrences of a document's best terms by tf-idf, in text order. The threshold is the score of
    the (longest - 1)-th best occurrence; documents with fewer than `least` known occurrences, or with one distinct
    term left, have none."""
    whole = docs.select("docid", F.concat_ws(" ", "title", "body").alias("text"))
    occurrences = whole.select("docid", F.slice(cut("text"), 1, first).alias("toks")).select("docid", F.size("toks").alias("len"), F.posexplode("toks").alias("pos", "term")).join(idf.select("term", "idf"), "term")
    per_term = occurrences.groupBy("docid", "term", "len", "idf").agg(F.collect_list("pos").alias("places"))
    scored = per_term.withColumn("score", F.round(F.size("places") / F.col("len") * F.col("idf"), 9))
    # the occurrences of a document are at most `first`: one row a document
    own = scored.groupBy("docid").agg(F.flatten(F.collect_list(F.transform("places", lambda p: F.struct(F.col("score").alias("score"), p.alias("pos"), F.col("term").alias("term"))))).alias("occ"))
    n = F.size("occ")
    ranked = F.sort_array(F.transform("occ", lambda o: o["score"]), asc=False)
    threshold = F.get(ranked, F.least(F.lit(longest - 1), n) - 1)
    # bound once a row by the outer lambda: named in the filter itself it would be sorted out anew for each occurrence
    best = F.get(F.transform(F.array(threshold), lambda t: F.filter("occ", lambda o: o["score"] >= t)), F.lit(0))
    own = own.where(n >= least).withColumn("best", best)
    kept = F.transform(F.array_sort(F.transform("best", lambda o: F.struct(o["pos"].alias("pos"), o["term"].alias("term")))), lambda o: o["term"])
    return own.withColumn("kept", kept).where(F.size(F.array_distinct("kept")) >= 2).select("docid", _ended(F.col("kept"), longest).alias("tokens"))


def query_instances(qrels: DataFrame, queries: DataFrame, codes: DataFrame, strict: bool = True) -> DataFrame:
    """(docid, qid, query, code) of judged queries whose document has a code. strict: a judged query without text is an error."""
    got = qrels.select("qid", "docid").join(queries.select("qid", "query"), "qid", "left" if strict else "inner")
    if strict:
        got = got.withColumn("query", F.when(F.col("query").isNull(), F.raise_error(F.concat(F.lit("no text for query "), "qid"))).otherwise(F.col("query")))
    return got.join(codes, "docid").select("docid", "qid", "query", "code")


def recoded(source: DataFrame, labels: DataFrame) -> DataFrame:
    """(docid, source_code, label_code) of two code tables(docid, code)."""
    return source.withColumnRenamed("code", "source_code").join(labels.withColumnRenamed("code", "label_code"), "docid")


def first_per_group(rows: DataFrame, group: str, order: str, most: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("_n") <= most).drop("_n")
