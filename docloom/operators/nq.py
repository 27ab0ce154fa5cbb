"""Nested question-answer records to flat rows, and HTML fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import squeeze, strip_tags

ANNOTATIONS = "array<struct<long_answer:struct<start_token:int,end_token:int>,short_answers:array<struct<start_token:int,end_token:int>>,yes_no_answer:string>>"


def nested_from_pages(pages: DataFrame) -> DataFrame:
    """Pages in the layout of nested training records, with answers in their first tokens."""
    note = F.expr("array(struct(struct(3 as start_token, 12 as end_token) as long_answer, array(struct(4 as start_token, 6 as end_token)) as short_answers, 'NONE' as yes_no_answer))")
    spaced = F.regexp_replace(F.regexp_replace("html", "<", " <"), ">", "> ")
    return pages.select(F.col("title").alias("question_text"), F.col("page_id").alias("example_id"), squeeze(spaced).alias("document_text"), F.col("url").alias("document_url"), note.cast(ANNOTATIONS).alias("annotations"))


def answer(tokens: Column, span: Column) -> Column:
    """The tokens of a span, without tags and line breaks."""
    part = F.slice(tokens, span["start_token"] + 1, F.greatest(span["end_token"] - span["start_token"], F.lit(0)))
    return F.when(span["start_token"] >= 0, squeeze(F.replace(F.regexp_replace(F.array_join(part, " "), "<[^<]+?>", ""), F.lit("\n"), F.lit("")))).otherwise("")


def between(text: Column, start: str, end: str) -> Column:
    """What stands between the first start tag and the first end tag after it, any case; empty where there is none."""
    return F.regexp_extract(text, f"(?is)<{start}[^>]*>(.*?)</{end}>", 1)


def html_fields(html: Column) -> tuple[Column, Column, Column]:
    """(title, abstract, content): the first heading, the first paragraph, and what follows it up to the last list's end."""
    title = strip_tags(between(html, "h1", "h1"))
    abstract = strip_tags(between(html, "p", "p"))
    rest = F.regexp_extract(html, "(?is)</p>(.*)</ul>", 1)
    return title, abstract, strip_tags(rest)


def flatten_train(raw: DataFrame) -> DataFrame:
    """Ten flat text columns of nested records with document_text."""
    tokens = F.split("document_text", " ")
    first = F.get("annotations", F.lit(0))
    yes_no = first["yes_no_answer"].isin("YES", "NO")
    shorts = F.array_join(F.transform(first["short_answers"], lambda s: answer(tokens, s)), "|")
    title, abstract, content = html_fields(F.col("document_text"))
    rows = raw.select(
        F.col("question_text").alias("query"),
        F.col("example_id").cast("string").alias("id"),
        answer(tokens, first["long_answer"]).alias("long_answer"),
        F.when(yes_no, F.lower(first["yes_no_answer"])).otherwise(F.coalesce(shorts, F.lit(""))).alias("short_answer"),
        title.alias("title"),
        abstract.alias("abstract"),
        content.alias("content"),
        "document_url",
    )
    return rows.withColumn("doc_tac", F.concat("title", "abstract", "content")).withColumn("language", F.lit("en"))


def _plain(c: Column) -> Column:
    """Without tags, line breaks and outer white space."""
    return F.regexp_replace(F.replace(F.regexp_replace(c, "<[^<]+?>", ""), F.lit("\n"), F.lit("")), r"(?U)^\s+|\s+$", "")


def _before_last(c: Column, tag: str) -> Column:
    return F.when(F.contains(c, F.lit(tag)), F.regexp_extract(c, f"(?s)^(.*){tag}", 1)).otherwise(c)


def flatten_dev(raw: DataFrame) -> DataFrame:
    """Ten flat text columns of nested records with document_tokens and document_title.

    Answers are those of the first annotation, or of the next one that has them; without short answers, yes or no. The
    abstract is the first <P>; the content follows it, up to the last </Ul> but one, or the last if there is one only. A
    text without <P> is content from its start."""
    base = raw.withColumn("_text", F.array_join(F.col("document_tokens.token"), " "))
    base = base.withColumn("_words", F.split("_text", " "))
    span = lambda s: F.array_join(F.slice("_words", s["start_token"] + 1, F.greatest(s["end_token"] - s["start_token"], F.lit(0))), " ")
    first = F.get("annotations", F.lit(0))
    longs = F.filter("annotations", lambda a: a["long_answer"]["start_token"] >= 0)
    shorts = F.filter("annotations", lambda a: F.size(a["short_answers"]) > 0)
    told = F.array_join(F.transform(F.get(shorts, F.lit(0))["short_answers"], span), "|")
    short = F.when(F.size(first["short_answers"]) > 0, _plain(told)).when(first["yes_no_answer"] != "NONE", F.lower(first["yes_no_answer"])).otherwise("")
    opened, closed = F.locate("<P>", "_text"), F.locate("</P>", "_text")
    abstract = F.when(opened > 0, F.substring("_text", opened + 3, F.greatest(closed - opened - 3, F.lit(0)))).otherwise("")
    body = _before_last(_before_last(F.col("_text"), "</Ul>"), "</Ul>")
    after = F.when(opened > 0, F.substring(body, closed + 4, F.length("_text"))).otherwise(body)
    rows = base.select(
        F.col("question_text").alias("query"),
        F.col("example_id").cast("string").alias("id"),
        F.when(first["long_answer"]["start_token"] >= 0, _plain(span(F.get(longs, F.lit(0))["long_answer"]))).otherwise("").alias("long_answer"),
        short.alias("short_answer"),
        F.coalesce("document_title", F.lit("")).alias("title"),
        abstract.alias("abstract"),
        F.regexp_replace(_plain(after), " +", " ").alias("content"),
        F.coalesce("document_url", F.lit("")).alias("document_url"),
    )
    return rows.withColumn("doc_tac", F.concat("title", "abstract", "content")).withColumn("language", F.lit("en"))
