"""Targets of documents and queries: which id a row means, what a document is called, what a code stands for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import clean_code


def document_targets(rows: DataFrame) -> DataFrame:
    """(text_id, kind, target): what a decoder may call a document, by namespace. Null means that a field is missing,
    and only then the next one is asked; an empty field is an empty answer. Several ids are joined by a blank."""
    one = lambda c: F.when(F.col(c).isNotNull(), F.array(F.col(c)))
    url = F.coalesce(F.col("url_based_ids"), one("url_based_id"), one("url_id"))
    structure = F.coalesce(F.col("structure_ids"), one("structure_id"))
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.array_join(v, " ").alias("target")) for k, v in (("text_id", F.array("text_id")), ("url", url), ("structure", structure))))
    return rows.select("text_id", F.inline(kinds))


def targets(rows: DataFrame, known: DataFrame, mode: str = "auto", as_text: Column | None = None) -> DataFrame:
    """rows(raw_id, numeric_id, url, ...) with target and how it was found among known(text_id, numeric_id, url). as_text
    is the raw id in the form of text ids, if that is another.

    auto: the numeric id, else the raw id read as numeric, else the raw id as a text id that is known. numeric_id: the
    first two. text_id: a known numeric id still wins, else the raw id whether known or not. url: the URL alone."""
    as_text = F.col("raw_id") if as_text is None else as_text
    by_numeric = known.select(F.col("numeric_id").alias("_k1"), F.col("text_id").alias("_numeric"))
    by_raw = known.select(F.col("numeric_id").alias("_k2"), F.col("text_id").alias("_raw"))
    by_url = known.select(F.col("url").alias("_k3"), F.col("text_id").alias("_url"))
    by_text = known.select(F.col("text_id").alias("_k4"), F.col("text_id").alias("_text"))
    use = {"auto": ("numeric", "raw", "text"), "numeric_id": ("numeric", "raw"), "text_id": ("numeric",), "url": ("url",)}[mode]
    got = rows
    if "numeric" in use:
        got = got.join(by_numeric, (F.col("numeric_id") != "") & (F.col("numeric_id") == F.col("_k1")), "left")
    if "raw" in use:
        got = got.join(by_raw, F.col("raw_id") == F.col("_k2"), "left")
    if "text" in use:
        got = got.join(by_text, as_text == F.col("_k4"), "left")
    if "url" in use:
        got = got.join(by_url, (F.col("url") != "") & (F.col("url") == F.col("_k3")), "left")
    names = {"numeric": "numeric_id", "raw": "raw_numeric", "text": "text_id", "url": "url"}
    found = [F.col(f"_{u}") for u in use]
    how = None
    for u in use:
        how = F.when(F.col(f"_{u}").isNotNull(), names[u]) if how is None else how.when(F.col(f"_{u}").isNotNull(), names[u])
    if mode == "text_id":
        found.append(as_text)
        how = how.otherwise("text_id")
    else:
        how = how.otherwise("none")
    return got.select(*rows.columns, F.coalesce(*found).alias("target"), how.alias("how"))


def clean_preferences(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Rows whose trimmed prompt, chosen and rejected all say something, and differ."""
    trimmed = rows.select(*keep, *(F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in ("prompt", "chosen", "rejected")))
    return trimmed.where("prompt <> '' and chosen <> '' and rejected <> '' and chosen <> rejected")


def preference_stats(rows: DataFrame) -> DataFrame:
    t = [F.trim(F.coalesce(F.col(c), F.lit(""))) for c in ("prompt", "chosen", "rejected")]
    ok = (t[0] != "") & (t[1] != "") & (t[2] != "") & (t[1] != t[2])
    return rows.agg(F.count("*").alias("n_rows"), F.count_if(ok).alias("kept"), F.count_if(~ok).alias("dropped"))


def code_contents(rows: DataFrame, order: str, metadata: bool = True) -> DataFrame:
    """(text_id, contents, n): searchable text of each document from its rows in order: a block of metadata and the
    code of each, repeated sections once, a blank line between."""
    spaced = lambda c: F.replace(F.col(c), F.lit("/"), F.lit(" "))
    said = lambda c: F.when(c != "", c)
    meta = F.concat_ws("\n", said(F.col("repo")), said(spaced("path")), said(F.col("identifier")), said(F.array_join("params", " ")), said(spaced("url"))) if metadata else F.lit("")
    sections = F.array(F.struct(F.lit(0).alias("part"), meta.alias("section")), F.struct(F.lit(1).alias("part"), clean_code("code_text").alias("section")))
    cut = rows.select("text_id", order, F.inline(sections)).where((F.col("part") == 1) | (F.col("section") != ""))
    first = cut.groupBy("text_id", "section").agg(F.min(F.struct(order, "part")).alias("at"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "section"))), lambda s: s["section"]), "\n\n")
    return first.groupBy("text_id").agg(joined.alias("contents"), F.count("*").alias("n"))


def tokens_to_ids(tokens: DataFrame, vocab: DataFrame, unknown: int = 1) -> DataFrame:
    """(docid, ids) of tokens(docid, i, term), by order of i."""
    got = tokens.join(vocab, "term", "left").select("docid", F.struct("i", F.coalesce("id", F.lit(unknown)).alias("id")).alias("s"))
    return got.groupBy("docid").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["id"]).alias("ids"))


def overlong_targets(targets: DataFrame, longest: int) -> DataFrame:
    return targets.where(F.size("tokens") > longest).select("target", F.size("tokens").alias("n"))


def target_index(targets: DataFrame, longest: int) -> DataFrame:
    """(tokens, n, targets) of targets(target, tokens array) that are not too long; n over 1 is a collision."""
    key = F.array_join(F.col("tokens").cast("array<string>"), ",").alias("tokens")
    fits = targets.where(F.size("tokens") <= longest)
    return fits.groupBy(key).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("target")).alias("targets"))


def _through_end(c: Column) -> Column:
    at = F.array_position(c, 1)
    return F.when(at > 0, F.slice(c, F.lit(1), at.cast("int"))).otherwise(c)


def _joined(c: Column) -> Column:
    return F.array_join(c.cast("array<string>"), ",")


def canonical_model(tokens: Column) -> Column:
    """Generated tokens without the leading start token (0), cut before padding (0), through the end token (1)."""
    rest = F.when(F.get(tokens, F.lit(0)) == 0, F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0)))).otherwise(tokens)
    pad = F.array_position(rest, 0)
    return _joined(_through_end(F.when(pad > 0, F.slice(rest, F.lit(1), (pad - 1).cast("int"))).otherwise(rest)))


def canonical_msmarco(tokens: Column) -> Column:
    """No zeros, and nothing after the first end token."""
    return _joined(_through_end(F.filter(tokens, lambda x: x != 0)))


def canonical_nq(tokens: Column) -> Column:
    """No zeros and no end tokens."""
    return _joined(F.filter(tokens, lambda x: ~x.isin(0, 1)))


def preference_loss(chosen: Column, chosen_ref: Column, rejected: Column, rejected_ref: Column, beta: float) -> Column:
    """Sigmoid preference loss of log-probabilities under the policy and the reference."""
    return F.log1p(F.exp(-beta * ((chosen - chosen_ref) - (rejected - rejected_ref))))
