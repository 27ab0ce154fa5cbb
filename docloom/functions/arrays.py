"""Array and vector functions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def padded(c: Column, size: int, pad: int = 0) -> tuple[Column, Column]:
    """c cut or filled up to size, and its attention mask."""
    fill = lambda x, v: F.slice(F.concat(x, F.array_repeat(F.lit(v), size)), 1, size)
    return fill(c, pad), fill(F.transform(c, lambda _: F.lit(1)), 0)


def collate_labels(c: Column, size: int, pad: int = 0) -> Column:
    """Labels filled up to size, where padding does not count towards a loss (-100)."""
    return F.transform(padded(c, size, pad)[0], lambda v: F.when(v == pad, -100).otherwise(v))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def squared_distance(a: Column, b: Column) -> Column:
    diff = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(diff, F.lit(0.0), lambda s, x: s + x * x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def code_owners(codes: DataFrame, code: Column) -> DataFrame:
    """(code_key, docids, n): the documents of each code, sorted."""
    key = F.array_join(code.cast("array<string>"), ",").alias("code_key")
    return codes.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("docid")), " ").alias("docids"), F.count("*").alias("n"))


def offset_codes(code: Column, vocab: int, centroids: int) -> Column:
    """Subspace codes as token ids behind a vocabulary, each subspace with a range of its own."""
    return F.transform(code, lambda x, i: (x + i * centroids + vocab).cast("int"))


def decode_offsets(tokens: Column, vocab: int, centroids: int) -> Column:
    return F.transform(tokens, lambda x: ((x - vocab) % centroids).cast("int"))
