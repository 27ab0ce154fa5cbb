"""Document identifiers: atomic, quantised, URL and title, summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.arrays import squared_distance
from docloom.operators.numbering import checkpointed, numbered

VOCAB = 32128
#: Vectors that are asked for, up to which mean_embedding broadcasts them, and sums that one of its tasks holds.
BROADCAST_VECTORS, SUMS = 50_000, 1 << 19


def atomic(docs: DataFrame, order: str, vocab: int = VOCAB) -> DataFrame:
    """docs with id: a token of its own for each document, behind the vocabulary."""
    return numbered(docs, [F.col(order)], "id", vocab)


def mean_embedding(keyed: DataFrame, vectors: DataFrame, seed_id: int) -> DataFrame:
    """(docid, i, v): mean of the seed vector and the vectors of a document's distinct tokens, by dimension from 1 on.
    What is shuffled are lists of ids, a document each: up to BROADCAST_VECTORS vectors that are asked for go to all tasks;
    more of them are joined and shuffled whole, a row a vector. Dimensions are told apart where the sums are, SUMS a task."""
    named = checkpointed(keyed.groupBy("docid").agg(F.concat(F.collect_list("vec_id"), F.array(F.lit(seed_id).cast("long"))).alias("ids")))
    width = vectors.agg(F.max(F.size("embedding"))).first()[0] or 1
    tasks = max(1, -(-named.count() * width // SUMS))
    asked = checkpointed(named.select(F.explode("ids").alias("vec_id")).distinct())
    vectors = vectors.select("vec_id", "embedding")
    each = F.explode("ids").alias("vec_id")
    if asked.count() <= BROADCAST_VECTORS:
        met = named.repartition(tasks, "docid").select("docid", each).join(F.broadcast(vectors.join(F.broadcast(asked), "vec_id", "left_semi")), "vec_id")
    else:
        met = named.select("docid", each).join(vectors, "vec_id").select("docid", "embedding").repartition(tasks, "docid")
    rows = met.select("docid", F.posexplode("embedding").alias("p", "x"))
    return rows.groupBy("docid", (F.col("p") + 1).alias("i")).agg(F.avg(F.col("x").cast("double")).alias("v"))


def nearest(vector: Column, centroids: Column) -> Column:
    """Place of the centroid nearest to a vector, the first of equals; distances are rounded to nine digits."""
    far = F.transform(centroids, lambda c: F.round(squared_distance(vector, c), 9))
    return (F.array_position(far, F.array_min(far)) - 1).cast("int")


def pq_codes(vector: Column, codebook: Column, parts: int, width: int) -> Column:
    """One code a subspace; codebook: array of subspaces, each an array of centroids."""
    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda m: nearest(F.slice(vector, m * width + 1, F.lit(width)), F.get(codebook, m)))


def pq_rebuilt(codes: Column, codebook: Column) -> Column:
    """The codewords end to end."""
    return F.flatten(F.transform(codes, lambda c, m: F.get(F.get(codebook, m), c)))


def rq_codes(vector: Column, codebooks: list[Column]) -> Column:
    """One code a level; each level codes what the levels before left over."""
    rest, codes = vector, []
    for book in codebooks:
        code = nearest(rest, book)
        codes.append(code)
        rest = F.zip_with(rest, F.get(book, code), lambda x, y: x.cast("double") - y.cast("double"))
    return F.array(*codes)


def sums(vectors: Column) -> Column:
    """Sum of an array of vectors of one width."""
    first = F.transform(F.get(vectors, F.lit(0)), lambda x: x.cast("double"))
    return F.aggregate(F.slice(vectors, F.lit(2), F.size(vectors) - 1), first, lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double")))


def text_codes(tokens: Column, longest: int, end: int = 1) -> Column:
    """Token ids cut to longest - 1, and the end token."""
    return F.concat(F.slice(tokens, 1, longest - 1), F.array(F.lit(end)))

