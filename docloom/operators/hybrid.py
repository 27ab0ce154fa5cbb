"""Hybrid preference groups: negatives that a model confuses, and BM25's, in one group a query.

A group (query_key, chosen) takes its first model negatives and is filled up with BM25's: two of ranks up to 20, one of
21-100, one from 101 on, then a draw from the rest. A group that BM25 cannot fill is left out; so is one without all
its model negatives where the mix must be exact. A model negative that BM25 has too is marked; BM25 rows with a model
negative's id or target are not used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.mining import draw
from docloom.operators.numbering import checkpointed

GROUP = ["query_key", "chosen"]


def best_of(rows: DataFrame, rank: str) -> DataFrame:
    """The best row of each rejected id in a group, ranks missing last, ties by target."""
    order = [F.col(rank).asc_nulls_last(), F.col("target")]
    return rows.withColumn("_p", F.row_number().over(Window.partitionBy(*GROUP, "rejected").orderBy(*order))).where("_p = 1").drop("_p")


def without(rows: DataFrame, excluded: DataFrame) -> DataFrame:
    """rows whose chosen and rejected ids are not among excluded(id)."""
    ids = excluded.select("id").distinct()
    return rows.join(ids.withColumnRenamed("id", "chosen"), "chosen", "left_anti").join(ids.withColumnRenamed("id", "rejected"), "rejected", "left_anti")


def combine(bm25: DataFrame, model: DataFrame, per_model: int = 4, total: int = 8, seed: str = "11", exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """(pairs, groups) of bm25(query_key, chosen, rejected, target, bm25_rank) and model(..., model_rank).

    pairs: query_key, chosen, rejected, source, model_rank, bm25_rank, also_bm25_rank. groups: a row a BM25 group with
    n_model and what became of it: exact, fallback, model_shortfall or bm25_shortfall."""
    own = checkpointed(best_of(bm25, "bm25_rank"))  # both sides are read in several places below
    keys = own.select(*GROUP).distinct()
    place = F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.col("model_rank").asc_nulls_last(), "rejected"))
    picked = best_of(model, "model_rank").join(keys, GROUP, "left_semi").withColumn("_p", place).where(F.col("_p") <= per_model).drop("_p")
    picked = checkpointed(picked)
    marked = picked.join(own.select(*GROUP, "rejected", F.col("bm25_rank").alias("also_bm25_rank")), [*GROUP, "rejected"], "left")
    marked = marked.withColumn("source", F.when(F.col("also_bm25_rank").isNotNull(), "model_confusion+bm25").otherwise("model_confusion"))
    pool = own.join(picked.select(*GROUP, "rejected"), [*GROUP, "rejected"], "left_anti").join(picked.select(*GROUP, "target").distinct(), [*GROUP, "target"], "left_anti")
    have = keys.join(picked.groupBy(*GROUP).agg(F.count("*").alias("n_model")), GROUP, "left").select(*GROUP, F.coalesce("n_model", F.lit(0)).alias("n_model"))
    rank = F.col("bm25_rank")
    band = F.when(rank <= 20, "top").when(rank.between(21, 100), "mid").when(rank >= 101, "low")
    quota = F.when(F.col("band") == "top", 2).otherwise(1)
    pool = pool.withColumn("band", band)
    drawn = F.row_number().over(Window.partitionBy(*GROUP, "band").orderBy(draw(F.lit(seed), *GROUP, F.coalesce("band", F.lit("-")), "rejected"), "rejected"))
    pool = pool.withColumn("first", F.coalesce(F.col("band").isNotNull() & (drawn <= quota), F.lit(False)))
    # quotas go first, band by band, then the draw from the rest; cut at what the group needs
    step = F.when(F.col("first"), F.when(F.col("band") == "top", 0).when(F.col("band") == "mid", 1).otherwise(2)).otherwise(3)
    key = F.when(F.col("first"), draw(F.lit(seed), *GROUP, "band", "rejected")).otherwise(draw(F.lit(seed), *GROUP, F.lit("fill"), "rejected"))
    pool = pool.withColumn("_at", F.row_number().over(Window.partitionBy(*GROUP).orderBy(step, key, "rejected"))).join(have, GROUP)
    filled = pool.where(F.col("_at") <= total - F.col("n_model"))
    n_bm25 = filled.groupBy(*GROUP).agg(F.count("*").alias("n_bm25"))
    groups = have.join(n_bm25, GROUP, "left").withColumn("n_bm25", F.coalesce("n_bm25", F.lit(0)))
    outcome = F.when(F.lit(exact) & (F.col("n_model") < per_model), "model_shortfall").when(F.col("n_bm25") + F.col("n_model") < total, "bm25_shortfall").when(F.col("n_model") == per_model, "exact").otherwise("fallback")
    groups = groups.withColumn("outcome", outcome)
    good = groups.where(F.col("outcome").isin("exact", "fallback")).select(*GROUP)
    none = F.lit(None).cast("int")
    rows = marked.select(*GROUP, "rejected", "source", "model_rank", none.alias("bm25_rank"), "also_bm25_rank").unionByName(filled.select(*GROUP, "rejected", F.lit("bm25").alias("source"), none.alias("model_rank"), "bm25_rank", none.alias("also_bm25_rank")))
    return rows.join(good, GROUP, "left_semi"), groups


def select_beams(beams: DataFrame, targets: DataFrame, positives: DataFrame, limit: int) -> DataFrame:
    """beams(qid, rank, code) with target and state (unmapped, positive, duplicate or selected), as far as a query's
    beams were looked at: up to the limit-th selected one. targets(code, target), positives(qid, target)."""
    got = beams.join(targets, "code", "left").join(positives.select("qid", "target").distinct().withColumn("_pos", F.lit(True)), ["qid", "target"], "left")
    got = got.withColumn("state", F.when(F.col("target").isNull(), "unmapped").when(F.col("_pos"), "positive"))
    place = F.row_number().over(Window.partitionBy("qid", F.col("state").isNull(), "target").orderBy("rank"))
    got = got.withColumn("state", F.coalesce("state", F.when(place == 1, "selected").otherwise("duplicate")))
    before = F.count_if(F.col("state") == "selected").over(Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    taken = before - (F.col("state") == "selected").cast("int")
    return got.withColumn("_taken", taken).where(F.col("_taken") < limit).select("qid", "rank", "code", "target", "state")
