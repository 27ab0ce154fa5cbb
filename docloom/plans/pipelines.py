"""Whole workflows as compositions of operators: what the reference's launchers run as processes over files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import bm25, hybrid, instances, metrics, mining, positives
from docloom.plans.mining import BAND_QUOTAS
from docloom.sources import manifest


def mine_bm25(queries: DataFrame, docs: DataFrame, truth: DataFrame, targets: DataFrame, k: int = 200, k1: float = 0.82, b: float = 0.68, quotas=BAND_QUOTAS, seed: str = "13", fill: bool = False) -> tuple[DataFrame, DataFrame]:
    """(pairs, stats): preference pairs of queries(qid, query) over docs(docid, contents). A query's chosen document is a
    drawn positive of truth(qid, docid); rejected ones are drawn from usable hits by bands; targets(docid, target)."""
    judged = mining.judged_candidates(bm25.top_k(queries, docs, k, k1, b), truth, targets)
    stats = judged.groupBy("state").agg(F.count("*").alias("n"))
    drawn = mining.stratified(judged.where("state = 'usable'").select("qid", "docid", "rank", "score", "target"), list(quotas), seed, fill)
    chosen = mining.one_positive(truth, seed).join(targets.withColumnRenamed("docid", "pos").withColumnRenamed("target", "chosen_target"), "pos")
    pairs = drawn.join(chosen, "qid").join(queries.select("qid", F.col("query").alias("prompt")), "qid")
    return pairs.select(F.col("qid").alias("query_key"), "prompt", F.col("pos").alias("chosen"), F.col("docid").alias("rejected"), "chosen_target", "target", F.col("rank").alias("bm25_rank"), F.col("score").alias("bm25_score")), stats


def mine_hybrid(bm25_pairs: DataFrame, model_pairs: DataFrame, excluded: DataFrame | None = None, per_model: int = 4, total: int = 8, seed: str = "13", exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """(pairs, groups) of hybrid.combine, without rows and groups of excluded(id)."""
    if not 0 <= per_model <= total:
        raise ValueError("a group cannot hold more model negatives than rows")
    if excluded is not None:
        bm25_pairs, model_pairs = hybrid.without(bm25_pairs, excluded), hybrid.without(model_pairs, excluded)
    return hybrid.combine(bm25_pairs, model_pairs, per_model, total, seed, exact)


def mine_hybrid_in(spark: SparkSession, folder: str, mined: Callable[[], tuple[DataFrame, DataFrame]], model_pairs: DataFrame, reuse: bool = False, mark: str = "", **options) -> tuple[DataFrame, DataFrame]:
    """mine_hybrid over the pairs and stats that mined() gives, as mine_bm25 does, published as one version in folder.
    mark: a manifest.fingerprint of what mined() reads and of its parameters. reuse: those of an earlier run are read and
    nothing is mined; without whole ones, or with ones of another mark, that is an error."""

    def write(version: str) -> None:
        for name, df in zip(("bm25_pairs", "bm25_stats"), mined(), strict=True):
            df.write.parquet(f"{version}/{name}")

    if not reuse:
        version = manifest.publish(spark, folder, mark, write)
    elif manifest.current(spark, folder) is None:
        raise FileNotFoundError(f"no bm25_pairs and bm25_stats to reuse at {folder}")
    else:
        version = manifest.reuse(spark, folder, mark)
    pairs = spark.read.parquet(f"{version}/bm25_pairs").select("query_key", "chosen", "rejected", "target", "bm25_rank")
    return mine_hybrid(pairs, model_pairs, **options)


def mine_url(pairs: DataFrame, urls: DataFrame, skip_unmapped: bool = False) -> DataFrame:
    """Pairs with URLs as targets; ids stay beside them. urls(text_id, url); an id without exactly one URL is an error unless skipped."""
    got = positives.pairs_to_url(pairs, positives.single_urls(urls))
    if not skip_unmapped:
        got = got.withColumn("status", F.when(F.col("status") == "unmapped", F.raise_error(F.concat(F.lit("no single URL for a document of "), "query_key"))).otherwise(F.col("status")))
    return got.where("status = 'ok'")


def build_instances(stage: str, docs: DataFrame, codes: DataFrame, idf: DataFrame | None = None, queries: DataFrame | None = None, qrels: DataFrame | None = None, longest: int = 64, most: int = 3) -> DataFrame:
    """(docid, kind, input, code): pretrain (passages and sampled terms), query (judged queries) or eval (those that are known)."""
    if stage == "pretrain":
        own = instances.passages(docs, longest, most).select("docid", F.lit("passage").alias("kind"), F.array_join("tokens", " ").alias("input"))
        terms = instances.sampled_terms(docs, idf, longest).select("docid", F.lit("terms").alias("kind"), F.array_join("tokens", " ").alias("input"))
        return own.unionByName(terms).join(codes, "docid")
    if stage in ("query", "eval"):
        got = instances.query_instances(qrels, queries, codes, strict=stage == "query")
        return got.select("docid", F.lit(stage).alias("kind"), F.col("query").alias("input"), "code")
    raise ValueError(f"unknown stage {stage}")


def evaluate(predictions: DataFrame, truth: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per query, means) of all metrics."""
    own = metrics.per_query(predictions, truth)
    return own, metrics.means(own)
