"""Ranking metrics per query, their means, and paired significance statistics.

Predictions are (qid, docid, rank) with ranks 1, 2, ... a query; a document may come twice. Precision divides by the
predictions there are, not by k; recall counts repeated hits; average precision and precision count a document once;
the ideal gain sums over all truths, 0.3 at least. Queries without predictions score 0.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NDCG_AT, P_AT, R_AT, HIT_AT = (10, 20, 100), (1, 10, 20, 100), (1, 5, 10, 100, 1000), (1, 5, 10, 100, 1000)
NAMES = ("mrr", "mrr_10", "map_20", *(f"ndcg_{k}" for k in NDCG_AT), *(f"p_{k}" for k in P_AT), *(f"r_{k}" for k in R_AT), *(f"hit_{k}" for k in HIT_AT))


def per_query(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """(qid, NAMES) for each query of truth(qid, docid)."""
    pairs = truth.select("qid", "docid").distinct()
    known = pairs.groupBy("qid").agg(F.count("*").alias("n_truth"))
    p = predictions.select("qid", "docid", "rank").join(known.select("qid"), "qid", "left_semi")
    p = p.join(pairs.withColumn("rel", F.lit(True)), ["qid", "docid"], "left").withColumn("rel", F.coalesce("rel", F.lit(False)))
    first = F.col("rel") & (F.row_number().over(Window.partitionBy("qid", "docid").orderBy("rank")) == 1)
    p = p.withColumn("first", first)
    so_far = F.sum(F.col("first").cast("int")).over(Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    p = p.withColumn("so_far", so_far)
    rank, upto = F.col("rank"), lambda k: F.col("rank") <= k
    total = lambda when, value: F.coalesce(F.sum(F.when(when, value)), F.lit(0.0))
    parts = {
        "mrr": F.max(F.when(F.col("rel"), 1.0 / rank)),
        "mrr_10": F.max(F.when(F.col("rel") & upto(10), 1.0 / rank)),
        "map_20": total(F.col("first") & upto(20), F.col("so_far") / rank),
        **{f"ndcg_{k}": total(F.col("rel") & upto(k), 1.0 / F.log2(rank + 1.0)) for k in NDCG_AT},
        **{f"p_{k}": F.count_if(F.col("first") & upto(k)) / F.greatest(F.lit(1), F.least(F.max(rank), F.lit(k))) for k in P_AT},
        **{f"r_{k}": F.count_if(F.col("rel") & upto(k)).cast("double") for k in R_AT},
        **{f"hit_{k}": F.max((F.col("rel") & upto(k)).cast("double")) for k in HIT_AT},
    }
    got = known.join(p.groupBy("qid").agg(*(v.alias(k) for k, v in parts.items())), "qid", "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.col("n_truth").cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    divide: dict[str, Column] = {"map_20": F.greatest(F.lit(1), F.col("n_truth")), **{f"ndcg_{k}": F.greatest(F.lit(0.3), ideal) for k in NDCG_AT}, **{f"r_{k}": F.col("n_truth") for k in R_AT}}
    return got.select("qid", *(F.coalesce(F.col(n) / divide[n] if n in divide else F.col(n), F.lit(0.0)).alias(n) for n in NAMES))


def means(metrics: DataFrame) -> DataFrame:
    return metrics.agg(*(F.avg(n).alias(n) for n in NAMES))


def paired(a: DataFrame, b: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(metric, qid, d): differences of two systems' metrics a query."""
    stack = lambda df: df.select("qid", F.inline(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias("v")) for n in names))))
    return stack(a).join(stack(b).withColumnRenamed("v", "w"), ["metric", "qid"]).select("metric", "qid", (F.col("v") - F.col("w")).alias("d"))


def t_statistic(differences: DataFrame) -> DataFrame:
    """(metric, n, mean_diff, t) of a paired t-test."""
    got = differences.groupBy("metric").agg(F.count("*").alias("n"), F.avg("d").alias("mean_diff"), F.stddev_samp("d").alias("sd"))
    t = F.when(F.col("sd") > 0, F.col("mean_diff") / (F.col("sd") / F.sqrt(F.col("n").cast("double"))))
    return got.select("metric", "n", "mean_diff", t.alias("t"))


def wilcoxon(differences: DataFrame) -> DataFrame:
    """(metric, n, w_plus, w_minus, w) of a signed-rank test; differences of 0 are left out, ties share mean ranks."""
    d = differences.where("d <> 0").withColumn("size", F.round(F.abs("d"), 9))
    within = Window.partitionBy("metric")
    mean_rank = F.rank().over(within.orderBy("size")) + (F.count("*").over(Window.partitionBy("metric", "size")) - 1) / 2.0
    r = d.withColumn("r", mean_rank)
    got = r.groupBy("metric").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("r"))), F.lit(0.0)).alias("w_plus"), F.coalesce(F.sum(F.when(F.col("d") < 0, F.col("r"))), F.lit(0.0)).alias("w_minus"))
    return got.withColumn("w", F.least("w_plus", "w_minus"))


def t_test_p(t: float, n: int) -> float:
    """Two-sided p of a t statistic with n - 1 degrees of freedom, by the incomplete beta function's continued fraction."""
    v = n - 1
    x, a, b = v / (v + t * t), v / 2.0, 0.5

    def fraction(x: float, a: float, b: float) -> float:
        tiny = 1e-300
        c, d = 1.0, 1.0 / max(1 - (a + b) * x / (a + 1), tiny)
        h = d
        for m in range(1, 500):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1.0 / (1 + num * d or tiny)
                c = 1 + num / c or tiny
                h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return h

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    if x >= 1:
        return 1.0
    return front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b


#: Pairs up to which the signed-rank distribution is exact.
EXACT = 50


def signed_rank_p(w: float, ranks: list[float]) -> float:
    """Two-sided p of a signed-rank statistic, the lesser rank sum, from the distribution of sums over all signs of these
    ranks: counts of subsets by sum, one rank after the other, in halves, as ties share mean ranks."""
    doubled = [round(2 * r) for r in ranks]
    ways = [1]
    for r in doubled:
        longer = ways + [0] * r
        for i, n in enumerate(ways):
            longer[i + r] += n
        ways = longer
    return min(1.0, 2 * sum(ways[: round(2 * w) + 1]) / 2 ** len(doubled))


def wilcoxon_p(w: float, n: int, ties: tuple[int, ...] = (), ranks: list[float] | None = None) -> float:
    """Two-sided p of a signed-rank statistic, the lesser rank sum. Exact for up to EXACT pairs, where ties need their
    ranks; else by the normal approximation. ties: sizes of groups of equal ranks."""
    if not n:
        return 1.0
    if n <= EXACT and (ranks is not None or not ties):
        return signed_rank_p(w, list(range(1, n + 1)) if ranks is None else ranks)
    variance = n * (n + 1) * (2 * n + 1) / 24 - sum(t**3 - t for t in ties) / 48
    return math.erfc(abs(w - n * (n + 1) / 4) / math.sqrt(2 * variance))


def wilcoxon_test(differences: DataFrame) -> DataFrame:
    """(metric, n, w_plus, w_minus, w, p): wilcoxon() with its p. Ranks are gathered for metrics of up to EXACT pairs alone;
    of others, the sizes of groups of ties are counted."""
    ranked = wilcoxon(differences)
    sizes = differences.where("d <> 0").groupBy("metric", F.round(F.abs("d"), 9).alias("size")).agg(F.count("*").alias("t"))
    before = F.coalesce(F.sum("t").over(Window.partitionBy("metric").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("rank", before + (F.col("t") + 1) / 2.0).join(ranked.select("metric", "n"), "metric")
    few = F.when(F.col("n") <= EXACT, F.struct("rank", "t"))
    cubes = F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("cubes")
    groups = sizes.groupBy("metric").agg(F.collect_list(few).alias("ranks"), cubes)

    @F.pandas_udf("double")
    def p(w: pd.Series, n: pd.Series, cubes: pd.Series, ranks: pd.Series) -> pd.Series:
        out = []
        for w_, n_, cubes_, ranks_ in zip(w, n, cubes, ranks):
            if n_ <= EXACT:
                out.append(signed_rank_p(w_, [r["rank"] for r in ranks_ for _ in range(r["t"])]))
            else:
                out.append(math.erfc(abs(w_ - n_ * (n_ + 1) / 4) / math.sqrt(2 * (n_ * (n_ + 1) * (2 * n_ + 1) / 24 - cubes_ / 48))))
        return pd.Series(out)

    return ranked.join(groups, "metric").select("metric", "n", "w_plus", "w_minus", "w", p("w", "n", "cubes", "ranks").alias("p"))
