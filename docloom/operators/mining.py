"""Hard negatives: which hits may be used, and samples of them by rank bands.

Samples are drawn by a hash of (seed, query, chosen, band, candidate) instead of a random generator, so they do not
depend on the order of rows; the numbers a band, the order of filters and the all-or-nothing rules are kept.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(*parts: Column | str) -> Column:
    """Sort key of a draw: sha-256 of the parts joined by |."""
    return F.sha2(F.concat_ws("|", *(F.col(p) if isinstance(p, str) else p for p in parts)), 256)


def collision_stats(docs: DataFrame) -> DataFrame:
    """One row on docs(text_id, targets): documents without exactly one target, targets, those that documents share,
    documents that share, and how many too many."""
    n = docs.agg(F.count_if(F.size("targets") != 1).alias("invalid_docs"))
    own = docs.where(F.size("targets") == 1).groupBy(F.get("targets", F.lit(0)).alias("target")).agg(F.count("*").alias("n"))
    many = F.col("n") > 1
    got = own.agg(F.count("*").alias("n_targets"), F.count_if(many).alias("shared"), F.coalesce(F.sum(F.when(many, F.col("n"))), F.lit(0)).alias("docs_in_shared"), F.coalesce(F.sum(F.when(many, F.col("n") - 1)), F.lit(0)).alias("surplus"))
    return n.join(F.broadcast(got))


def judged_candidates(run: DataFrame, positives: DataFrame, targets: DataFrame) -> DataFrame:
    """run(qid, docid, rank, score) with target and state: positive, unknown (no target), same_target (as a positive),
    duplicate (a better rank has the target) or usable. Queries without positives are left out."""
    judged = run.join(positives.select("qid").distinct(), "qid", "left_semi")
    own = positives.select("qid", "docid").distinct()
    got = judged.join(own.withColumn("_pos", F.lit(True)), ["qid", "docid"], "left").join(targets, "docid", "left")
    taken = own.join(targets, "docid").select("qid", "target").distinct().withColumn("_taken", F.lit(True))
    got = got.join(taken, ["qid", "target"], "left")
    state = F.when(F.col("_pos"), "positive").when(F.col("target").isNull(), "unknown").when(F.col("_taken"), "same_target")
    got = got.withColumn("state", state)
    # only candidates so far compete for a target
    place = F.row_number().over(Window.partitionBy("qid", F.col("state").isNull(), "target").orderBy("rank"))
    return got.withColumn("state", F.coalesce("state", F.when(place == 1, "usable").otherwise("duplicate"))).select("qid", "docid", "rank", "score", "target", "state")


def stratified(candidates: DataFrame, quotas: list[tuple[int, int, int]], seed: str, fill: bool = False) -> DataFrame:
    """candidates(qid, docid, rank, ...) drawn by bands (first rank, last rank, quota) a query. A query whose bands
    cannot all be filled has no rows, or with fill is filled up from what is left of its candidates."""
    band, quota = None, None
    for i, (lo, hi, n) in enumerate(quotas):
        inside = F.col("rank").between(lo, hi)
        band = F.when(inside, i) if band is None else band.when(inside, i)
        quota = F.when(F.col("band") == i, n) if quota is None else quota.when(F.col("band") == i, n)
    total = sum(n for _, _, n in quotas)
    rows = candidates.withColumn("band", band)
    key = draw(F.lit(seed), "qid", F.coalesce(F.col("band").cast("string"), F.lit("-")), "docid")
    place = F.row_number().over(Window.partitionBy("qid", "band").orderBy(key, "docid"))
    rows = rows.withColumn("picked", F.coalesce(F.col("band").isNotNull() & (place <= quota), F.lit(False)))
    n_picked = F.count_if("picked").over(Window.partitionBy("qid"))
    rows = rows.withColumn("n_picked", n_picked)
    if not fill:
        return rows.where((F.col("n_picked") == total) & F.col("picked")).drop("picked", "n_picked")
    more = draw(F.lit(seed), "qid", F.lit("fill"), "docid")
    spare = F.row_number().over(Window.partitionBy("qid", "picked").orderBy(more, "docid"))
    rows = rows.withColumn("used", F.col("picked") | (spare <= total - F.col("n_picked")))
    return rows.withColumn("n_used", F.count_if("used").over(Window.partitionBy("qid"))).where((F.col("n_used") == total) & F.col("used")).drop("picked", "n_picked", "used", "n_used")


def msmarco_sample(hits: DataFrame, n: int, bands, seed: str) -> DataFrame:
    """hits(qid, docid, rank) drawn n a query over bands, n // bands each and the rest from the last; a query with fewer than n in all has none."""
    from docloom.operators.runs import band_of

    names = [b[0] for b in bands]
    each = n // len(names)
    quota = F.when(F.col("band") == names[-1], n - each * (len(names) - 1)).otherwise(each)
    rows = hits.withColumn("band", band_of(F.col("rank"), bands)).where("band is not null")
    place = F.row_number().over(Window.partitionBy("qid", "band").orderBy(draw(F.lit(seed), "qid", "band", "docid"), "docid"))
    rows = rows.withColumn("_p", place).where(F.col("_p") <= quota).withColumn("_n", F.count("*").over(Window.partitionBy("qid")))
    return rows.where(F.col("_n") >= n).drop("_p", "_n")


def nq_sample(run: DataFrame, positives: DataFrame, n: int, seed: str) -> DataFrame:
    """(qid, docid, band, pick) of run(qid, docid, score): bands of places 1-100, 101-500 and 501-1000 by score, cut
    before the positives go; n // 3 a band; what is missing is drawn from the first band with replacement."""
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "docid"))
    rows = run.join(positives.select("qid").distinct(), "qid", "left_semi").withColumn("place", place)
    band = F.when(F.col("place") <= 100, "top").when(F.col("place") <= 500, "mid").when(F.col("place") <= 1000, "low")
    rows = rows.withColumn("band", band).where("band is not null").join(positives.select("qid", "docid"), ["qid", "docid"], "left_anti")
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy("qid", "band").orderBy(draw(F.lit(seed), "qid", "band", "docid"), "docid")))
    first = rows.where(F.col("at") <= n // 3).select("qid", "docid", "band", F.col("at").alias("pick"))
    top = rows.where("band = 'top'").select("qid", F.col("at").alias("slot"), "docid")
    size = top.groupBy("qid").agg(F.count("*").alias("size"))
    have = first.groupBy("qid").agg(F.count("*").alias("have"))
    lack = size.join(have, "qid", "left").withColumn("lack", F.lit(n) - F.coalesce("have", F.lit(0))).where("lack > 0")
    draws = lack.select("qid", "size", F.explode(F.sequence(F.lit(1), F.col("lack").cast("int"))).alias("pick"))
    slot = (F.conv(F.substring(draw(F.lit(seed), "qid", F.lit("fill"), F.col("pick").cast("string")), 1, 8), 16, 10).cast("long") % F.col("size") + 1).cast("int")
    filled = draws.withColumn("slot", slot).join(top, ["qid", "slot"]).select("qid", "docid", F.lit("fill").alias("band"), "pick")
    return first.unionByName(filled)


def uniform_sample(hits: DataFrame, n: int, seed: str) -> DataFrame:
    """n hits a query, of queries that have as many."""
    w = Window.partitionBy("qid")
    rows = hits.withColumn("_p", F.row_number().over(w.orderBy(draw(F.lit(seed), "qid", "docid"), "docid"))).withColumn("_n", F.count("*").over(w))
    return rows.where((F.col("_n") >= n) & (F.col("_p") <= n)).drop("_p", "_n")


def one_positive(qrels: DataFrame, seed: str) -> DataFrame:
    """(qid, pos): a drawn positive a query."""
    key = F.struct(draw(F.lit(seed), "qid", "docid").alias("k"), F.col("docid").alias("d"))
    return qrels.groupBy("qid").agg(F.min(key)["d"].alias("pos"))


def url_pairs(results: DataFrame, quotas: list[tuple[int, int, int]], seed: str) -> DataFrame:
    """(qid, chosen, rejected, rank) of results(qid, source_url, positives array, url, rank): no positives, no own URL,
    the best rank of a URL, drawn by bands; the source is chosen if it is a positive, else the first positive."""
    ok = ~F.array_contains("positives", F.col("url")) & (F.col("url") != F.col("source_url")) & (F.size("positives") > 0)
    chosen = F.when(F.array_contains("positives", F.col("source_url")), F.col("source_url")).otherwise(F.get("positives", F.lit(0)))
    best = results.where(ok).groupBy("qid", "url").agg(F.min("rank").alias("rank"), F.first(chosen).alias("chosen"))
    return stratified(best.select("qid", F.col("url").alias("docid"), "rank", "chosen"), quotas, seed).select("qid", "chosen", F.col("docid").alias("rejected"), "rank")


def parse_ranges(value: str) -> list[tuple[int, int]]:
    """(first, last) ranks of text like 1:50,51:100; ranks count from 1."""
    out = []
    for part in value.split(","):
        if not (m := re.fullmatch(r"\s*(\d+)\s*:\s*(\d+)\s*", part)) or not 1 <= int(m[1]) <= int(m[2]):
            raise ValueError(f"no rank range: {part!r}")
        out.append((int(m[1]), int(m[2])))
    return out


def parse_quotas(value: str) -> list[int]:
    """Numbers, 0 or more, of text like 4,2,2."""
    found = [p.strip() for p in value.split(",") if p.strip()]
    if not found or not all(re.fullmatch(r"\d+", p) for p in found):
        raise ValueError(f"no quotas: {value!r}")
    return [int(p) for p in found]


def bands(ranges: str, quotas: str) -> list[tuple[int, int, int]]:
    """(first, last, quota) for stratified(); as many quotas as ranges, and no rank in two ranges."""
    spans, numbers = parse_ranges(ranges), parse_quotas(quotas)
    if len(spans) != len(numbers):
        raise ValueError(f"{len(spans)} rank ranges, {len(numbers)} quotas")
    ordered = sorted(spans)
    if any(a[1] >= b[0] for a, b in zip(ordered, ordered[1:])):
        raise ValueError(f"rank ranges overlap: {ranges}")
    return [(*s, n) for s, n in zip(spans, numbers)]
