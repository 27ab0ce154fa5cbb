"""Components by stars against union-find, with hubs, chains and later edges."""

import random

from pyspark.sql import functions as F

from docloom.operators import positives


def least(edges, ids=()):
    up = {x: x for e in edges for x in e} | {x: x for x in ids}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {x: root(x) for x in up}


def test_stars(spark):
    rnd = random.Random(1)
    edges = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(120)] + [(5000, 5000 + i) for i in range(0, 900)] + [(9, 9)]
    got = positives.star_components(spark.createDataFrame(edges, "u long, v long"))
    assert {r.id: r.component for r in got.collect()} == least(edges) and got.count() == len(least(edges))
    assert positives.star_components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_groups_with_a_hub(spark):
    rows = spark.range(60_000).select(F.concat(F.lit("n"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("id"), F.when(F.col("id") % 3 == 0, F.lit("hub")).otherwise(F.concat(F.lit("g"), F.floor(F.col("id") / 10))).alias("group"))
    more = spark.createDataFrame([("n000001", "bridge"), ("n000003", "bridge"), (None, "bridge2")], "id string, group string")
    got = positives.components(rows.unionByName(more).where("id is not null"))
    counts = {r.component: r["count"] for r in got.groupBy("component").count().collect()}
    # the hub's 20000, and the group of n000001 by the bridge: 1, 2, 4, 5, 7, 8
    assert counts["n000000"] == 20_000 + 6 and len(counts) == 6000 and got.count() == 60_000


def test_more_edges(spark):
    rnd = random.Random(2)
    edges = [(rnd.randint(0, 200), rnd.randint(0, 200)) for _ in range(90)]
    new = [(rnd.randint(0, 260), rnd.randint(0, 260)) for _ in range(60)] + [(400, 401), (500, 500)]
    df = lambda rows: spark.createDataFrame(rows, "u long, v long")
    labels = positives.star_components(df(edges))
    assert {r.id: r.component for r in positives.linked(labels, df(new)).collect()} == least(edges + new)
    assert {r.id: r.component for r in positives.linked(labels, df([])).collect()} == least(edges)
