"""Workflows end to end, and the incremental append."""

import json

import pytest
from pyspark.sql import functions as F

from docloom.plans import pipelines
from docloom.sources import manifest
from docloom.streaming.incremental import append_new


def test_mining_and_evaluation(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i}", " ".join(f"w{(i * 7 + j) % 40}" for j in range(12))) for i in range(40)], "docid string, contents string")
    queries = spark.createDataFrame([("q1", "w1 w2 w3 w4"), ("q2", "w10 w20")], "qid string, query string")
    truth = spark.createDataFrame([("q1", "d1"), ("q1", "d2"), ("q2", "d5")], "qid string, docid string")
    targets = docs.select("docid", F.concat(F.lit("t"), (F.substring("docid", 2, 9).cast("int") / 2).cast("int")).alias("target"))
    quotas = [(1, 5, 2), (6, 200, 2)]
    pairs, stats = pipelines.mine_bm25(queries, docs, truth, targets, quotas=quotas)
    got = pairs.collect()
    assert {r.query_key for r in got} == {"q1", "q2"} and len(got) == 8
    assert not {(r.query_key, r.rejected) for r in got} & {("q1", "d1"), ("q1", "d2"), ("q2", "d5")} and all(r.chosen_target != r.target for r in got)
    assert stats.where("state = 'usable'").count() == 1
    bm = pairs.select("query_key", "chosen", "rejected", "target", "bm25_rank")
    model = bm.limit(0).withColumnRenamed("bm25_rank", "model_rank")
    hybrid, groups = pipelines.mine_hybrid(bm, model, per_model=1, total=3)
    assert hybrid.count() == 6 and {r.outcome for r in groups.collect()} == {"fallback"}
    at = str(tmp_path / "hybrid")
    with pytest.raises(FileNotFoundError, match="bm25_pairs.*bm25_stats"):
        pipelines.mine_hybrid_in(spark, at, lambda: (pairs, stats), model, reuse=True, per_model=1, total=3)
    first, _ = pipelines.mine_hybrid_in(spark, at, lambda: (pairs, stats), model, per_model=1, total=3)
    again, _ = pipelines.mine_hybrid_in(spark, at, lambda: pytest.fail("mined again"), model, reuse=True, per_model=1, total=3)
    with pytest.raises(manifest.Stale, match="other inputs"):
        pipelines.mine_hybrid_in(spark, at, lambda: pytest.fail("mined again"), model, reuse=True, mark=manifest.fingerprint({"k": 10}, docs))
    assert sorted(map(str, first.collect())) == sorted(map(str, again.collect())) == sorted(map(str, hybrid.collect()))
    urls = docs.select(F.col("docid").alias("text_id"), F.concat(F.lit("http://"), "docid").alias("url"))
    assert pipelines.mine_url(bm, urls).count() == 8
    with pytest.raises(Exception, match="no single URL"):
        pipelines.mine_url(bm, urls.where("false")).collect()
    assert pipelines.mine_url(bm, urls.where("false"), skip_unmapped=True).count() == 0
    own, mean = pipelines.evaluate(spark.createDataFrame([("q1", "d1", 1), ("q2", "d9", 1)], "qid string, docid string, rank int"), truth)
    assert mean.first().mrr == 0.5 and own.count() == 2
    codes = docs.select("docid", F.lit("1,2").alias("code"))
    made = pipelines.build_instances("eval", docs, codes, queries=queries, qrels=truth.unionByName(spark.createDataFrame([("zz", "d1")], "qid string, docid string")))
    assert made.count() == 3
    with pytest.raises(Exception, match="no text for query zz"):
        pipelines.build_instances("query", docs, codes, queries=queries, qrels=spark.createDataFrame([("zz", "d1")], "qid string, docid string")).collect()


def test_append_new(spark, tmp_path):
    (tmp_path / "in").mkdir()
    args = (spark, str(tmp_path / "in"), "a int", str(tmp_path / "out"), str(tmp_path / "state"), lambda df: df.where("a > 1"))
    (tmp_path / "in/1.json").write_text("\n".join(json.dumps({"a": i}) for i in range(4)))
    append_new(*args)
    (tmp_path / "in/2.json").write_text(json.dumps({"a": 9}))
    append_new(*args)
    append_new(*args)
    assert sorted(r.a for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [2, 3, 9]
