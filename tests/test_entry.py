"""The driver's contract."""

import __spark_entry__ as entry_module


def test_contract(spark):
    names, sql = entry_module.queries(), entry_module.oracle_sql()
    assert set(sql) <= set(names) and {"bm25_topk", "metrics_mean", "hybrid_pairs"} <= set(names)
    got = entry_module.entry(spark)
    assert got.columns == ["qid", "docid", "rank", "score"] and got.count() > 0
