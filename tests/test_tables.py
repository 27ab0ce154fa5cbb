"""Preference and CSV splits, documents, join keys, layouts of a folder."""

import json

import pytest
from pyspark.sql import functions as F

from docloom.sources import readers, sinks, tables


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_preference_splits(spark, tmp_path):
    good = [{"query": f" q{i} ", "positive_doc_id": "a", "negative_doc_id": "b"} for i in range(200)]
    bad = [{"query": "", "positive_doc_id": "a", "negative_doc_id": "b"}, {"query": "q", "positive_doc_id": "a", "negative_doc_id": "a"}, {"query": "q", "positive_doc_id": None, "negative_doc_id": "a"}]
    (tmp_path / "train.jsonl").write_text("\n".join(map(json.dumps, good + bad)))
    (tmp_path / "eval.json").write_text(json.dumps([{"query": "e", "positive_doc_id": "x", "negative_doc_id": "y", "more": 1}]))
    names = {"prompt": "query", "chosen": "positive_doc_id", "rejected": "negative_doc_id"}
    at = lambda f: str(tmp_path / f)
    got = tables.preference_splits(spark, at("train.jsonl"), at("eval.json"), percent=50, names=names)
    assert rows(got["validation"]) == [("e", "x", "y")] and got["train"].count() == 200
    got = tables.preference_splits(spark, at("train.jsonl"), percent=20, names=names)
    assert rows(got["train"].union(got["validation"])) == sorted([(f"q{i}", "a", "b") for i in range(200)], key=str)
    assert 20 < got["validation"].count() < 60 and set(tables.preference_splits(spark, at("train.jsonl"), names=names)) == {"train"}
    (tmp_path / "none.jsonl").write_text(json.dumps(bad[0]))
    with pytest.raises(ValueError, match="train"):
        tables.preference_splits(spark, at("none.jsonl"), names=names)


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a;b;c;d\n1.000,5;yes;"x;""y"";\nz";NA\n2;no;;-\n', encoding="latin-1")
    options = {"sep": ";", "schema": "a double, b boolean", "nulls": ("", "NA", "-"), "true": ("yes",), "false": ("no",), "thousands": ".", "decimal": ",", "encoding": "ISO-8859-1", "multiline": True}
    got = tables.csv_splits(spark, {"train": str(tmp_path / "a.csv"), "test": [str(tmp_path / "a.csv")] * 2}, **options)
    assert rows(got["train"]) == [(1000.5, True, 'x;"y";\nz', None), (2.0, False, None, None)] and got["test"].count() == 4
    assert tables.csv_splits(spark, str(tmp_path / "a.csv"), only=["b"], **options)["train"].columns == ["b"]
    (tmp_path / "b.csv").write_text('junk\nmore junk\nx,y\n# no\n1,"a,b"\n\n2,c\n3,d\n')
    read = lambda **o: rows(tables.csv_splits(spark, str(tmp_path / "b.csv"), schema="x int", **o)["train"])
    assert read(skip=2, comment="#") == [(1, "a,b"), (2, "c"), (3, "d")]
    assert read(skip=2, comment="#", most=2) == [(1, "a,b")]
    assert read(skip=4, header=False, names=["x", "z"]) == [(1, "a,b"), (2, "c"), (3, "d")]
    with pytest.raises(ValueError, match="no files"):
        tables.csv_splits(spark, {})
    with pytest.raises(ValueError, match="no lines"):
        read(skip=20)


def test_documents_and_nulls(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"id": "1", "contents": "x"}\n{"id": "2"}\n{"contents": null}\n')
    assert rows(tables.contents(spark, str(tmp_path / "d.jsonl"))) == [("", ""), ("1", "x"), ("2", "")]
    df = spark.createDataFrame([(1, float("nan"), None), (2, 1.5, "t")], "id int, q double, d string")
    assert rows(tables.query_doc_pairs(df, "id", "q", "d")) == [("1", "", ""), ("2", "1.5", "t")]
    assert tables.filled(df, "q").dtypes == [("id", "int"), ("q", "string"), ("d", "string")]


def test_join_value(spark):
    value = lambda df, key: [r.v for r in df.select(tables.join_value(df, key).alias("v")).collect()]
    both = spark.createDataFrame([(None, "u", 7), (" b ", "u", None)], "url_based_id string, url_id string, n int")
    assert value(both, "url_based_id") == ["", "b"] and value(both, "n") == ["7", ""] and value(both, "other") == ["", ""]
    assert value(both.drop("url_based_id"), "url_based_id") == ["u", "u"]


def test_retrieval_layout(spark, tmp_path):
    at = str(tmp_path / "all")
    docs = spark.createDataFrame([("d1", "a\tb"), ("d2", None)], "docid string, contents string")
    sinks.retrieval_layout(docs, spark.createDataFrame([("q1", "x\ty\nz")], "qid string, query string"), spark.createDataFrame([("q1", "d1"), ("q1", "d2")], "qid string, docid string"), at)
    assert rows(tables.contents(spark, f"{at}/corpus")) == [("d1", "a\tb"), ("d2", "")]
    assert rows(readers.queries_tsv(spark, f"{at}/queries")) == [("q1", "x y z")]
    assert rows(readers.qrels(spark, f"{at}/qrels")) == [("q1", "d1", "1"), ("q1", "d2", "1")]
    assert sorted(r.value for r in spark.read.text(f"{at}/qrels").collect()) == ["q1\t0\td1\t1", "q1\t0\td2\t1"]


def test_embedding_matrix(spark, tmp_path):
    at = str(tmp_path / "m")
    df = spark.createDataFrame([(f"d{i:03}", [float(i), 0.5]) for i in range(50)], "docid string, embedding array<float>").repartition(5)
    assert sinks.embedding_matrix(df, at) == 50
    assert [(r.row, r.docid, list(r.embedding)) for r in spark.read.parquet(at).orderBy("row").collect()] == [(i, f"d{i:03}", [float(i), 0.5]) for i in range(50)]
    with pytest.raises(ValueError, match="widths"):
        sinks.embedding_matrix(df.withColumn("embedding", F.slice("embedding", 1, F.when(F.col("docid") > "d020", 1).otherwise(2))), at)
