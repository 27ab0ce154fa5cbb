"""Readers and sinks on small files."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from docloom.operators import runs
from docloom.sources import readers, sinks


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_queries_and_qrels(spark, tmp_path):
    p = put(tmp_path / "q.tsv", "1\tone\n2\ttwo\nbroken\n1\tone again\n3\ta\tb\n")
    assert rows(readers.queries_tsv(spark, p)) == [("1", "one again"), ("2", "two")]
    with pytest.raises(Exception, match="two fields"):
        readers.queries_tsv(spark, p, strict=True).collect()
    with gzip.open(tmp_path / "r.tsv.gz", "wt") as f:
        f.write("1 0 d1 1\n1 0 d2 0\n1\t0\td3\t1\nshort line\n")
    p = str(tmp_path / "r.tsv.gz")
    assert rows(readers.qrels(spark, p)) == [("1", "d1", "1"), ("1", "d3", "1")]
    assert len(rows(readers.qrels(spark, p, only_relevant=False))) == 3
    assert rows(readers.qrels_single(spark, p)) == [("1", "d3")]


def test_run_layouts(spark, tmp_path):
    p = put(tmp_path / "run", "1 Q0 a 2 9.5 t\n1 Q0 b 1 9.9 t\n\n2 a 7\n2 b 3\n3 x 0.5\n3 y 0.4\n3 x 0.3\n3 z 0.2\n")
    got = {(r.qid, r.docid): (r["rank"], r.score) for r in runs.parse_run(readers.run_lines(spark, p)).collect()}
    assert got == {("1", "a"): (2, 9.5), ("1", "b"): (1, 9.9), ("2", "a"): (7, None), ("2", "b"): (3, None), ("3", "x"): (1, 0.5), ("3", "y"): (2, 0.4), ("3", "z"): (4, 0.2)}
    with pytest.raises(Exception, match="fewer than three"):
        runs.parse_run(readers.run_lines(spark, put(tmp_path / "bad", "1 a\n"))).collect()
    broken = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c")], "line_no long, qid string")
    assert rows(runs.noncontiguous(broken)) == [("a", 2)]


def test_docs_and_codes(spark, tmp_path):
    p = put(tmp_path / "docs.tsv", 'D1\thttp://a\tTitle "x"\tbody\twith tab\nbad\n')
    assert rows(readers.raw_docs(spark, p)) == [("D1", "http://a", 'Title "x"', "body\twith tab")]
    p = put(tmp_path / "codes", "[D1]\t0,5,6,1\nd2\t7,8\n")
    assert rows(readers.docid_codes(spark, p)) == [("[d1]", [0, 5, 6, 1]), ("[d2]", [7, 8])]
    assert rows(readers.docid_codes(spark, p, (0, 1))) == [("[d1]", [5, 6]), ("[d2]", [7, 8])]
    p = put(tmp_path / "emb", "[D1]\t0.5,1\n")
    assert rows(readers.embeddings(spark, p)) == [("[d1]", [0.5, 1.0])]
    p = put(tmp_path / "nq.tsv", "q\t1\t\t\tT\tA\tC\thttp://u\tTAC\ten\n")
    assert readers.nq_tsv(spark, p).first().long_answer == ""
    p = put(tmp_path / "pq", '{"doc_id": "d1", "query": "a b"}\nd2\tc d\n')
    assert rows(readers.pseudo_queries(spark, p)) == [("d1", "a b"), ("d2", "c d")]


def test_json(spark, tmp_path):
    lines = put(tmp_path / "a.jsonl", '{"text_id": 1, "x": "a"}\n{"text_id": "s"}\n{"text_id": ["p", "q"]}\n')
    got = readers.json_records(spark, lines).select(F.variant_get("record", "$.text_id", "string").alias("t"))
    assert sorted(r.t for r in got.collect()) == ["1", '["p","q"]', "s"]
    array = put(tmp_path / "b.json", ' [{"k": "1"}, {"k": "2"}]')
    assert rows(readers.json_records(spark, array, "k string")) == [("1",), ("2",)]
    with pytest.raises(Exception, match="(?i)malformed|bad"):
        readers.json_records(spark, put(tmp_path / "c.jsonl", '{"k": \n{"k": "1"}\n'), "k string").collect()
    p = put(tmp_path / "d.json", json.dumps({"data": [{"a": 1}, {"a": 2}], "cols": {"a": [3, 4]}}))
    assert rows(readers.json_field(spark, p, "data", "a int")) == [(1,), (2,)]
    assert rows(readers.json_field(spark, p, "cols", "a int")) == [(3,), (4,)]
    with pytest.raises(KeyError, match="data"):
        readers.json_field(spark, p, "other", "a int")
    p = put(tmp_path / "e.json", json.dumps({"excluded_text_ids": ["a", "b"], "model_mining_excluded_text_ids": ["b", "c"]}))
    assert rows(readers.excluded_ids(spark, p)) == [("a",), ("b",), ("c",)]
    assert rows(readers.excluded_ids(spark, put(tmp_path / "f.json", '["z"]'))) == [("z",)]


def test_paths(tmp_path, monkeypatch):
    (tmp_path / "sets/x/y").mkdir(parents=True)
    for n in ("b", "a"):
        (tmp_path / "sets/x/y" / n).write_text("1")
    monkeypatch.setenv("DOCLOOM_DATASETS", str(tmp_path / "sets"))
    assert [p[-1] for p in readers.resolve("hf:dataset:x:y/")] == ["a", "b"]
    assert [p[-1] for p in readers.resolve(str(tmp_path / "sets/x/y/*"))] == ["a", "b"]
    with pytest.raises(FileNotFoundError):
        readers.resolve(str(tmp_path / "none*"))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("1", "a\tb", "ñ"), ("2", None, "c\nd")], "qid string, pos string, neg string")
    assert sinks.jsonl(df, str(tmp_path / "j")) == 2 and rows(spark.read.json(str(tmp_path / "j")).select("qid", "neg")) == [("1", "ñ"), ("2", "c\nd")]
    sinks.triples(df, str(tmp_path / "t"))
    assert rows(spark.read.text(str(tmp_path / "t"))) == [("1\ta b\tñ",), ("2\t\tc d",)]
    sinks.tsv(df, str(tmp_path / "g"), gzip=True)
    assert spark.read.text(str(tmp_path / "g")).count() == 2 and any(f.suffix == ".gz" for f in (tmp_path / "g").iterdir())
    sinks.json_array(df, str(tmp_path / "arr"))
    text = "".join(f.read_text(encoding="utf-8") for f in (tmp_path / "arr").glob("part-*"))
    assert [x["qid"] for x in json.loads(text)] == ["1", "2"]
    assert sinks.resume(df, str(tmp_path / "res"), "qid") == 2 and sinks.resume(df, str(tmp_path / "res"), "qid") == 0
    ok, bad = sinks.split_by(df, F.col("pos") != "x")
    assert (ok.count(), bad.count()) == (1, 1)


def test_projection_skips_bad_lines(spark, tmp_path):
    p = put(tmp_path / "l.jsonl", '{"id": 1, "content": "a", "more": 2}\n{"id": 2}\nno json\n[1]\n{"id": "x", "content": null}\n{"id": 3, "content": "c"\n')
    assert readers.json_projected(spark, p, {"id": "id", "content": "contents"}).columns == ["id", "contents"]
    assert {tuple(r) for r in readers.json_projected(spark, p, {"id": "id", "content": "contents"}).collect()} == {("1", "a"), ("x", None)}


def test_embedding_docs(spark, tmp_path):
    assert rows(readers.embedding_docs(spark, put(tmp_path / "d.jsonl", '{"docid": "D1", "body": "Text"}\n'))) == [("d1", "Text")]
    p = put(tmp_path / "nq.tsv", "q\t7\tl\ts\tt\ta\tc\tu\ttac\ten\nq\t8\tl\ts\tt\ta\tc\tu\t\ten\n")
    assert rows(readers.embedding_docs(spark, p, nq=True)) == [("7", "tac"), ("8", "")]


def test_listed_and_csv(spark, tmp_path):
    sinks.listed(spark.createDataFrame([("[d1]", [3, 4])], "docid string, code array<int>"), str(tmp_path / "c"))
    assert rows(readers.docid_codes(spark, str(tmp_path / "c" / "part-*"))) == [("[d1]", [3, 4])]
    sinks.csv(spark.createDataFrame([("mrr", 0.25)], "metric string, p double"), str(tmp_path / "p"))
    assert rows(readers.csv_table(spark, str(tmp_path / "p" / "part-*"))) == [("mrr", "0.25")]


def test_published(spark, tmp_path):
    at = str(tmp_path / "out")
    for n in (1, 2):
        sinks.published(spark, at, lambda p, n=n: sinks.jsonl(spark.range(n), p))
        assert spark.read.json(at).count() == n

    def fails(p):
        sinks.jsonl(spark.range(5), p)
        raise RuntimeError("stopped")

    with pytest.raises(RuntimeError, match="stopped"):
        sinks.published(spark, at, fails)
    assert spark.read.json(at).count() == 2
    assert [f.name for f in tmp_path.iterdir() if not f.name.endswith(".crc")] == ["out"]
