"""The stored index against the plain search and brute force; manifests."""

import random
from collections import Counter

import pytest

from docloom.operators import bm25, index
from docloom.sources import manifest


def corpus(spark, n=300, seed=1):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    rows = [(f"d{i:03}", " ".join(rnd.choices(words, weights, k=rnd.choice([0, 1, 5, 40, 120])))) for i in range(n)]
    rows += [("x1", None), ("x2", ""), ("x3", rows[3][1]), ("x4", rows[3][1])]
    return rows, spark.createDataFrame(rows, "docid string, contents string").repartition(3)


def test_search_is_the_plain_search(spark, tmp_path):
    _, docs = corpus(spark)
    queries = spark.createDataFrame([("q1", "w50 w51 w0"), ("q2", "w0"), ("q3", "nothing here"), ("q4", "w1 w2 w3 w30 w40 w59"), ("q5", ""), ("q6", None), ("q7", "w59 w58")], "qid string, query string")
    index.build(docs, str(tmp_path / "ix"))
    ix = index.Index(spark, str(tmp_path / "ix"))
    for k in (1, 5, 40, 1000):
        want = sorted(bm25.top_k(queries, docs, k).collect())
        got, counts = index.search_counted(ix, queries, k)
        assert sorted(got.collect()) == want
        c = counts.first()
        assert c.scored <= c.read <= c.pairs == 7 * 304
    assert sorted(index.search(ix, queries, 5, 2.16, 0.61).collect()) == sorted(bm25.top_k(queries, docs, 5, 2.16, 0.61).collect())


def test_blocks_cut_by_batches(spark, tmp_path):
    """Where a batch ends inside a block, a term has two rows of it, and each of its postings counts once."""
    _, docs = corpus(spark)
    queries = spark.createDataFrame([("q1", "w50 w51 w0"), ("q2", "w0"), ("q3", "w1 w2 w3 w30 w40 w59")], "qid string, query string")
    usual = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        index.build(docs, str(tmp_path / "ix"))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", usual)
    ix = index.Index(spark, str(tmp_path / "ix"))
    assert not ix.postings.groupBy("term", "block").count().where("count > 1").isEmpty()
    for k in (1, 5, 40, 1000):
        assert sorted(index.search(ix, queries, k).collect()) == sorted(bm25.top_k(queries, docs, k).collect())


def test_tasks_hold_few_tokens(spark, tmp_path, monkeypatch):
    """An index is made of slices of a batch, of whole blocks, and is the same index."""
    import pyarrow as pa

    rows = [(i + 30, ["a", "b", "a"] * (i % 7)) for i in range(400)]
    batch = pa.RecordBatch.from_pydict({"docid": [str(n) for n, _ in rows], "contents": [" ".join(t) for _, t in rows], "toks": [t for _, t in rows], "docno": [n for n, _ in rows]})
    whole = pa.Table.from_batches(index._blocks([batch])).sort_by([("term", "ascending"), ("block", "ascending")])
    docs = pa.Table.from_batches(index._forward([batch]))
    seen, plain = [], index._counted
    monkeypatch.setattr(index, "TOKENS", 500)
    monkeypatch.setattr(index, "_counted", lambda toks: (seen.append(len(toks.flatten())), plain(toks))[1])
    assert pa.Table.from_batches(index._blocks([batch])).sort_by([("term", "ascending"), ("block", "ascending")]).combine_chunks().equals(whole.combine_chunks())
    assert pa.Table.from_batches(index._forward([batch])).combine_chunks().equals(docs.combine_chunks())
    assert len(seen) > 8 and max(seen) < 500 + 64 * 18 and len(whole) == 2 * 7


def test_few_pairs_are_scored(spark, tmp_path):
    """Rare words decide; common ones alone never reach the threshold."""
    rnd = random.Random(2)
    rows = [(f"d{i}", " ".join(["the", "of", *(f"r{rnd.randint(0, 400)}" for _ in range(12))])) for i in range(3000)]
    docs = spark.createDataFrame(rows, "docid string, contents string")
    queries = spark.createDataFrame([(f"q{i}", f"the of r{i} r{i + 100} r{i + 200}") for i in range(20)], "qid string, query string")
    index.build(docs, str(tmp_path / "ix"))
    got, counts = index.search_counted(index.Index(spark, str(tmp_path / "ix")), queries, 10)
    assert sorted(got.collect()) == sorted(bm25.top_k(queries, docs, 10).collect())
    c = counts.first()
    assert c.scored < 0.03 * c.pairs and c.read < 0.15 * c.pairs


def test_phrases(spark, tmp_path):
    rows, docs = corpus(spark, 200, 3)
    index.build(docs, str(tmp_path / "ix"))
    asked = [("a", "w0 w1"), ("b", "w0 w0"), ("c", "w0 w0 w1"), ("d", "W2"), ("e", "w0 unknown"), ("f", ""), ("g", None), ("h", "w1, w0! w1"), ("i", "w0 w1")]
    want = Counter()
    for pid, phrase in asked:
        p = [w for w in (phrase or "").lower().replace(",", "").replace("!", "").split()]
        for docid, text in rows:
            t = (text or "").split()
            for i in range(len(t) - len(p) + 1):
                if p and t[i : i + len(p)] == p:
                    want[pid, docid] += 1
    got = index.phrases(index.Index(spark, str(tmp_path / "ix")), spark.createDataFrame(asked, "pid string, phrase string"))
    assert {(r.pid, r.docid): r.n for r in got.collect()} == dict(want)


def test_empty_index(spark, tmp_path):
    docs = spark.createDataFrame([], "docid string, contents string")
    index.build(docs, str(tmp_path / "ix"))
    ix = index.Index(spark, str(tmp_path / "ix"))
    asked = spark.createDataFrame([("q", "a b")], "qid string, query string")
    assert index.search(ix, asked).collect() == [] and index.phrases(ix, asked.toDF("pid", "phrase")).collect() == []


def test_two_runs_one_build(spark, tmp_path, monkeypatch):
    built, plain = [], index.build
    monkeypatch.setattr(index, "build", lambda *a: (built.append(1), plain(*a)))
    docs = spark.createDataFrame([("a", "one two"), ("b", "two three")], "docid string, contents string")
    docs.write.parquet(str(tmp_path / "docs"))
    read = lambda: spark.read.parquet(str(tmp_path / "docs"))
    asked = spark.createDataFrame([("q", "two one")], "qid string, query string")
    at = str(tmp_path / "ix")
    first = index.search(index.opened(read(), at, tokens="words"), asked).collect()
    assert index.search(index.opened(read(), at, tokens="words"), asked).collect() == first and len(built) == 1
    index.opened(read(), at, tokens="others")
    assert len(built) == 2
    spark.createDataFrame([("c", "one")], docs.schema).write.mode("append").parquet(str(tmp_path / "docs"))
    assert {r.docid for r in index.search(index.opened(read(), at, tokens="others"), asked).collect()} == {"a", "b", "c"} and len(built) == 3


def test_manifest(spark, tmp_path):
    at = str(tmp_path / "result")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string")
    mark = manifest.fingerprint({"k": 1}, df)
    assert mark == manifest.fingerprint({"k": 1}, df.orderBy("x", ascending=False)) != manifest.fingerprint({"k": 2}, df)
    assert mark != manifest.fingerprint({"k": 1}, df.where("x = 1")) and mark != manifest.fingerprint({"k": 1}, df.union(df).union(df))
    with pytest.raises(FileNotFoundError):
        manifest.reuse(spark, at, mark)
    first = manifest.publish(spark, at, mark, df.write.parquet)
    assert manifest.reuse(spark, at, mark) == first
    with pytest.raises(manifest.Stale):
        manifest.reuse(spark, at, "other")

    # a crash while a version is written, and one before the pointer changes: the old result stays
    def torn(folder):
        df.write.parquet(folder)
        raise OSError("lost")

    with pytest.raises(OSError, match="lost"):
        manifest.publish(spark, at, "new", torn)
    monkey = pytest.MonkeyPatch()
    monkey.setattr(manifest, "_point", lambda *a: torn(str(tmp_path / "elsewhere")))
    with pytest.raises(OSError, match="lost"):
        manifest.publish(spark, at, "new", df.write.parquet)
    monkey.undo()
    assert manifest.reuse(spark, at, mark) == first and spark.read.parquet(first).count() == 2
    second = manifest.publish(spark, at, "new", df.limit(1).write.parquet)
    assert manifest.current(spark, at)["previous"] == first.rsplit("/", 1)[1]
    assert spark.read.parquet(manifest.reuse(spark, at, "new")).count() == 1
    # what crashes left goes once it is old; the current version and the one before stay
    assert manifest.sweep(spark, at) == 0 and manifest.sweep(spark, at, -60) == 2
    assert spark.read.parquet(first).count() == 2 and spark.read.parquet(second).count() == 1
    assert manifest.made(spark, at, "new", lambda _: pytest.fail("made again")) == second


def test_both_ways_of_plain_search(spark, monkeypatch):
    """Terms that go to all tasks and terms that are joined give the same ranks: ties, batches, few documents a query."""
    _, docs = corpus(spark)
    odd = docs.unionByName(spark.createDataFrame([(None, "w1 w2"), *((f"t{i}", "w0 w50") for i in range(40))], docs.schema))
    queries = [("q1", "w50 w51 w0"), ("q2", "w0"), ("q3", "nothing here"), ("q4", "w1 w2 w3 w30 w40 w59"), ("q5", ""), ("q6", None)]
    asked = spark.createDataFrame(queries + [(f"r{i}", f"w{i} x{i}") for i in range(60)], "qid string, query string")
    nothing = spark.createDataFrame([], docs.schema)
    usual = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "30")
    try:
        for k in (1, 7, 1000):
            monkeypatch.setattr(bm25, "BROADCAST_TERMS", 1_000_000)
            monkeypatch.setattr(bm25, "PARTS", 50)
            monkeypatch.setattr(bm25, "WAITING", 20)
            got = bm25.top_k(asked, odd, k)
            assert bm25.top_k(asked, nothing, k).collect() == [] and bm25.top_k(asked.limit(0), odd, k).collect() == []
            rows = {tuple(r) for r in got.collect()}
            monkeypatch.setattr(bm25, "BROADCAST_TERMS", 0)
            assert rows == {tuple(r) for r in bm25.top_k(asked, odd, k).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", usual)


def test_plain_search_holds_few_pairs(spark):
    """Pairs of queries and documents are not grouped one by one: a task gives on what may be among the best."""
    _, docs = corpus(spark)
    plan = bm25.top_k(spark.createDataFrame([("q", "w0 w1")], "qid string, query string"), docs, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Aggregate [qid" not in plan


def test_rows_given_on_do_not_grow(spark):
    """Eight times the documents, copies among them, in as many tasks: the ranking reads no more rows than k a query and task, twice."""
    k, asked = 5, spark.createDataFrame([("a", "w0 w1"), ("b", "w2 w0")], "qid string, query string")
    terms = asked.selectExpr("qid", "explode(split(query, ' ')) as term")
    texts = [" ".join(f"w{random.Random(i).randint(0, 9)}" for i in range(j, j + 20 + j % 7)) for j in range(400)]
    pairs, given = [], []
    for times in (1, 8):
        rows = [(f"d{n}-{i}", x if n % 2 else f"{x} {n}") for n in range(times) for i, x in enumerate(texts)]
        docs = spark.createDataFrame(rows, "docid string, contents string").repartition(2)
        pairs.append(bm25._joined(terms, docs, 0.82, 0.68, bm25.tokenize).count())
        given.append(bm25._told(terms, docs, k, 0.82, 0.68, bm25.tokenize).count())
    assert pairs[1] > 7 * pairs[0] > 2000 and max(given) <= 2 * k * 2 * 2


def shuffled(spark):
    """Bytes that the session has shuffled so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    return sc.statusStore().executorSummary("driver").totalShuffleWrite()


def test_index_shuffles_little(spark, tmp_path):
    """A build moves neither texts nor postings; a search moves postings of its terms once, however many queries share them."""
    rnd = random.Random(4)
    rows = [(f"d{i}", " ".join(f"w{int(rnd.paretovariate(0.6))}" for _ in range(80))) for i in range(4000)]
    docs = spark.createDataFrame(rows, "docid string, contents string").repartition(8).cache()
    docs.count()
    began = shuffled(spark)
    index.build(docs, str(tmp_path / "ix"))
    built = shuffled(spark) - began
    assert built < 0.02 * sum(len(text) for _, text in rows)
    ix, moved = index.Index(spark, str(tmp_path / "ix")), []
    for n in (5, 100):
        asked = spark.createDataFrame([(f"q{i}", "w1 w2 w3") for i in range(n)], "qid string, query string")
        began = shuffled(spark)
        got = sorted(index.search(ix, asked, 1).collect())
        moved.append(shuffled(spark) - began)
        assert got == sorted(bm25.top_k(asked, docs, 1).collect()) and len(got) == n
    assert moved[1] < 3 * moved[0]


def test_search_in_groups_and_slices(spark, tmp_path, monkeypatch):
    """More terms than go to all tasks at once, slices of few sums, and copies that tie: the same ranks."""
    _, docs = corpus(spark)
    odd = docs.unionByName(spark.createDataFrame([*((f"t{i}", "w0 w50") for i in range(150))], docs.schema))
    queries = [("q1", "w50 w51 w0"), ("q2", "w0"), ("q3", "nothing here"), ("q4", "w1 w2 w3 w30 w40 w59"), ("q5", ""), ("q6", None)]
    asked = spark.createDataFrame(queries, "qid string, query string")
    index.build(odd, str(tmp_path / "ix"))
    ix = index.Index(spark, str(tmp_path / "ix"))
    want = [sorted(bm25.top_k(asked, odd, k).collect()) for k in (3, 1000)]
    for name, value in (("BROADCAST_TERMS", 4), ("PARTS", 50), ("WAITING", 20)):
        monkeypatch.setattr(index, name, value)
    assert [sorted(index.search(ix, asked, k).collect()) for k in (3, 1000)] == want


def test_blocks_are_whole():
    """Rows of a block that lie in several batches meet in one."""
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"block": x}) for x in ([0, 0, 1], [1, 1], [], [1], [2], [3, 3, 4])]
    batches = [b.cast(pa.schema([("block", pa.int64())])) if not len(b) else b for b in batches]
    got = [b.column("block").to_pylist() for b in index._whole_blocks(batches)]
    assert sum(got, []) == [0, 0, 1, 1, 1, 1, 2, 3, 3, 4]
    assert all(x[-1] != y[0] for x, y in zip(got, got[1:])) and len(got) > 2
