"""Codebooks, codes and nearest neighbours in blocks, against numpy over all rows."""

import random

import numpy as np
import pytest

from docloom.operators import docids, vectors


def made(spark, n=400, width=24, seed=1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, width)), 3).astype(np.float32)
    x[5] = x[6]
    return x.astype(np.float64), spark.createDataFrame([(i, v.tolist(), "k") for i, v in enumerate(x)], "id long, x array<float>, codes_of string").repartition(5)


def brute(x, words):
    return np.round(((x[:, None] - words[None]) ** 2).sum(2), 9).argmin(1)


def test_codes(spark):
    x, df = made(spark)
    books = np.split(np.concatenate([x[:15], x[3:4]]), 4, axis=1)  # a word twice: the first of equals counts
    got = {r.id: r.codes for r in vectors.encode(df, "x", books).collect()}
    want = np.stack([brute(x[:, 6 * m : 6 * m + 6], b) for m, b in enumerate(books)], 1)
    assert np.array_equal(np.array([got[i] for i in range(len(x))]), want) and (want < 15).all()
    levels, rest, codes = [x[:16], x[16:32] * 0.5], x.copy(), []
    for words in levels:
        codes.append(brute(rest, words))
        rest = rest - words[codes[-1]]
    got = {r.id: r.codes for r in vectors.encode(df, "x", levels, residual=True).collect()}
    assert np.array_equal(np.array([got[i] for i in range(len(x))]), np.stack(codes, 1))
    assert vectors.encode(df.where("false"), "x", books).collect() == []


def test_one_step_moves_words_to_means(spark):
    x, df = made(spark, seed=2)
    books = np.split(x[:8].copy(), 3, axis=1)
    books[1][7] = 1e6  # nothing is near it: it stays
    moved, error = vectors.lloyd_step(df, "x", books)
    total = 0.0
    for m, words in enumerate(books):
        part = x[:, 8 * m : 8 * m + 8]
        code = brute(part, words)
        want = np.array([part[code == k].mean(0) if (code == k).any() else words[k] for k in range(8)])
        assert np.allclose(moved[m], want, atol=1e-6)
        total += ((part - words[code]) ** 2).sum()
    assert error == pytest.approx(total, abs=1e-3)


def test_codebooks_do_not_depend_on_partitions(spark):
    _, df = made(spark, seed=3)
    for train in (lambda d: vectors.product_books(d, "id", "x", 4, 8, 4), lambda d: vectors.residual_books(d, "id", "x", 2, 8, 4)):
        one, many = train(df.coalesce(1)), train(df.repartition(9, "id"))
        assert all((a == b).all() for a, b in zip(one, many, strict=True))
    with pytest.raises(ValueError, match="as many"):
        vectors.product_books(df.limit(3), "id", "x", 4, 8)


def test_training_lowers_the_error(spark):
    _, df = made(spark, seed=4)
    books, errors = np.split(vectors.seeds(df, "id", "x", 8, "s"), 4, axis=1), []
    for _ in range(5):
        books, error = vectors.lloyd_step(df, "x", books)
        errors.append(error)
    assert errors == sorted(errors, reverse=True)


@pytest.mark.parametrize(("lists", "probes", "k"), [(16, 1, 5), (16, 4, 1), (1, 1, 7), (16, 2, 1000)])
def test_neighbours_are_exact(spark, lists, probes, k):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 16))
    x = np.concatenate([c + 0.1 * rng.normal(size=(30, 16)) for c in centres])
    x[7] = x[8]
    x[9] = 0  # no direction: nobody's neighbour
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None)]
    df = spark.createDataFrame(rows, "id long, x array<double>").repartition(4)
    index = vectors.Lists(df, "id", "x", lists=lists, parts=4, k=8)
    asked = df.where("id % 10 = 0 or id in (7, 9)").selectExpr("id as query_id", "x as q").where("q is not null")
    got = {}
    for r in vectors.neighbours(index, asked, k, probes).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.cosine))
    unit = x / np.maximum(1e-300, np.sqrt((x * x).sum(1)))[:, None]
    for q in [7, *range(0, 360, 10)]:
        cosine = np.round(unit @ unit[q], 9)
        others = [i for i in range(len(x)) if i not in (q, 9)]
        want = sorted(others, key=lambda i: (-cosine[i], i))[:k]
        assert [v for _, v, _ in sorted(got[q])] == want
    assert 9 not in got and len(got) == 37


def test_far_lists_are_not_read(spark):
    """Groups far from each other: the bound rules out most lists."""
    rng = np.random.default_rng(7)
    x = np.concatenate([c + 0.01 * rng.normal(size=(40, 16)) for c in rng.normal(size=(10, 16))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    index = vectors.Lists(df, "id", "x", lists=10, parts=4, k=8)
    read = []
    asked = df.where("id % 40 = 0").selectExpr("id as query_id", "x as q", "2 - 1.99D as tau")
    for r in asked.collect():
        q = np.array(r.q) / np.linalg.norm(r.q)
        to = np.linalg.norm(index.coarse - q, axis=1)
        read.append(sum(max(to[n] - far, near - to[n], 0) <= 0.2 for n, (_, near, far) in index.facts.items()))
    assert sum(read) < 0.5 * len(read) * len(index.facts)


def test_mean_embedding_shuffles_no_dimensions(spark, monkeypatch):
    """Means by brute force, whether vectors are broadcast or joined; rows are not dealt by document and dimension."""
    rnd = random.Random(4)
    vecs = {i: [rnd.randint(-50, 50) / 4 for _ in range(6)] for i in range(12)}
    keyed = [(f"d{rnd.randint(0, 30)}", rnd.choice([*range(12), 99])) for _ in range(200)] + [("e", 3), ("e", 3), ("e", 0), ("f", 99), ("g", None)]
    want = {}
    for doc in {k for k, _ in keyed}:
        own = [vecs[0], *(vecs[v] for k, v in keyed if k == doc and v in vecs)]
        want.update({(doc, i + 1): round(sum(v[i] for v in own) / len(own), 9) for i in range(6)})
    vectors = spark.createDataFrame(list(vecs.items()), "vec_id long, embedding array<float>")
    rows = spark.createDataFrame(keyed, "docid string, vec_id long").repartition(3)
    for most in (50_000, 0):
        monkeypatch.setattr(docids, "BROADCAST_VECTORS", most)
        monkeypatch.setattr(docids, "SUMS", 40)
        got = docids.mean_embedding(rows, vectors, 0)
        assert {(r.docid, r.i): round(r.v, 9) for r in got.collect()} == want
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in plan.splitlines() if "Exchange hashpartitioning(docid" in x and "ENSURE_REQUIREMENTS" in x]
