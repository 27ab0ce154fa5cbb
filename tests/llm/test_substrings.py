"""Both substring operators against brute force."""

import hashlib
import random

import pytest

from docloom.llm.substrings import remove_repeats
from docloom.llm.suffixes import remove_later_copies

KINDS = "doc_id long, text string, lang string, blk int"


def corpus():
    rnd = random.Random(7)
    words = [f"{rnd.choice('abcdeé')}{rnd.choice('xyzß')}{i % 40}" for i in range(160)]
    make = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passage, line = make(60), make(40)
    rows = [(i, make(rnd.randint(1, 120))) for i in range(60)]
    rows += [(100 + i, f"{make(10)} {passage}\n{make(20)}") for i in range(12)]
    rows += [(200 + i, f"{line}\t{make(5)}  {line}") for i in range(4)]
    rows += [(300 + i, make(90)) for i in range(3)]
    rows += [(400 + i, rows[-1][1]) for i in range(9)]
    near = make(300).split(" ")
    for i in range(10):
        w = list(near)
        w[rnd.randrange(300)] = "edited"
        rows.append((500 + i, " ".join(w)))
    rows += [(600, "same " * 400), (601, "same " * 90), (602, None), (603, ""), (604, " \n\t"), (605, "x" * 300), (606, "x" * 120), (607, "é" * 60), (608, "é" * 40)]
    rows += [(None, passage), (None, "alone " + line), (605, "x" * 300), (5, rows[5][1])]
    return [(*r, "en", 1) for r in rows]


def words_of(t):
    return (t or "").encode().split()


def brute_words(rows, window):
    where = {}
    for i, r in enumerate(rows):
        w = words_of(r[1])
        for k in range(len(w) - window + 1):
            where.setdefault(tuple(w[k : k + window]), []).append((i, k))
    gone = [set() for _ in rows]
    for at in where.values():
        if len(at) > 1:
            for i, k in at:
                gone[i].update(range(k, k + window))
    out = []
    for r, g in zip(rows, gone):
        w = words_of(r[1])
        kept = b" ".join(x for k, x in enumerate(w) if k not in g)
        out.append((r[0], len(w), len(g), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def brute_bytes(rows, window):
    least = {}
    big = 2**63
    for r in rows:
        b = (r[1] or "").encode()
        for k in range(len(b) - window + 1):
            s = b[k : k + window]
            least[s] = min(least.get(s, big), big if r[0] is None else r[0])
    out = []
    for r in rows:
        b = (r[1] or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - window + 1):
            if least[b[k : k + window]] < (big if r[0] is None else r[0]):
                gone[k : k + window] = [True] * window
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((r[0], len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [35, 80, 7])
def test_words(spark, window):
    rows = corpus()
    got = remove_repeats(spark.createDataFrame(rows, KINDS), window)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()), key=str) == brute_words(rows, window)


@pytest.mark.parametrize("window", [50, 21])
def test_bytes(spark, window):
    rows = corpus()
    got = remove_later_copies(spark.createDataFrame(rows, KINDS), window)
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()), key=str) == brute_bytes(rows, window)


def test_heavy_grams_are_cut(spark, monkeypatch):
    from docloom.llm import blocks

    def low(group):
        blocks.HEAVY = 2  # in the worker
        return blocks.count_votes(group)

    monkeypatch.setattr("docloom.llm.suffixes.voted", lambda b: b.groupBy("bucket").applyInArrow(low, "blk int, payload binary"))
    rows = corpus()
    got = remove_later_copies(spark.createDataFrame(rows, KINDS))
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()), key=str) == brute_bytes(rows, 50)


def test_empty(spark):
    none = spark.createDataFrame([], KINDS)
    assert remove_repeats(none).collect() == [] and remove_later_copies(none).collect() == []
    nulls = spark.createDataFrame([(None, None, None, None)] * 2, KINDS)
    assert [r.n_words for r in remove_repeats(nulls).collect()] == [0, 0]
    assert [r.n_bytes for r in remove_later_copies(nulls).collect()] == [0, 0]


def test_buckets_are_even():
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    from docloom.llm.blocks import Rolling, bucket_of
    from docloom.llm.substrings import Words, _anchors
    from docloom.llm.suffixes import Bytes

    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text"]).slice(0, 2500)
    b = Bytes(texts, 50, 16)
    grams, one = np.unique(b.gram, return_index=True)
    w = Words(texts.column("text").to_pylist())
    roll = Rolling(w.hash)
    words = np.unique(roll(np.unique(_anchors(w, roll, 35, 9)[1]), 9))
    for keys, weight in ((grams, b.size[one]), (words, None)):
        load = np.bincount(bucket_of(keys, 64), weight, 64)
        assert load.max() < 2 * load.mean()
    assert isinstance(texts, pa.Table)


def test_shards_are_merged_like_sorted_suffixes():
    import numpy as np

    from docloom.llm.suffixes import merge_shards

    rnd = random.Random(11)
    for window, gram in ((12, 4), (9, 9), (7, 3), (8, 5)):
        span = window - gram + 1
        rows = []
        for _ in range(300):
            left, more = rnd.randrange(span), rnd.randrange(span)
            right = max(window - left, min(gram + more, window))
            g = rnd.choice(["\x00" * gram, "a" * gram, "ab" * gram])[:gram]
            body = lambda n: "".join(rnd.choice("a\x00b") for _ in range(n))
            rows.append((left, (body(left) + g + body(right - gram)).encode(), g, rnd.randrange(50)))
        size = np.array([len(r[1]) for r in rows])
        begin = np.cumsum(size) - size
        got = merge_shards(np.frombuffer(b"".join(r[1] for r in rows), np.uint8), begin, np.array([r[0] for r in rows]), size, np.array([r[3] for r in rows]), window, gram)
        least, want = {}, []
        for left, s, g, i in rows:
            for k in range(len(s) - window + 1):
                x = (g, left - k, s[k : k + window])
                least[x] = min(least.get(x, 99), i)
                want.append(x)
        assert got.tolist() == [least[x] for x in want]


def test_very_long_texts_and_clashing_columns(spark):
    rnd = random.Random(4)
    long = " ".join(f"u{rnd.randrange(10**9)}" for _ in range(60_000))
    rows = [(1, "a" * 300_000), (2, "ab" * 200_000), (3, "a" * 100_000), (4, long), (5, long[1000:200_000]), (6, "x" + long)]
    docs = spark.createDataFrame([(*r, 1, "p", 2) for r in rows], "doc_id long, text string, blk int, payload string, n_removed int")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in remove_later_copies(docs).collect()}
    assert got == {1: (300_000, 0, 0), 2: (400_000, 0, 0), 3: (100_000, 100_000, 1), 4: (len(long), 0, 0), 5: (199_000, 199_000, 1), 6: (len(long) + 1, len(long), 1)}
    got = {r.doc_id: (r.n_words, r.n_removed) for r in remove_repeats(docs).collect()}
    assert got[4] == (60_000, 59_999) and got[6] == (60_000, 59_999) and got[1] == (1, 0)
