"""Importance resampling against its definition; the radix selection against sorting."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from docloom.llm.importance import PIECE, buckets_of, kth, resample

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text, grams=1):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + k]) for k in range(1, grams + 1) for i in range(len(words) - k + 1)]


def brute(rows, target, percent, least, grams=1, size=10_000, seed="2024"):
    bucket = lambda f: zlib.crc32(f.encode()) % size
    s = Counter(bucket(f) for _, text in rows for f in features(text, grams)[1])
    t = Counter(bucket(f) for text in target for f in features(text, grams)[1])
    sums, sumt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * float(sums + size) / ((s[b] + 1) * float(sumt + size))))
    out = []
    for doc_id, text in rows:
        words, found = features(text, grams)
        weight = sum(gain(bucket(f)) for f in found)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append((doc_id, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    may = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    n = len(may) * percent // 100
    left = Counter(may[n:]) + Counter(r for r in out if r[1] < least)
    return [(*r, k) for k, r in enumerate(may[:n], 1)] + [(*r, None) for r, n in left.items() for _ in range(n)]


def texts(seed=1):
    rnd = random.Random(seed)
    pool = ["alpha", "Beta", "é", "42", "x-y", "naïve", "日本", "a\x00b", "_", "THE", "q" * 40]
    rows = [(i, rnd.choice([" ", "\n", ", "]).join(rnd.choice(pool) for _ in range(rnd.choice([0, 1, 5, 30, 200])))) for i in range(150)]
    return rows + [(7, rows[30][1])] * 9 + [(7, "other words here " * 9), (None, "no id " * 30), (None, None), (200, None), (201, ""), (202, "!!! ..."), (-5, "minus five " * 20)], [" ".join(rnd.choice(pool[:5]) for _ in range(60)) for _ in range(6)]


@pytest.mark.parametrize(("percent", "least", "grams", "size"), [(10, 20, 1, 10_000), (100, 1, 3, 97), (37, 0, 2, 1000), (0, 20, 1, 50)])
def test_against_definition(spark, percent, least, grams, size):
    rows, target = texts()
    docs = spark.createDataFrame([(*r, 1, 2, 3, "k") for r in rows], "doc_id long, text string, score long, tie long, rank int, bucket string").repartition(5)
    goal = spark.createDataFrame([(t, 1) for t in target] + [(None, 2)], "text string, n int")
    got = resample(docs, goal, percent, least, grams, size).select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()
    assert Counter(map(tuple, got)) == Counter(brute(rows, target, percent, least, grams, size))


def test_text_comes_along(spark):
    rows, target = texts(2)
    got = resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string"), with_text=True).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)


def test_empty_tables(spark):
    rows, target = texts(3)
    docs, goal = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string")
    assert resample(docs.limit(0), goal).collect() == []
    got = resample(docs, goal.limit(0)).select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()
    assert Counter(map(tuple, got)) == Counter(brute(rows, [], 10, 20))


def test_long_text_in_pieces():
    rnd = random.Random(4)
    text = " ".join(rnd.choice(["a", "bb", "ccc", "dé"]) for _ in range(PIECE)) + " " + "z" * (PIECE + 5) + " end"
    for grams in (1, 3):
        words, found = 0, Counter()
        for n, b in buckets_of(text.encode(), grams, 10_000):
            words += n
            found.update(b.tolist())
        want, f = features(text, grams)
        assert words == len(want) and found == Counter(zlib.crc32(x.encode()) % 10_000 for x in f)
    assert np.concatenate([b for _, b in buckets_of(b"one", 3, 10)]).tolist() == [zlib.crc32(b"one") % 10]


def test_kth(spark):
    rnd = random.Random(5)
    ends = [-(2**63), 2**63 - 1, 0, -1, 1, 65_535, 65_536, -65_537, 10**12]
    rows = sorted({(rnd.choice([rnd.randint(-3, 3), *ends]), rnd.choice(ends), i) for i in range(300)})
    df = spark.createDataFrame(rnd.sample(rows, len(rows)), "a long, b long, c long")
    for k in (1, 2, 77, 150, 299, 300):
        assert kth(df, ["a", "b", "c"], k) == rows[k - 1]
    assert kth(df.select("c"), ["c"], 200) == (199,)
