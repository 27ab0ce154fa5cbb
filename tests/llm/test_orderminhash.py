"""Order MinHash classes against all pairs by brute force."""

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from docloom.llm.components import components
from docloom.llm.orderminhash import aligned, alike, keep_first_of_class, least_runs, near_classes, runs, shingles

KINDS = "doc_id long, text string, lang string, source string, key int, label string"


def corpus():
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    make = lambda n: [rnd.choice(words) for _ in range(n)]
    texts = [make(rnd.randint(5, 200)) for _ in range(60)]
    for _ in range(12):
        base = make(rnd.randint(80, 400))
        texts.append(base)
        for _ in range(rnd.randint(1, 25)):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, len(w) // 60))):
                w[rnd.randrange(len(w))] = rnd.choice(words)
            texts.append(w)
    base = make(200)
    texts += [base, base[100:] + base[:100]]  # the same shingles in another order are no copy
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rows += [(900, "two words"), (901, "two words"), (902, "two  words"), (903, None), (904, None), (905, ""), (906, " \n"), (907, "again " * 300), (908, "again " * 320), (7, rows[9][1]), (None, rows[9][1]), (910, rows[9][1]), (910, rows[9][1])]
    return [(*r, "en", "s", 1, "x") for r in rows]


def words(text):
    return np.array([xxhash.xxh32_intdigest(x) for x in text.split()], np.uint32)


def brute(rows):
    texts = sorted({r[1] for r in rows if r[1] and r[1].split()})
    seqs = [words(t) for t in texts]
    up = list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if min(len(seqs[i]), len(seqs[j])) >= 5 and alike(seqs[i], seqs[j]):
                up[find(i)] = find(j)
    groups = {}
    for r in rows:
        if r[1] in texts:
            groups.setdefault(find(texts.index(r[1])), []).append(r[0])
    return {t: (min((x for x in groups[find(k)] if x is not None), default=None), len(groups[find(k)])) for k, t in enumerate(texts)}


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_alike_is_lcs(monkeypatch):
    from docloom.llm import orderminhash

    rnd = random.Random(5)
    both = set()
    for bits in (4096, 7):
        monkeypatch.setattr(orderminhash, "BITS", bits)
        for _ in range(600):
            vocabulary = rnd.choice([2, 8, 60])
            a = [f"{rnd.randrange(vocabulary)}" for _ in range(rnd.randint(1, 60))]
            b = list(a)
            for _ in range(rnd.randint(0, 8)):
                k = rnd.randrange(len(b) + 1)
                b[k : k + rnd.randint(0, 2)] = [f"{rnd.randrange(vocabulary)}" for _ in range(rnd.randint(0, 2))]
            x, y, n = words(" ".join(a)), words(" ".join(b)), lcs(a, b)
            assert aligned(x, y, len(a) + len(b)) == n
            want = bool(b) and n / (len(a) + len(b) - n) >= 0.8 - 1e-12
            assert alike(x, y) == want
            if want:
                assert len(np.intersect1d(runs(x), runs(y))) >= least_runs(len(a) + len(b), 0.8)
            both.add(want)
    assert both == {False, True}


def test_classes(spark):
    rows = corpus()
    got = near_classes(spark.createDataFrame(rows, KINDS)).collect()
    want = brute(rows)
    texts = {}
    for r in rows:
        texts.setdefault(r[0], []).append(r[1])
    assert len(got) == len(rows)
    for r in got:
        ok = [want[t] if t in want else (r.doc_id, 1) for t in texts[r.doc_id]]
        assert (r.class_id, r.class_size) in ok, (r.doc_id, r.class_id, ok)


def test_keep(spark):
    rows = corpus()
    kept = keep_first_of_class(spark.createDataFrame(rows, KINDS))
    assert kept.columns == [x.split()[0] for x in KINDS.split(", ")]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in kept.collect())
    want = brute(rows)
    keep = {(c[0], t) for t, c in want.items() if any(r[0] == c[0] and r[1] == t for r in rows)}
    keep |= {(r[0], r[1] or "") for r in rows if not (r[1] or "").split()}
    assert got == sorted(keep)


def test_empty(spark):
    none = spark.createDataFrame([], KINDS)
    assert near_classes(none).collect() == [] and keep_first_of_class(none).collect() == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(30) if i % 10 != 9] + [(100, i) for i in range(101, 200)] + [(5, 100)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: i // 10 * 10 for i in range(30)}, **{i: 0 for i in range(100, 200)}}


def test_every_pair_of_a_bucket_is_tested(spark):
    # a hub of many texts that share a start draws the pivots; two near copies share their only bucket with it
    rnd = random.Random(9)
    start = [f"s{i}" for i in range(100)]
    rows = [(i, " ".join(start + [f"x{rnd.randrange(10**6)}" for _ in range(30)])) for i in range(60)]
    twin = start + [f"y{i}" for i in range(30)]
    rows += [(100, " ".join(twin)), (101, " ".join([*twin[:-1], "z"]))]
    got = {r.doc_id: r.class_id for r in near_classes(spark.createDataFrame(rows, "doc_id long, text string"), bands=1, rows=1, block_bytes=1500, most_broadcast=0).collect()}
    texts = [t for _, t in sorted(rows)]
    from docloom.llm.orderminhash import sketch

    shared = [sketch(s, 1, 1)[0] for s in shingles(texts)]
    assert shared[-1] == shared[-2] and shared.count(shared[-1]) > 10
    assert got[101] == 100 and got[100] == 100 and all(got[i] == i for i in range(60))


def test_blocks_lose_no_link(spark):
    rows = corpus()
    whole = {(r.doc_id, r.key, r.class_id, r.class_size) for r in near_classes(spark.createDataFrame(rows, KINDS)).collect()}
    assert {(r.doc_id, r.key, r.class_id, r.class_size) for r in near_classes(spark.createDataFrame(rows, KINDS), block_bytes=700).collect()} == whole


def test_recall_on_real_text_with_planted_edits(spark):
    # chains of edits, inserted and dropped passages over real text, against all pairs
    rnd = random.Random(12)
    real = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if r.text and 60 < len(r.text.split()) < 600]
    rows = [(i, t) for i, t in enumerate(real)]
    for base in rnd.sample(real, 25):
        w = base.split()
        for _ in range(6):
            w = list(w)
            for _ in range(max(1, len(w) // 70)):
                k = rnd.randrange(len(w))
                w[k : k + rnd.randint(0, 2)] = [f"e{rnd.randrange(99)}"] * rnd.randint(0, 2)
            rows.append((len(rows), " ".join(w)))
    want = brute([(*r, "en", "s", 1, "x") for r in rows])
    got = {r.doc_id: (r.class_id, r.class_size) for r in near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    copies = [(i, t) for i, t in rows if want[t][1] > 1]
    assert len(copies) > 150 and sum(got[i] == want[t] for i, t in copies) >= 0.99 * len(copies)
    assert all(got[i] == want[t] for i, t in rows if want[t][1] == 1)


def test_recall_where_words_are_edited(spark):
    # a twentieth and a tenth of the words replaced, each by another; all are alike by their words
    rnd = random.Random(14)
    real = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if r.text and 60 < len(r.text.split()) < 600]
    rows, pairs = [(i, t) for i, t in enumerate(real)], {}
    for share in (0.01, 0.05, 0.1):
        for i in rnd.sample(range(len(real)), 40):
            w = real[i].split()
            for k in rnd.sample(range(len(w)), int(len(w) * share)):
                w[k] = f"e{rnd.randrange(9999)}"
            if alike(words(real[i]), words(" ".join(w))):
                pairs.setdefault(share, []).append((i, len(rows)))
            rows.append((len(rows), " ".join(w)))
    got = {r.doc_id: r.class_id for r in near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for share, of in pairs.items():
        assert len(of) > 30 and sum(got[a] == got[b] for a, b in of) >= 0.9 * len(of), share


def test_clashing_columns_and_long_texts(spark):
    rnd = random.Random(13)
    long = " ".join(f"u{rnd.randrange(10**6)}" for _ in range(150_000))
    rows = [(2, long, 1, "a"), (1, long + " more", 2, "b"), (3, "short", 3, "c"), (None, None, 4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, repeated int, keep_id string").withColumns({"keep_key": F.lit(1), "_id0": F.lit(1), "_AGAIN0": F.lit(2), "key": F.lit(3)})
    kept = keep_first_of_class(docs)
    assert kept.columns == docs.columns and sorted(r.repeated for r in kept.collect()) == [2, 3, 4]
