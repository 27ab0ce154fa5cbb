"""Decontamination and mixing."""

import math
import random

import pytest
from pyspark.sql import functions as F

from docloom.llm.decontaminate import contaminated, drop_contaminated, tokens
from docloom.llm.mixing import BUCKETS, DOMAINS, TARGETS, fit_rates, mix, mixing_rates, rate

KINDS = "doc_id long, text string, lang string, source string, item_id long, h int, pos string"


def docs_of(rows):
    return [(*r, "en", "s", 1, 2, "x") for r in rows]


ITEM = "Today, Alice buys 12 apples for 3.50 dollars each, and then Alice gives 4 of the apples to Robert before the shop closes at night."
PLAIN = "the quick brown fox jumps over the lazy dog while seven small birds watch from an old wooden fence near the river"


def test_tokens(spark):
    got = spark.createDataFrame([(ITEM,)], "t string").select(tokens(F.col("t")).alias("x")).first().x
    assert "\x02n12" in got and "\x02n3\x0350" in got and "\x02udollars" in got and "\x02probert" in got and "apples" in got


def test_leaks(spark):
    rnd = random.Random(2)
    filler = lambda n: " ".join(f"w{rnd.randrange(500)}x" for _ in range(n))
    other = ITEM.replace("Alice", "Carol").replace("12", "30").replace("3.50", "2.25").replace("Robert", "David").replace(" 4 ", " 9 ")
    broken = ITEM.replace("then Alice", "then Carol")
    rows = [(1, filler(50) + " " + PLAIN + " " + filler(30)), (2, filler(40) + ", " + ITEM), (3, "Said: so, " + other), (4, "Said: so, " + broken), (5, filler(300)), (6, None), (7, ""), (8, PLAIN[:40]), (None, PLAIN), (1, filler(20)), (9, PLAIN), (9, PLAIN)]
    bench = spark.createDataFrame([(100, ITEM), (101, PLAIN), (102, None), (103, "too short"), (104, PLAIN), (None, "")], "item_id long, text string")
    docs = spark.createDataFrame(docs_of(rows), KINDS)
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()}
    # 4: from the second "Carol" on, 14 tokens are consistent in themselves
    assert got == {(1, 101), (1, 104), (2, 100), (3, 100), (4, 100), (None, 101), (None, 104), (9, 101), (9, 104)}
    left = drop_contaminated(docs, bench)
    assert left.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in left.select("doc_id", "text").where("text is not null").collect()) == sorted(r for r in rows if r[1] is not None and r[0] and not (r[0] in (2, 3, 4, 9) or r == rows[0]))
    assert left.where("text is null").count() == 1
    assert contaminated(docs.limit(0), bench).collect() == [] and drop_contaminated(docs, bench.limit(0)).count() == len(rows)


def test_leaks_of_many_values_and_sentence_starts(spark):
    runs = "Tom runs 5 km in 25 minutes and Ann runs 8 km in 48 minutes, who is faster?"
    total = "Compute 12 + 7 - 3 + 44 - 5 + 61 - 8 + 9 + 10 - 2 + 30 + 6 + 1 of all."
    capital = "What is the capital of the old kingdom in the north?"
    pens = "Tom buys 4 red pens. Sara buys 6 blue pens. Tom gives 2 pens to Sara. How many pens are left?"
    items = [(1, runs), (2, total), (3, capital), (4, pens)]
    texts = [
        "We ask: " + runs,
        runs.replace("Tom", "Max").replace("Ann", "Eva").replace("25", "31").replace("48", "52"),
        "so " + total,
        "so " + " ".join(str(n) for n in range(100, 140)),
        "They said, What is the capital of the old kingdom in the north?",
        "so what is the capital of the old kingdom in the north?",
        pens.replace("Tom", "Kim").replace("Sara", "Lena").replace("4", "3").replace("6", "3"),
        pens.replace("Tom gives", "Bob gives"),
        pens.replace("Tom gives", "Bob gives").replace("to Sara", "to Eva"),
        pens.replace("gives 2 pens", "gives 5 pens").replace("are left", "were lost") + " Tom gives 6",
        pens.replace("4 red", "8 red").replace("Sara", "Eva", 1),
    ]
    got = contaminated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(0, 1), (1, 1), (2, 2), (4, 3), (5, 3), (6, 4), (7, 4), (8, 4), (9, 4), (10, 4)}


def test_short_and_repeated_items_and_clashing_columns(spark):
    long = "word " * 200_000
    items = [(1, "What is 3 plus 4 times 5?"), (2, "who was the king"), (2, "name the river that crosses the town"), (3, "so it is"), (4, "12 34 56 78"), (5, PLAIN), (5, ITEM)]
    texts = [
        "He asked: what is 3 plus 4 times 5? Then left.",
        "what is 7 plus 8 times 9, said she",
        "and who was the king of it all",
        "please name the river that crosses the town now",
        "yes, so it is",
        "12 34 56 79",
        "see 12 34 56 78 there",
        "name the river that crosses",
        long + PLAIN + " " + long,
        PLAIN.replace("jumps", "sits").replace("small", "big"),
    ]
    docs = spark.createDataFrame([(*t, 1, "r") for t in enumerate(texts)], "doc_id long, text string, bad_key int, row_key string").withColumn("_BAD0", F.lit(2))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (0, 1000):
        got = contaminated(docs, bench, most_broadcast=most)
        assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(0, 1), (1, 1), (2, 2), (3, 2), (6, 4), (8, 5)]
    left = drop_contaminated(docs, bench)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [4, 5, 7, 9]


def test_leaks_against_brute_force(spark):
    rnd = random.Random(15)
    word = lambda: rnd.choice(["red", "blue", "5", "7", "Ann", "Bob", "runs", "to", "12", "km", "the", "sea"])
    say = lambda n: " ".join(word() for _ in range(n))
    items = [(i, say(rnd.randint(9, 26))) for i in range(30)]
    texts = [say(rnd.randint(5, 60)) for _ in range(60)]
    for _, t in items * 2:
        swap = {"5": "6", "7": "9", "Ann": "Eva", "Bob": rnd.choice(["Max", "Eva"]), "12": rnd.choice(["3", "12"])}
        w = [swap.get(x, x) for x in t.split()]
        a = rnd.randrange(3)
        texts.append(" ".join([say(rnd.randint(0, 9)), *w[a : len(w) - rnd.randrange(4)], say(rnd.randint(0, 9))]).strip())
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    of = lambda df, c, i: {r[0]: r[1] for r in df.select(c, tokens(F.col("text"), initials=i)).collect()}
    kind = lambda t: t[:2] if t[0] == "\x02" else t

    def match(d, item):
        readings = []
        for first in (True, False):
            for others in (True, False):
                readings.append([t if t[:2] != "\x02i" else ("\x02p" if (first if k == 0 else others) else "") + t[2:] for k, t in enumerate(item)])
        kinds, mine = [[kind(t) for t in r] for r in readings], [kind(t) for t in d]
        place = {}
        for k in range(len(mine) - 7):
            place.setdefault(tuple(mine[k : k + 8]), []).append(k)
        hits = {}
        for r in kinds:
            for k in range(len(r) - 7):
                for at in place.get(tuple(r[k : k + 8]), []):
                    hits.setdefault(at - k, set()).add(k)
        for shift, hit in hits.items():
            need = max(1, min(13, len(item)) - 7)
            lo, hi = min(hit), max(hit) + 8
            for s in range(lo, hi):
                for z in range(s + 8, hi + 1):
                    pairs = [(x, x.replace("\x02i", "\x02p"), y) for x, y in zip(item[s:z], d[s + shift : z + shift])]
                    slots = {(x, y) for _, x, y in pairs if x[0] == "\x02" and x[:2] == y[:2]}
                    words = sum(y[0] != "\x02" and x in (y, f"\x02i{y}") for x, _, y in pairs)
                    fits = len({x for x, _ in slots}) == len(slots) and words >= 4 or all(x == y for x, y in slots)
                    if fits and sum(s <= k <= z - 8 for k in hit) >= need:
                        return True
        return False

    have, asked = of(docs, "doc_id", False), of(bench, "item_id", True)
    want = {(d, i) for d, x in have.items() for i, y in asked.items() if match(x, y)}
    assert len(want) > 30 and {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()} == want


def test_plans_are_native(spark, capsys):
    bench = spark.createDataFrame([(100, ITEM)], "item_id long, text string")
    docs = spark.createDataFrame(docs_of([(1, PLAIN)]), KINDS)
    contaminated(docs, bench).explain()
    assert "Python" not in capsys.readouterr().out


def test_rates_reach_targets(spark):
    rnd = random.Random(4)
    rows = []
    for _ in range(600):
        p = [rnd.random() ** 4 + 1e-3, rnd.random() ** 4 + 1e-3, rnd.random() ** 4 / 4 + 1e-3]
        rows.append((rnd.randrange(1, 900), [x / sum(p) for x in p]))
    members = spark.createDataFrame(rows, "_tokens long, _p array<double>")
    want = {"clean": 0.6, "low": 0.25, "toxic": 0.15}
    steps = fit_rates(members, want)
    rates = [1.0] * len(rows)
    for e in steps:
        rates = [max(0.0, r - sum(a * b for a, b in zip(p, e))) for r, (_, p) in zip(rates, rows)]
    total = sum(t for t, _ in rows)
    for i, d in enumerate(DOMAINS):
        assert sum(r * t * p[i] for r, (t, p) in zip(rates, rows)) / total == pytest.approx(want[d], abs=0.001)


def test_rates_reach_targets_of_overlapping_domains(spark):
    rnd = random.Random(8)
    rows = []
    for _ in range(2000):
        e = [math.exp(2 * rnd.gauss(0, 1) + x) for x in (2.0, 0.5, -0.5)]
        rows.append((rnd.randrange(1, 900), [x / sum(e) for x in e]))
    members = spark.createDataFrame(rows, "_tokens long, _p array<double>")
    steps = fit_rates(members, TARGETS)
    r = rate(steps)
    got = members.agg(*(F.sum(r * F.col("_tokens") * F.col("_p")[i]) / F.sum("_tokens") for i in range(3)), F.min(r)).first()
    assert list(got)[:3] == pytest.approx([TARGETS[d] for d in DOMAINS], abs=0.001) and got[3] >= 0 and len(steps) < 40


def test_targets_out_of_reach(spark):
    members = spark.createDataFrame([(10, [0.5, 0.3, 0.2])] * 5, "_tokens long, _p array<double>")
    with pytest.warns(RuntimeWarning, match="of all tokens"):
        steps = fit_rates(members, TARGETS)
    assert 0 < members.select(rate(steps).alias("r")).first().r < 3
    with pytest.raises(RuntimeError, match="of all tokens"):
        fit_rates(spark.createDataFrame([(10, [0.9, 0.05, 0.05]), (10, [0.4, 0.3, 0.3]), (9, [0.5, 0.4, 0.1])], members.schema), TARGETS, most_steps=1)


def test_posteriors_are_naive_bayes(spark):
    rnd = random.Random(14)
    texts = {i: " ".join(rnd.choice(["Good", "good", "fine", "bad", "junk", "x"][i % 3 :]) for _ in range(rnd.randint(1, 900))) for i in range(60)}
    docs = spark.createDataFrame([*texts.items(), (90, None), (91, "")], "doc_id long, text string")
    kinds = {i: ("toxic", "low", "clean")[i % 3] for i in range(40)}
    labels = spark.createDataFrame([(i, int(k == "clean"), int(k == "toxic")) for i, k in kinds.items()], "doc_id long, quality int, toxic int")
    words = sorted({w for t in texts.values() for w in t.lower().split()})
    at = {w: b for w, b in zip(words, spark.createDataFrame([(w,) for w in words], "w string").selectExpr(f"cast(pmod(xxhash64(w), {BUCKETS}) as int)").toPandas().iloc[:, 0])}
    count = {d: [0.2] * BUCKETS for d in DOMAINS}
    for i, k in kinds.items():
        for w in texts[i].lower().split():
            count[k][at[w]] += 1
    scored, tokens, p, _ = mixing_rates(docs, labels, {"clean": 0.4, "low": 0.3, "toxic": 0.3})
    for r in scored.select("doc_id", tokens.alias("t"), p.alias("p")).collect():
        w = (texts.get(r.doc_id) or "").lower().split()
        z = [math.log(sum(k == d for k in kinds.values()) / 40) + min(1, 400 / max(len(w), 1)) * sum(math.log(count[d][at[x]] / sum(count[d])) for x in w) for d in DOMAINS]
        e = [math.exp(x - max(z)) for x in z]
        assert r.t == len(w) and r.p == pytest.approx([x / sum(e) for x in e], abs=1e-9)


def test_mix(spark):
    rnd = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        kind = i % 10
        bad = kind == 0
        low = kind in (1, 2)
        w = [f"{'bad' if bad and rnd.random() < 0.3 else 'junk' if low and rnd.random() < 0.5 else 'word'}{rnd.randrange(40)}" for _ in range(60)]
        rows.append((i, " ".join(w)))
        if i % 2:
            labels.append((i, 0 if low else 1, 1 if bad else 0))
        if i % 20 == 10:
            labels.append((i, 1, 1))
    rows += [(1000, None), (1001, ""), (None, "word1 word2"), (3, "word1 word3")]
    docs = spark.createDataFrame(docs_of(rows), KINDS)
    lab = spark.createDataFrame([*labels, (None, 1, 0), (7777, None, None)], "doc_id long, quality int, toxic int")
    scored, _, _, r = mixing_rates(docs, lab)
    got = {x.doc_id: x for x in scored.select("doc_id", "_tokens", "_p", r.alias("r")).collect()}
    assert len(got) == len(rows) - 1 and got[1000]["_tokens"] == 0 and all(x.r >= 0 for x in got.values())
    assert max(got[i].r for i in range(0, 400, 10)) < min(got[i].r for i in range(5, 400, 10))
    shares = [sum(x.r * x["_tokens"] * x["_p"][i] for x in got.values()) / sum(x["_tokens"] for x in got.values()) for i in range(3)]
    assert shares == pytest.approx([TARGETS[d] for d in DOMAINS], abs=0.02)
    out = mix(docs, lab)
    assert out.columns == docs.columns and {x.doc_id for x in out.collect()} >= set(range(5, 400, 10))
    assert mix(docs.limit(0), lab).collect() == []
    clash = docs.withColumns({c: F.lit(9) for c in ("_b", "_tokens", "_P", "_n", "_k", "_z", "r", "a.b")})
    same = mix(clash, lab)
    assert same.columns == clash.columns and {r["_tokens"] for r in same.collect()} == {9} and same.count() == out.count()


def test_a_changed_value_does_not_hide_the_text_before_it(spark):
    item = "Tom has 6 red pens and 9 blue pens in a box, and on Monday Tom gives 6 of them away to a friend of the class."
    bad = item.replace("gives 6", "gives 5")
    # a conflict in the middle, less than 13 tokens on either side of it
    short = "Sara buys 4 pens for 4 dollars and gives them all away to some friends"
    docs = spark.createDataFrame([(1, f"x y {bad} z"), (2, short.replace("4 dollars", "5 dollars")), (3, short)], "doc_id long, text string")
    got = contaminated(docs, spark.createDataFrame([(7, item), (8, short)], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 7), (3, 8)}
    at = next(r for r in got if r.doc_id == 1)
    # the longest stretch starts behind the first 6; the first begins with the text
    assert (at.first_token, at.n_windows) == (2, 17)


def test_a_page_of_numbers(spark):
    """A hundred thousand numbers in one text, against an item of numbers and one of words and numbers."""
    import time

    numbers = " ".join(str(i * 7 % 1000) for i in range(100_000))
    item = " ".join(str(i * 13 % 100) for i in range(14))
    mixed = "add all of the numbers " + " ".join(str(i * 17 % 100) for i in range(14))
    docs = spark.createDataFrame([(1, numbers), (2, f"{numbers} {item}"), (3, mixed.replace("17", "18"))], "doc_id long, text string")
    began = time.time()
    got = contaminated(docs, spark.createDataFrame([(9, item), (10, mixed)], "item_id long, text string")).collect()
    took = time.time() - began
    print("took", took)
    assert {(r.doc_id, r.item_id) for r in got} == {(2, 9), (3, 10)} and took < 90
