"""Language identification on held-out rows."""

import random
import zlib

from docloom.llm.langid import UND, grams, keep_identified, predict

KINDS = "doc_id long, text string, lang string, source string, score string, lang_pred int"
SYLLABLES = {"aa": ["th", "ing", "the", "ou"], "bb": ["ción", "ñe", "lla", "que"], "cc": ["sch", "üb", "ung", "tz"], "dd": ["жи", "ло", "ст", "на"]}


def corpus():
    rnd = random.Random(1)
    rows = []
    for i in range(400):
        lang = rnd.choice(list(SYLLABLES))
        words = ["".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(3, 80))]
        rows.append((i, " ".join(words).capitalize(), lang if i % 17 else None))
    rows += [(900, None, "aa"), (901, "", "aa"), (902, "123 !? \n", "bb"), (None, "the thing", "aa"), (5, rows[5][1], rows[5][2]), (903, "the " * 50_000, "aa")]
    return [(*r, "s", "clash", 1) for r in rows]


def test_predictions(spark):
    rows = corpus()
    got = predict(spark.createDataFrame(rows, KINDS)).collect()
    assert len(got) == len(rows)
    want = {r[0]: r for r in rows}
    held, right = 0, 0
    for r in got:
        assert 0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        text, lang = want[r.doc_id][1:3]
        if not text or not any(c.isalpha() for c in text):
            assert r.lang_pred == UND and r.score == 0
        elif r.held_out and lang:
            held += 1
            right += r.lang_pred == lang
    assert held > 80 and right / held > 0.97


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "text", None, "s", "", 0)], KINDS)
    assert [r.lang_pred for r in predict(df).collect()] == [UND]
    assert predict(df.limit(0)).collect() == [] and keep_identified(df.limit(0)).collect() == []


def test_grams_stay_in_their_texts():
    alone = [grams([t], 1 << 14)[0].tolist() for t in ("ab c", "xyz", "")]
    b, starts, letters = grams(["ab c", "xyz", ""], 1 << 14)
    assert [sorted(b[starts[i] : starts[i + 1]].tolist()) for i in range(3)] == [sorted(x) for x in alone] and letters.tolist() == [3, 3, 0]


def test_keep(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, KINDS).drop("score", "lang_pred")
    kept = keep_identified(df)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == df.columns and len(ids) > 390 and not {900, 901, 902} & set(ids)


def test_scores_are_naive_bayes(spark):
    """Counts, priors and posteriors one text and one language at a time; only the hash of grams is shared."""
    import math
    from collections import Counter

    rows = corpus()
    size, alpha = 1 << 14, 0.5
    grams_of = lambda t: grams([t], size)[0].tolist()
    learn = [r for r in rows if r[1] is not None and r[2] is not None and (r[0] is None or zlib.crc32(str(r[0]).encode()) % 3 != 1)]
    langs = sorted({r[2] for r in learn})
    counts = {x: Counter(g for r in learn if r[2] == x for g in grams_of(r[1])) for x in langs}
    prior = {x: math.log(sum(r[2] == x for r in learn) / len(learn)) for x in langs}
    total = {x: sum(counts[x].values()) + alpha * size for x in langs}
    got = predict(spark.createDataFrame(rows, KINDS)).collect()
    checked = 0
    for r, row in zip(sorted(got, key=lambda r: str(r.doc_id)), sorted(rows, key=lambda r: str(r[0]))):
        mine = grams_of(row[1] or "")
        if r.lang_pred == UND or not mine or sum(x.doc_id == r.doc_id for x in got) > 1:
            continue
        z = {x: prior[x] + min(len(mine), 64) / len(mine) * sum(math.log((counts[x][g] + alpha) / total[x]) for g in mine) for x in langs}
        top = max(z.values())
        p = {x: math.exp(v - top) for x, v in z.items()}
        best = max(langs, key=lambda x: z[x])
        assert r.lang_pred == best and abs(r.score - p[best] / sum(p.values())) < 1e-9
        checked += 1
    assert checked > 390


def test_a_rare_language_is_learned(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choice(SYLLABLES["aa"]) for _ in range(6)), "aa") for i in range(30_000)]
    rare = [i for i in range(40_000, 40_020) if zlib.crc32(str(i).encode()) % 3 != 1][:6]
    rows += [(i, " ".join(rnd.choice(SYLLABLES["dd"]) for _ in range(30)), "dd") for i in rare]
    rows.append((50_000, "жи ло ст на жило стна", None))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = predict(df, sample_rows=2000).where("doc_id = 50000").first()
    assert got.lang_pred == "dd"


def test_keep_with_clashing_names(spark):
    rows = [(*r[:4], 1.5, "x", True) for r in corpus()]
    names = ["doc_id", "text", "lang", "source", "Score", "LANG_PRED", "a.b"]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, s double, l string, a boolean").toDF(*names)
    kept = keep_identified(df)
    assert kept.columns == names and len(kept.collect()) > 390
    again = df.toDF("doc_id", "text", "lang", "c0", "c1", "lang_pred", "score")
    assert keep_identified(again).count() == kept.count()
