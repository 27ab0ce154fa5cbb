"""The quality ledger against counts by hand."""

import random
from collections import Counter

from docloom.llm.quality import POLICIES, RULES, ablation, apply_policy, ledger

KINDS = "doc_id long, text string, lang string, kept int, n_words string"


def corpus():
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(30)] + ["é€", "#tag", "a|b", "$5", "\xa0x", "\x85"]
    rows = []
    for i in range(120):
        lines = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 30))) for _ in range(rnd.randint(1, 8))]
        lines += rnd.sample(lines, rnd.randint(0, len(lines)))
        rows.append((i, rnd.choice(["\n", "\r\n", "\n\n", "\n \t"]).join(lines)))
    rows += [(500, None), (501, ""), (502, " \n\t\x0b\x0c\r"), (503, "same " * 3000), (504, " ".join(str(i) for i in range(30_000))), (None, "x y z"), (7, "again"), (7, "again")]
    return [(*r, "en", None, "clash") for r in rows]


def brute(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_ledger(spark):
    rows = corpus()
    got = apply_policy(ledger(spark.createDataFrame(rows, KINDS))).collect()
    key = lambda r: (str(r[0]), r[1:6])
    want = sorted(((r[0], *brute(r[1])) for r in rows), key=lambda r: (str(r[0]), r[1:]))
    have = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=lambda r: (str(r[0]), r[1:]))
    assert have == want and key
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and (not r.base_failed or not r.kept)


def test_policies(spark):
    kept = ledger(spark.createDataFrame(corpus(), KINDS)).cache()
    bits = [r.fail_bits for r in kept.collect()]
    names = list(RULES)
    for p, rules in POLICIES.items():
        mask = sum(1 << names.index(r) for r in rules)
        got = {r.rule: (r.n_failed, r.n_only) for r in ablation(kept, p).collect()}
        assert got == {r: (sum(b >> names.index(r) & 1 for b in bits), sum(b & mask == 1 << names.index(r) for b in bits)) for r in rules}
    assert ledger(spark.createDataFrame([], KINDS)).collect() == []


def test_more_words_do_not_save_a_repetitive_text(spark):
    import random

    rnd = random.Random(1)
    text = lambda n, distinct: " ".join(rnd.sample([f"word{i % distinct}" for i in range(n)], n))
    rows = [(1, text(1990, 200)), (2, text(2010, 200)), (3, text(30_000, 299)), (4, text(2010, 301)), (5, text(1000, 151))]
    got = {r.doc_id: (r.kept, r.fail_bits) for r in apply_policy(ledger(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    bit = 1 << list(RULES).index("few_distinct_words_2")
    assert {d: bool(bits & bit) for d, (_, bits) in got.items()} == {1: True, 2: True, 3: True, 4: False, 5: False}
    assert not any(got[d][0] for d in (1, 2, 3))
