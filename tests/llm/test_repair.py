"""Conversation repair against all edits that there are, in one segment and in many."""

import hashlib
import itertools
import random
import re

import pytest

from docloom.llm.repair import END, START, costs_to_go, damaged, fault_of, repair, repaired_turns, walk

KIND = "conv_id long, turn long, role string, text string"
NEXT, ROLE = (2, 2, 3, 2), {2: "user", 3: "assistant"}


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = re.sub(r"^[ \t-\r]+|[ \t-\r]+$", "", text)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def brute(rows):
    """The least (cost, edits, turns) of all edits whose roles follow the grammar."""
    faults, best = faults_of(rows), None
    choices = []
    for (role, text), fault in zip(rows, faults):
        more = 3 if fault == "truncated" else 0
        edits = [(4, "D", None)]
        if fault not in ("blank", "duplicate"):
            edits += [(more, "K", (role, text)), (3 + more, "R", ("user", text)), (3 + more, "R", ("assistant", text))]
        choices.append(edits)
    inserts = [[(3, "I", (r, "")) for r in p] for n in range(3) for p in itertools.product(("user", "assistant"), repeat=n)]
    for picked in itertools.product(*choices):
        for places in itertools.product(inserts, repeat=len(rows) + 1):
            edits = [e for gap, one in itertools.zip_longest(places, picked) for e in [*gap, *([one] if one else [])]]
            turns = [e[2] for e in edits if e[2]]
            if re.fullmatch(r"(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in turns)):
                found = (sum(e[0] for e in edits), "".join(e[1] for e in edits), turns)
                best = min(best, found) if best else found
    return best


def plain(rows):
    """What repair() says of the rows of one conversation, in order, from the dynamic programme over all of them."""
    faults = [{"blank": 1, "duplicate": 2, "truncated": 3, "": 0}[f] for f in faults_of(rows)]
    roles, texts = [r for r, _ in rows], [t for _, t in rows]
    costs = costs_to_go(roles, faults, END)
    _, audit, turns = walk(roles, texts, faults, costs, START, True)
    return costs[0][START], audit, turns


def test_edits_are_the_cheapest():
    rnd = random.Random(3)
    for _ in range(60):
        rows = [(rnd.choice(["user", "assistant", "system", "tool", "", "u"]), rnd.choice(["Yes.", "No", " \n", "Why?", "a.", "b!"])) for _ in range(rnd.randint(0, 3))]
        assert plain(rows) == brute(rows), rows


def test_faults():
    assert [fault_of(t) for t in ("", " \t\r\n", "x.", "x. \n", "x", ".x", " ", "é?")] == [1, 1, 0, 0, 3, 3, 3, 0]


def expected(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, " " if role is None else role, hashlib.md5((" " if text is None else text).encode()).hexdigest(), " " if text is None else text))
    out = {}
    for conv, said in by.items():
        said.sort()
        pairs = [(r, t) for _, _, r, _, t in said]
        cost, audit, turns = plain(pairs)
        faults, timed = faults_of(pairs), [x[1] for x in said if x[0]]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:]))
        gaps = max(timed) - min(timed) + 1 - len(set(timed)) if timed else 0
        text = "\n".join(f"{r}:{t}" for r, t in turns)
        out[conv] = (gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


@pytest.mark.parametrize("most_rows", [1, 3, 4096])
def test_segments(spark, most_rows):
    """Long and short conversations, ties, repeats, nulls, clashing columns: the same in one segment and in many."""
    rnd = random.Random(most_rows)
    says = ["Yes.", "No", "", "Why?", "é x!", " ", None, "same.", "a" * 300]
    rows = []
    for conv in [None, *range(12)]:
        for _ in range(rnd.choice([1, 2, 5, 9, 40])):
            rows.append((conv, rnd.choice([None, *range(30)]), rnd.choice(["user", "assistant", "system", None, "", "tool"]), rnd.choice(says)))
    rows += [(77, t, "user" if t % 2 else "assistant", f"turn {t // 3}.") for t in range(400)] + [(78, 5, "user", "again.")] * 300
    docs = spark.createDataFrame([(*r, "x", 1, True) for r in rows], KIND + ", seq string, later int, gone boolean").repartition(7)
    got = {r.conv_id: tuple(r[1:]) for r in repair(docs, most_rows=most_rows).collect()}
    assert got == expected(rows)


def test_turns_left(spark):
    rows = [(1, 0, "user", "Hello."), (1, 1, "user", "Hello."), (1, 2, "tool", "no end"), (2, 0, "system", "S."), (2, 1, "user", "U?"), (2, 2, "assistant", "A.")]
    docs = spark.createDataFrame(rows, KIND)
    for most_rows in (1, 100):
        got = sorted(map(tuple, repaired_turns(docs, most_rows=most_rows).collect()))
        assert [x[3:] for x in got if x[0] == 2] == [("system", "S."), ("user", "U?"), ("assistant", "A.")]
        assert [x[3:] for x in got if x[0] == 1] == plain([("user", "Hello."), ("user", "Hello."), ("tool", "no end")])[2]


def test_no_rows_left(spark):
    docs = spark.createDataFrame([(1, 0, "user", "x", True), (2, 0, "user", "Hi.", False), (3, 1, "user", "x", True)], KIND + ", dropped boolean")
    got = {r.conv_id: tuple(r[1:]) for r in repair(docs, gone="dropped").collect()}
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[1] == got[3] == nothing and got[2][5:7] == (3, "KI")
    assert repair(docs.limit(0)).collect() == []


def test_damage(spark):
    import zlib

    rows = [(c, t, "assistant", "One. Two?") for c in (None, 1, 2, 3) for t in (None, *range(20))]
    got = damaged(spark.createDataFrame(rows, KIND)).collect()
    want = []
    for c, t, role, text in rows:
        d = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        row = (c, t, "user" if d == 4 else role, {1: "", 2: "One Two"}.get(d, text), d == 0)
        want += [row] * (2 if d == 3 else 1)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_long_text(spark):
    long = "word " * 500_000 + "end."
    got = repair(spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long), (2, 0, "user", "U.")], KIND)).collect()
    assert {r.conv_id: (r.cost, r.audit) for r in got} == {1: (0, "KK"), 2: (3, "KI")}
    assert next(r for r in got if r.conv_id == 1).repaired_sha256 == hashlib.sha256(f"user:{long}\nassistant:{long}".encode()).hexdigest()
