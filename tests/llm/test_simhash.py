"""SimHash components against all pairs; the grid against the distances that it must find."""

import random
import re

import numpy as np
import pytest
import xxhash

from docloom.llm.simhash import PIECE, cells_of, fingerprint, labels_of, simhash_components

SPACE = re.compile("[ \t-\r]+")


def plain(text):
    words = [w for w in SPACE.split("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(fps, most=4):
    """The least fingerprint, as a signed number, that each one reaches."""
    left, out = set(fps), {}
    while left:
        group, stack = [], [left.pop()]
        while stack:
            x = stack.pop()
            group.append(x)
            near = {y for y in left if (x ^ y).bit_count() <= most}
            left -= near
            stack += near
        out |= {x: min(y - (y >> 63 << 64) for y in group) for x in group}
    return out


def test_fingerprint():
    rnd = random.Random(1)
    for n in (0, 1, 2, 3, 4, 5, 9, 200):
        text = rnd.choice([" ", "\n"]).join(rnd.choice(["A", "b", "É", "Üc", "word", "日"]) for _ in range(n))
        assert fingerprint(text.encode()) == plain(text)
    assert fingerprint("\x0b \x0c".encode()) == 0 and fingerprint("a b".encode()) == fingerprint("a b".encode())
    long = " ".join(rnd.choice(["one", "two", "three", "vier"]) for _ in range(PIECE // 2)) + "\n" + "x" * (PIECE + 3) + "\tlast two words"
    assert fingerprint(long.encode()) == plain(long)


def test_grid_meets_all_within_four_bits():
    rnd = random.Random(2)
    for most in range(5):
        for _ in range(400):
            x = rnd.choice([0, 2**64 - 1, rnd.getrandbits(64)])
            y = x
            for b in rnd.sample(range(64), most):
                y ^= 1 << b
            cells, who = cells_of(np.array([x, y], np.uint64))
            assert set(cells[who == 0].tolist()) & set(cells[who == 1].tolist())
            assert len(set(zip(cells.tolist(), who.tolist()))) == len(cells)


@pytest.mark.parametrize("block", [5, 40, 1 << 15])
def test_labels(spark, block):
    """Chains, balls around one fingerprint, and scattered ones, in cells of one and of many blocks."""
    rnd = random.Random(block)
    flip = lambda x, n: x ^ sum(1 << b for b in rnd.sample(range(64), n))
    fps = {rnd.getrandbits(64) for _ in range(200)} | {0, 1, 2**64 - 1}
    centre = rnd.getrandbits(64)
    fps |= {flip(centre, rnd.randint(0, 3)) for _ in range(300)}
    for _ in range(5):
        x = rnd.getrandbits(64)
        for _ in range(12):
            fps.add(x)
            x = flip(x, rnd.choice([1, 2, 4, 5]))
    # many that meet in the cells of even counts and are far apart
    fps |= {sum((1 + rnd.randint(0, 1)) << 2 * i for i in range(32)) for _ in range(300)}
    want = reach(fps)
    signed = lambda x: x - (x >> 63 << 64)
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    got = {r.node: r.label for r in labels_of(df, block=block).collect()}
    assert {signed(x): got.get(signed(x), signed(x)) for x in fps} == {signed(x): y for x, y in want.items()}


def test_documents(spark):
    rnd = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(120):
        words = [rnd.choice(vocabulary) for _ in range(rnd.choice([1, 3, 4, 80, 300]))]
        rows.append((i, " ".join(words)))
        for k in range(rnd.choice([0, 0, 1, 4])):
            words = list(words)
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            rows.append((1000 + 10 * i + k, "\t".join(words).upper()))
    rows += [(5000, None), (5001, ""), (5002, " \n"), (3, rows[3][1]), (None, rows[5][1]), (None, "only this one has no id")] + [(6000 + i, "copy of one text, many times") for i in range(400)]
    fps = {x: plain(x) for _, x in rows}
    label = reach(set(fps.values()))
    least = {}
    for doc_id, text in rows:
        if doc_id is not None:
            k = label[fps[text]]
            least[k] = min(least.get(k, doc_id), doc_id)
    want = sorted(((d, f"{fps[t]:016x}", least.get(label[fps[t]])) for d, t in rows), key=str)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, fp int, component_id string").repartition(6)
    got = simhash_components(docs).selectExpr("doc_id", "lower(lpad(hex(fp), 16, '0'))", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == want
    assert simhash_components(docs.limit(0)).collect() == []
