"""The numbered tree, and beams that a stateful model scores, against sequential search."""

import random

import numpy as np

from docloom.operators import trie


class Recurrent:
    """A tiny recurrent model: the state is a vector, a token changes it, scores are a softmax over what is allowed."""

    def __init__(self):
        rng = np.random.default_rng(5)
        self.w, self.e = rng.normal(size=(6, 6)), rng.normal(size=(50, 6))

    def start(self, queries):
        return [np.full(6, (len(q or "") % 7) / 7).tobytes() for q in queries]

    def one(self, memory, token, allowed):
        h = np.frombuffer(memory)
        if token is not None:
            h = np.tanh(self.w @ h + self.e[token])
        z = self.e[allowed] @ h
        return h.tobytes(), z - np.log(np.exp(z).sum())

    def step(self, states, tokens, allowed):
        got = [self.one(*x) for x in zip(states, tokens, allowed)]
        return [m for m, _ in got], [s for _, s in got]


def sequential(query, sequences, width, longest):
    model = Recurrent()
    inner = {tuple(s[:n]) for s in sequences for n in range(len(s))}
    follow = lambda p: sorted({s[len(p)] for s in sequences if tuple(s[: len(p)]) == p and len(s) > len(p)})
    live = [((), 0.0, True, model.start([query])[0])]
    for _ in range(longest):
        grown = [x for x in live if not x[2]]
        for p, total, open_, memory in live:
            if open_:
                allowed = follow(p)
                after, scores = model.one(memory, p[-1] if p else None, allowed)
                grown += [((*p, t), round(total + s, 6), (*p, t) in inner, after) for t, s in zip(allowed, scores)]
        live = sorted(grown, key=lambda x: (-x[1], ",".join(map(str, x[0]))))[:width]
        if not any(x[2] for x in live):
            break
    return [(n, ",".join(map(str, p)), total) for n, (p, total, _, _) in enumerate(live, 1)]


def made(seed=1, n=120):
    rnd = random.Random(seed)
    return [[rnd.randint(0, 9) for _ in range(rnd.randint(1, 5))] for _ in range(n)]


def test_steps_are_the_tree(spark):
    sequences = [*made(), [], [3], [3, 3]]
    df = spark.createDataFrame([(s,) for s in sequences] * 2, "tokens array<int>")
    rows = trie.numbered_steps(df).collect()
    assert sorted(r.next for r in rows) == list(range(1, len(rows) + 1))
    by, paths = {(r.state, r.token): r for r in rows}, {}
    for s in sequences:
        state = 0
        for depth, t in enumerate(s):
            r = by[state, t]
            assert r.depth == depth and paths.setdefault(r.next, tuple(s[: depth + 1])) == tuple(s[: depth + 1])
            assert r.inner == any(len(o) > depth + 1 and o[: depth + 1] == s[: depth + 1] for o in sequences)
            state = r.next
    assert len(paths) == len(rows)
    assert trie.numbered_steps(df.where("false")).collect() == []


def test_following(spark):
    sequences = made(2)
    asked = [s[:n] for s in sequences[:20] for n in range(len(s) + 1)] + [[99], [1, 99, 1]]
    df = lambda rows: spark.createDataFrame([(s,) for s in rows], "tokens array<int>")
    got = {tuple(r.tokens): r.next for r in trie.following(trie.numbered_steps(df(sequences)), df(asked), 77).collect()}
    want = {tuple(a): sorted({s[len(a)] for s in sequences if s[: len(a)] == a and len(s) > len(a)}) or [77] for a in asked}
    assert got == want


def test_model_in_batches(spark):
    sequences = made(3)
    steps = trie.numbered_steps(spark.createDataFrame([(s,) for s in sequences], "tokens array<int>"))
    queries = [(f"q{i}", "x" * i if i else None) for i in range(12)]
    df = spark.createDataFrame(queries, "qid string, query string").repartition(4)
    for width, longest in ((1, 5), (4, 9), (4, 2)):
        got = {}
        for r in trie.generate(df, steps, Recurrent, width, longest).collect():
            got.setdefault(r.qid, []).append((r["rank"], r.sequence, r.total))
        for qid, text in queries:
            want = sequential(text, sequences, width, longest)
            assert [x[:2] for x in sorted(got[qid])] == [x[:2] for x in want]
            assert np.allclose([x[2] for x in sorted(got[qid])], [x[2] for x in want], atol=1e-5)


def test_no_prefix_in_a_join(spark):
    steps = trie.numbered_steps(spark.createDataFrame([(s,) for s in made(4)], "tokens array<int>"))
    assert dict(steps.dtypes) == {"depth": "int", "state": "bigint", "token": "int", "next": "bigint", "inner": "boolean"}
    assert trie.generate(spark.createDataFrame([("q", "x")], "qid string, query string"), steps.where("false"), Recurrent, 3, 3).collect() == []
