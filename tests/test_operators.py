"""Operators against small models of what they compute."""

import math
import random

import pytest
from pyspark.sql import functions as F

from docloom.functions import text
from docloom.operators import hybrid, instances, metrics, mining, numbering, positives, trie, validate


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first().y


def test_url_titles(spark):
    rows = [("http://shop.test/garden/spade9", "T"), ("https://notes.test//diary//rain-in-may", ""), (None, " My Title "), ("http://a.com/index", ""), ("", ""), ("http://example.com", ""), ("http://a.com/7/12", "Name")]
    made, source = text.url_title(F.col("u"), F.col("t"))
    got = [tuple(r) for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, u string, t string").orderBy("i").select(made, source).collect()]
    assert got == [("spade9 garden shop.test", "url"), ("rain in may diary notes.test", "url"), ("my title", "title"), (None, "skipped"), (None, "skipped"), ("example.com", "url"), ("name a.com", "title_domain")]


def test_text(spark):
    assert one(spark, text.normalize_query("x"), "  QUERY :  How\tTo\n do ") == "how to do"
    assert one(spark, text.clean_code("x"), "Code:  def f\n") == "def f"
    assert one(spark, text.normalize_docid("x"), "D12") == one(spark, text.normalize_docid("x"), "[d12]") == "[d12]"
    assert one(spark, text.ids(F.col("x")), ["a", "", None, "b", "a"], "array<string>") == ["a", "b"]


def brute_metrics(truth, pred):
    hit = [d in truth for d in pred]
    out = {"mrr": next((1 / (i + 1) for i, h in enumerate(hit) if h), 0.0), "mrr_10": next((1 / (i + 1) for i, h in enumerate(hit[:10]) if h), 0.0)}
    firsts = sorted(pred.index(d) + 1 for d in truth & set(pred))
    out["map_20"] = sum(n / place for n, place in enumerate(firsts, 1) if place <= 20) / max(1, len(truth))
    for k in metrics.NDCG_AT:
        out[f"ndcg_{k}"] = sum(1 / math.log2(i + 2) for i, h in enumerate(hit[:k]) if h) / max(0.3, sum(1 / math.log2(i + 2) for i in range(len(truth))))
    for k in metrics.P_AT:
        out[f"p_{k}"] = len(truth & set(pred[:k])) / max(1, len(pred[:k]))
    for k in metrics.R_AT:
        out[f"r_{k}"] = sum(hit[:k]) / len(truth)
    for k in metrics.HIT_AT:
        out[f"hit_{k}"] = float(any(hit[:k]))
    return out


def test_metrics(spark):
    rnd = random.Random(1)
    truth, pred = {}, {}
    for q in range(25):
        truth[f"q{q}"] = {f"d{rnd.randrange(40)}" for _ in range(rnd.randint(1, 15))}
        pred[f"q{q}"] = [f"d{rnd.randrange(40)}" for _ in range(rnd.choice([0, 3, 12, 60]))]
    p = spark.createDataFrame([(q, d, i + 1) for q, ds in pred.items() for i, d in enumerate(ds)], "qid string, docid string, rank int")
    t = spark.createDataFrame([(q, d) for q, ds in truth.items() for d in ds], "qid string, docid string")
    got = {r.qid: r for r in metrics.per_query(p, t).collect()}
    assert set(got) == set(truth)
    for q in truth:
        for name, want in brute_metrics(truth[q], pred[q]).items():
            assert got[q][name] == pytest.approx(want), (q, name)


def test_significance(spark):
    d = spark.createDataFrame([("m", str(i), float(x)) for i, x in enumerate([1, -2, 3, 4, 0, 2, 5, -1])], "metric string, qid string, d double")
    t = metrics.t_statistic(d).first()
    assert t.t == pytest.approx(1.5 / (math.sqrt(sum((x - 1.5) ** 2 for x in [1, -2, 3, 4, 0, 2, 5, -1]) / 7) / math.sqrt(8)))
    w = metrics.wilcoxon(d).first()
    assert (w.n, w.w_plus, w.w_minus) == (7, 23.0, 5.0)
    assert metrics.t_test_p(2.364624, 8) == pytest.approx(0.05, abs=1e-4) and metrics.t_test_p(0.0, 8) == 1.0
    assert metrics.wilcoxon_p(14.0, 7) == pytest.approx(1.0)


def test_passages(spark):
    s = " ".join(f"{c}1 {c}2 {c}3 {c}4 {c}5 {c}6 {c}7 {c}8 {c}9 {c}10." for c in "abcde")
    docs = spark.createDataFrame([("d", "t1 t2 t3", s), ("e", "t", "one two."), ("f", "t", None)], "docid string, title string, body string")
    got = instances.passages(docs, 24, 2).collect()
    assert [(r.docid, r.n, len(r.tokens)) for r in got if r.docid == "d"] == [("d", 0, 24), ("d", 1, 24)]
    assert got[0].tokens[:4] == ["t1", "t2", "t3", "a1"] and got[0].tokens[-2:] == ["b10", "</s>"] and got[1].tokens[3] == "c1"
    assert [r.tokens for r in got if r.docid == "e"] == [["t", "one", "two", "</s>"]]


def test_sampled_terms_come_from_the_title_too(spark):
    body = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([("d", "Zebra zebra", body), ("e", None, body), ("f", "Zebra", None)], "docid string, title string, body string")
    idf = spark.createDataFrame([(w, 2.0 if w == "zebra" else 1.0) for w in [*body.split(), "zebra"]], "term string, idf double")
    got = {r.docid: r.tokens for r in instances.sampled_terms(docs, idf, longest=4).collect()}
    # of 13 tokens zebra's two score most; the third best is a tie of all others
    assert got["d"][:3] == ["zebra", "zebra", "one"] and got["d"][-1] == "</s>" and "f" not in got
    assert "zebra" not in got["e"]
    assert {r.docid: r.tokens for r in instances.sampled_terms(docs, idf, longest=3).collect()}.get("d") is None  # one distinct term


def test_another_tokenizer_everywhere(spark):
    import pandas as pd

    from docloom.operators import bm25, corpus

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        import re

        return texts.map(lambda t: None if t is None else re.findall(r"[^\W_]+", t.lower()))

    text_ = " ".join(f"{c}{i}{'.' if i % 4 == 3 else ''}" for c in "abc" for i in range(12))
    docs = spark.createDataFrame([("d", "The Title", text_), ("e", "A", "One two. ... Three!"), ("f", "T", None), ("g", "T", ".")], "docid string, title string, body string")
    same = lambda f: sorted(map(str, f(cut).collect())) == sorted(map(str, f(bm25.tokenize).collect())) != []
    assert same(lambda c: instances.passages(docs, 12, 3, cut=c))
    vocab = corpus.frequent_terms(docs, 30, 1)
    assert same(lambda c: corpus.frequent_terms(docs, 30, 1, cut=c))
    idf = corpus.term_idf(docs, vocab)
    assert same(lambda c: corpus.term_idf(docs, vocab, cut=c)) and same(lambda c: corpus.term_tf(docs, cut=c))
    assert same(lambda c: instances.sampled_terms(docs, idf, 20, cut=c))
    # one that differs, so that it is known to be used
    letters = lambda c: F.split(F.lower(c), "")
    assert {len(t) for r in instances.passages(docs.where("docid = 'e'"), 12, 3, cut=letters).collect() for t in r.tokens[:-1]} <= {0, 1}


def test_bands(spark):
    rows = spark.createDataFrame([(q, f"{q}{r}", r) for q, n in (("a", 200), ("b", 102)) for r in range(1, n + 1)], "qid string, docid string, rank int")
    quotas = [(1, 20, 3), (21, 100, 2), (101, 200, 3)]
    got = mining.stratified(rows, quotas, "s").collect()
    assert {r.qid for r in got} == {"a"} and [sum(lo <= r["rank"] <= hi for r in got) for lo, hi, _ in quotas] == [3, 2, 3]
    filled = mining.stratified(rows, quotas, "s", fill=True).collect()
    assert sum(r.qid == "b" for r in filled) == 8 and len({r.docid for r in filled}) == 16


def test_candidates(spark):
    run = spark.createDataFrame([("q", d, i, 1.0) for i, d in enumerate("abcdef", 1)] + [("other", "a", 1, 1.0)], "qid string, docid string, rank int, score double")
    pos = spark.createDataFrame([("q", "b")], "qid string, docid string")
    targets = spark.createDataFrame([("a", "T1"), ("b", "T2"), ("c", "T2"), ("d", "T1"), ("e", "T3")], "docid string, target string")
    got = {r.docid: r.state for r in mining.judged_candidates(run, pos, targets).collect()}
    assert got == {"a": "usable", "b": "positive", "c": "same_target", "d": "duplicate", "e": "usable", "f": "unknown"}


def group(spark, ranks, model):
    bm = spark.createDataFrame([("q", "c", f"n{r}", f"t{r}", r) for r in ranks], "query_key string, chosen string, rejected string, target string, bm25_rank int")
    md = spark.createDataFrame([("q", "c", *m) for m in model], "query_key string, chosen string, rejected string, target string, model_rank int")
    return bm, md


def test_hybrid(spark):
    model = [(f"m{i}", f"u{i}", i) for i in range(1, 5)]
    pairs, groups = hybrid.combine(*group(spark, [1, 2, 3, 21, 22, 101, 102, 103], model))
    got = pairs.collect()
    ranks = [r.bm25_rank for r in got if r.source == "bm25"]
    assert len({r.rejected for r in got}) == 8 and [sum(x <= 20 for x in ranks), sum(20 < x <= 100 for x in ranks), sum(x > 100 for x in ranks)] == [2, 1, 1]
    assert groups.first().outcome == "exact"
    pairs, groups = hybrid.combine(*group(spark, list(range(1, 9)), [("n1", "t1", 1), ("m9", "u9", 2)]))
    got = {r.rejected: r for r in pairs.collect()}
    assert len(got) == 8 and got["n1"].source == "model_confusion+bm25" and got["n1"].also_bm25_rank == 1 and groups.first().outcome == "fallback"
    pairs, groups = hybrid.combine(*group(spark, list(range(1, 9)), [("m1", "u1", 1)]), exact=True)
    assert pairs.count() == 0 and groups.first().outcome == "model_shortfall"
    shared = [("m1", "t5", 1), *model[1:]]
    pairs, _ = hybrid.combine(*group(spark, list(range(1, 9)), shared))
    assert "n5" not in {r.rejected for r in pairs.collect()}
    bm, md = group(spark, list(range(1, 12)), [*model, ("m5", "u5", 5)])
    out = spark.createDataFrame([("n1",), ("m1",)], "id string")
    got = {r.rejected for r in hybrid.combine(hybrid.without(bm, out), hybrid.without(md, out))[0].collect()}
    assert len(got) == 8 and not got & {"n1", "m1"}


def test_beams(spark):
    beams = spark.createDataFrame([("q", i, c) for i, c in enumerate(["p1", "p2", "x", "x", "y", "z"], 1)], "qid string, rank int, code string")
    targets = spark.createDataFrame([(c, c.upper()) for c in ("p1", "p2", "x", "y", "z")], "code string, target string")
    pos = spark.createDataFrame([("q", "P1"), ("q", "P2")], "qid string, target string")
    got = {r["rank"]: r.state for r in hybrid.select_beams(beams, targets, pos, 2).collect()}
    assert got == {1: "positive", 2: "positive", 3: "selected", 4: "duplicate", 5: "selected"}


def test_trie(spark):
    s = spark.createDataFrame([([0, 5, 6],), ([0, 5, 7],), ([0, 5],)], "tokens array<int>")
    t = trie.next_tokens(s)
    assert {r.prefix: r.next for r in t.collect()} == {"": [0], "0": [5], "0,5": [6, 7]}
    assert sorted(r.sequence for r in trie.leaves(s, t).collect()) == ["0,5,6", "0,5,7"]
    asked = spark.createDataFrame([("0,5",), ("9",)], "prefix string")
    assert {r.prefix: r.next for r in trie.lookup(t, asked).collect()} == {"0,5": [6, 7], "9": [0]}


def test_components_and_numbers(spark):
    edges = spark.createDataFrame([(i, f"g{i // 2}") for i in range(20)] + [(i, f"h{i // 5}") for i in range(0, 20, 4)] + [(99, "z")], "id long, group string")
    got = {r.id: r.component for r in positives.components(edges).collect()}
    up = {i: {i} for i in got}
    groups = {}
    for r in edges.collect():
        groups.setdefault(r.group, set()).add(r.id)
    for _ in range(30):
        for g in groups.values():
            union = set().union(*(up[i] for i in g))
            for i in union:
                up[i] = union
    assert got == {i: min(s) for i, s in up.items()}
    rows = spark.createDataFrame([(i,) for i in random.Random(1).sample(range(1000), 300)], "x int").repartition(5)
    n = numbering.numbered(rows, [F.col("x")], "n", 7).orderBy("x").collect()
    assert [r.n for r in n] == list(range(7, 307))


def test_checks(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), ("", "9")], "k string, v string")
    assert [tuple(r) for r in validate.dependency_violations(df, "k", "v").collect()] == [("a", 2)]
    with pytest.raises(Exception, match="no key"):
        validate.require(df, F.col("k") != "", "no key").collect()
    rows = spark.createDataFrame([(i, x) for i, x in enumerate([1, 2, 2, 1, 5] * 500)], "i long, x int")
    want = [i for i in range(1, 2500) if [1, 2, 2, 1, 5][(i - 1) % 5] > [1, 2, 2, 1, 5][i % 5]]
    assert sorted(r.i for r in validate.unsorted(rows, "i", ["x"]).collect()) == want


def test_positive_map(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "y"), (4, "b", "z"), (5, "a", "x")], "pos long, query string, text_id string")
    got = {r.text_id: r.positives for r in positives.positive_map(rows).collect()}
    assert got == {"x": ["x", "y"], "y": ["y", "z"], "z": ["y", "z"]}


def test_signed_rank_p_is_the_enumeration(spark):
    import itertools
    import random

    rnd = random.Random(8)
    rows, want = [], {}
    for n in range(1, 13):
        d = [rnd.choice([-1, 1]) * (rnd.choice([0.1, 0.2, 0.3, 0.7]) if n % 2 else k + 1.0) for k in range(n)]
        size = sorted(map(abs, d))
        ranks = [sum(i + 1 for i, s in enumerate(size) if s == abs(x)) / size.count(abs(x)) for x in d]
        w = min(sum(r for r, x in zip(ranks, d) if x > 0), sum(r for r, x in zip(ranks, d) if x < 0))
        sums = [sum(r for r, keep in zip(ranks, signs) if keep) for signs in itertools.product([0, 1], repeat=n)]
        want[f"m{n}"] = (n, w, min(1.0, 2 * sum(s <= w + 1e-9 for s in sums) / len(sums)))
        rows += [(f"m{n}", x) for x in [*d, 0.0]]
    rows += [("many", x) for x in [rnd.gauss(0.2, 1) for _ in range(200)]]
    got = {r.metric: r for r in metrics.wilcoxon_test(spark.createDataFrame(rows, "metric string, d double")).collect()}
    for m, (n, w, p) in want.items():
        assert (got[m].n, got[m].w) == (n, pytest.approx(w)) and got[m].p == pytest.approx(p)
    assert got["many"].p == pytest.approx(metrics.wilcoxon_p(got["many"].w, 200))
    # close to the approximation where that is good
    assert metrics.signed_rank_p(500.0, list(range(1, 51))) == pytest.approx(metrics.wilcoxon_p(500.0, 50, (1,)), abs=0.01)


def test_no_test_hides_another():
    import ast
    import pathlib

    for path in pathlib.Path(__file__).parent.rglob("test_*.py"):
        names = [n.name for n in ast.parse(path.read_text()).body if isinstance(n, ast.FunctionDef)]
        assert len(names) == len(set(names)), path


def test_band_flags():
    assert mining.bands("1:50, 51:100", "2,0") == [(1, 50, 2), (51, 100, 0)]
    for ranges, quotas in (("1:50", "1,2"), ("1:50,50:60", "1,1"), ("0:5", "1"), ("5:4", "1"), ("5", "1"), ("", "1"), ("1:5", ""), ("1:5", "-1")):
        with pytest.raises(ValueError):
            mining.bands(ranges, quotas)


def test_strict_ids(spark):
    df = spark.createDataFrame([(1, "7"), (2, '"a"'), (3, "null"), (4, None), (5, "[1]")], "i int, j string").withColumn("v", F.parse_json("j"))
    assert [r.y for r in df.where("i < 5").orderBy("i").select(text.strict_id(F.col("v")).alias("y")).collect()] == ["7", "a", "", ""]
    with pytest.raises(Exception, match="scalar"):
        df.select(text.strict_id(F.col("v"))).collect()
    assert one(spark, text.lowered_title("x"), "What's New (2020)?") == "what ' s new ( 2020 ) ?"
    pairs = spark.createDataFrame([("a", None), ("b", "c")], "chosen string, chosen_text_id string")
    assert sorted(r.chosen_text_id for r in validate.pair_ids(pairs, "chosen").collect()) == ["a", "c"]
    with pytest.raises(Exception, match="no rejected_text_id"):
        validate.pair_ids(pairs, "rejected").collect()


def test_nested_dev(spark):
    from docloom.operators import nq

    words = "<H1> T </H1> <P> first words </P> then <B> bold </B> <Ul> one </Ul> mid <Ul> two </Ul> end".split(" ")
    note = lambda start, end, shorts, yes="NONE": ((start, end), shorts, yes)
    schema = f"question_text string, example_id long, document_tokens array<struct<token:string>>, document_title string, document_url string, annotations {nq.ANNOTATIONS}"
    tokens = [(w,) for w in words]
    raw = spark.createDataFrame([("q", 1, tokens, "T", None, [note(3, 7, [(4, 5), (5, 6)])]), ("r", 2, [("no",), ("tags",)], "U", "u", [note(-1, -1, [], "YES")])], schema)
    a, b = nq.flatten_dev(raw).orderBy("id").collect()
    assert (a.long_answer, a.short_answer, a.abstract, a.content) == ("first words", "first|words", " first words ", "then bold one")
    assert (a.doc_tac, a.document_url) == ("T first words then bold one", "")
    assert (b.long_answer, b.short_answer, b.abstract, b.content, b.doc_tac) == ("", "yes", "", "no tags", "Uno tags")


def test_search_in_one_pass(spark):
    """Scores from the definition; null and empty texts count as documents."""
    from docloom.operators import bm25

    docs = {"a": "red red fox", "b": "fox Den", "c": "", "d": None, "e": "blue"}
    asked = {"x": "red fox", "y": "green"}
    cut = {k: (v or "").lower().split() for k, v in docs.items()}
    mean = sum(map(len, cut.values())) / len(cut)
    want = {}
    for q, t in asked.items():
        for k, words in cut.items():
            parts = [(sum(w in v for v in cut.values()), words.count(w)) for w in set(t.split()) if w in words]
            if parts:
                want[q, k] = round(sum(math.log(1 + (5 - df + 0.5) / (df + 0.5)) * tf / (tf + 0.82 * (1 - 0.68 + 0.68 * len(words) / mean)) for df, tf in parts), 6)
    got = bm25.top_k(spark.createDataFrame(list(asked.items()), "qid string, query string"), spark.createDataFrame(list(docs.items()), "docid string, contents string"))
    assert {(r.qid, r.docid): r.score for r in got.collect()} == pytest.approx(want)


def test_hooks(spark):
    from docloom.operators import hooks

    docs = spark.createDataFrame([("a", "Red fox. Blue den! More?"), ("b", ""), ("c", None)], "docid string, contents string")
    v = {r.docid: r.embedding for r in hooks.embedded(docs).collect()}
    assert math.hypot(*v["a"]) == pytest.approx(1) and sum(x > 0 for x in v["a"]) == 5 and not any(v["b"]) and not any(v["c"])
    own = hooks.embedded(docs, lambda texts: [[float(len(t))] for t in texts]).collect()
    assert {r.docid: r.embedding for r in own} == {"a": [24.0], "b": [0.0], "c": [0.0]}
    two = hooks.pseudo_queries(docs, 2).collect()
    assert [r.sample for r in two] == [0, 1] and len({r.query for r in two}) == 2 and {r.query for r in two} <= {"Red fox.", "Blue den!", "More?"}
    assert hooks.pseudo_queries(docs).count() == 3 and hooks.pseudo_queries(docs, done=docs.select("docid")).count() == 0
    pairs = spark.createDataFrame([(1, "one two three", [7, 8], [9]), (2, None, [7], [8])], "n int, prompt string, chosen array<int>, rejected array<int>")
    one, none = hooks.preference_tokens(pairs, lambda c: F.transform(text.tokenize(c), F.length), 3).orderBy("n").collect()
    assert (one.prompt_input_ids, one.prompt_attention_mask, one.chosen_labels, one.rejected_labels) == ([3, 3, 1], [1, 1, 1], [7, 8], [9])
    assert none.prompt_input_ids == [1]


def test_judgements_are_searched_once(spark):
    """A plan over judgements reads what was written, not the texts again."""
    from docloom.plans import bridge

    plan = bridge.qrels(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "LogicalRDD" in plan
