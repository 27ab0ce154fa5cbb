"""Soft-membership mixing to target weights, in DataFrame functions only.

A naive Bayes classifier over hashed words is fitted on the table of labels (a bounded sample of each domain) and
predicts, for every document, posteriors of the domains clean, low (quality 0) and toxic. Rates r >= 0 per document are
then fitted by projected gradient on the least squares of expected domain tokens: with t tokens and posteriors p,

    A = sum of r t p,   minimise  (A - T)' W (A - T) / 2,   from r = 1 on:  r <- max(0, r - p . W (A - T))

for the targets T. The weights W are the inverse Gram matrix of the documents whose rates are not 0, taken anew at each
step (halved where a step would not lower the residual), so that overlapping domains need few steps. A step is one
distributed aggregation of fifteen sums; steps are three numbers each, and a document's rate is folded from them where it is
needed, never stored or shuffled. All steps share one plan, as they stand in it as one array. Steps end when no domain
misses its target by more than `enough` of all tokens and of itself. If no step along the gradient brings the totals
closer, no rates reach the targets: what is closest is returned, with a warning that states the residual. Rates that
have not settled after `most_steps` raise an error.

A null text has no tokens, the priors as posteriors, and weighs nothing. A domain without labels has no posterior, and
its target goes to the others. Repeated rows and ids count each; a labelled id that several documents have teaches with
each of them. With an empty table there are no rows. Columns of docs keep their names and values; those that are added
take names that docs does not have.
"""

from __future__ import annotations

import json
import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DOMAINS = ("clean", "low", "toxic")
BUCKETS, SAMPLE, EVIDENCE = 4096, 20_000, 400
#: Target shares of all tokens (a parameter of production, not of the method).
TARGETS = {"clean": 0.93, "low": 0.06, "toxic": 0.01}


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _buckets(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.pmod(F.xxhash64(F.lower(w)), F.lit(BUCKETS)).cast("int"))


def fit_classifier(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE, alpha: float = 0.2) -> dict:
    """Log-priors and log-probabilities per domain and bucket; learns from about sample_rows labels of each domain at
    most (a documented bound), chosen by a hash of the id, so that no rare domain loses its labels. Priors are those of all labels."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean")
    known = labels.select(F.col("doc_id").cast("long").alias("id"), domain.alias("domain")).where("id is not null and domain is not null").distinct()
    share = {r["domain"]: min(1.0, sample_rows / r["n"]) for r in known.groupBy("domain").agg(F.count("*").alias("n")).collect()}  # a row a domain
    part = F.coalesce(*(F.when(F.col("domain") == d, F.lit(int(1_000_000 * x))) for d, x in share.items()), F.lit(0))
    known = known.where(F.pmod(F.xxhash64("id", F.lit("mixing")), F.lit(1_000_000)) < part)
    taught = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "id")
    cells = taught.select("domain", F.explode_outer(F.array_append(_buckets(F.coalesce("text", F.lit(""))), F.lit(BUCKETS))).alias("bucket")).groupBy("domain", "bucket").count()
    count = {(r["domain"], r["bucket"]): r["count"] for r in cells.collect()}  # 3 x (buckets + 1) rows at most
    docs_of = {d: count.get((d, BUCKETS), 0) / share.get(d, 1.0) for d in DOMAINS}
    known_docs = sum(docs_of.values())
    # a domain that no label teaches gets no posterior; without any label all is the first domain
    model: dict = {"prior": [math.log(n / known_docs) if n else -1e9 for n in docs_of.values()] if known_docs else [0.0, *[-1e9] * (len(DOMAINS) - 1)], "logp": []}
    for d in DOMAINS:
        c = [count.get((d, b), 0) + alpha for b in range(BUCKETS)]
        total = sum(c)
        model["logp"].append([math.log(x / total) for x in c])
    return model


def _looked_up(buckets: Column, table: Column) -> Column:
    """Sum of the table's values at the buckets."""
    return F.aggregate(buckets, F.lit(0.0), lambda a, b: a + F.get(table, b))


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """The names, with underscores where docs has a column of that name."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def with_posteriors(docs: DataFrame, model: dict, tokens: str, p: str, text_col: str = "text") -> DataFrame:
    """docs with columns of these names: tokens, and p (posteriors in the order of DOMAINS); map-side only."""
    b, z, e = free_names(docs, "_b", "_z", "_e")
    got = docs.withColumn(b, _buckets(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))))
    got = got.withColumn(tokens, F.size(b).cast("long"))
    part = F.lit(float(EVIDENCE)) / F.greatest(F.col(tokens), F.lit(EVIDENCE)).cast("double")
    sums = [F.lit(prior) + part * _looked_up(F.col(b), F.from_json(F.lit(json.dumps(logp)), "array<double>")) for prior, logp in zip(model["prior"], model["logp"], strict=True)]
    got = got.withColumn(z, F.array(*sums))
    top = F.array_max(z)
    got = got.withColumn(e, F.transform(z, lambda x: F.exp(x - top)))
    whole = sum((F.get(e, F.lit(i)) for i in range(1, len(DOMAINS))), F.get(e, F.lit(0)))
    return got.withColumn(p, F.transform(e, lambda x: x / whole)).drop(b, z, e)


def rate(steps: list[list[float]], p: str = "_p") -> Column:
    """The rate after these steps, folded from the posteriors alone."""
    if not steps:
        return F.lit(1.0)
    told = F.from_json(F.lit(json.dumps(steps)), "array<array<double>>")
    along = lambda e: sum((F.get(p, F.lit(i)) * F.get(e, F.lit(i)) for i in range(1, len(DOMAINS))), F.get(p, F.lit(0)) * F.get(e, F.lit(0)))
    return F.aggregate(told, F.lit(1.0), lambda r, e: F.greatest(F.lit(0.0), r - along(e)))


def fit_rates(members: DataFrame, targets: dict[str, float], most_steps: int = 200, enough: float = 1e-4, tokens: str = "_tokens", p: str = "_p") -> list[list[float]]:
    """The steps of rate() over members(tokens, p), none where there is nothing to weigh."""
    n = len(DOMAINS)
    x = [F.get(p, F.lit(i)) for i in range(n)]

    def sums(steps: list[list[float]]) -> tuple[np.ndarray, np.ndarray, float]:
        """Domain totals at the rates after these steps, the Gram matrix of the rates that are not 0, and all tokens."""
        r, t = F.col("r"), F.col(tokens)
        cells = [*(F.sum(r * t * a) for a in x), *(F.sum(F.when(r > 0, t * x[i] * x[j])) for i in range(n) for j in range(i, n)), F.sum(t)]
        got = np.array([v or 0.0 for v in members.withColumn("r", rate(steps, p)).agg(*cells).first()])
        gram = np.zeros((n, n))
        gram[np.triu_indices(n)] = got[n:-1]
        return got[:n], gram + np.triu(gram, 1).T, got[-1]

    now, gram, whole = sums([])
    # targets of domains that no document may belong to are shared out among the others
    there = now > 1e-9 * whole
    asked = sum(targets[d] for d, t in zip(DOMAINS, there, strict=True) if t)
    if not whole or not asked:
        return []
    want = np.array([targets[d] / asked * whole if t else 0.0 for d, t in zip(DOMAINS, there, strict=True)])
    near = np.where(there, enough * np.minimum(whole, want + 0.01 * whole), np.inf)
    miss = lambda at: float(np.sqrt((((at - want) / near) ** 2).sum()))
    residual = lambda at: f"{np.abs((at - want) / whole)[there].max():.2g} of all tokens"
    steps: list[list[float]] = []
    for _ in range(most_steps):
        if (np.abs(now - want) <= near).all():
            return steps
        held = np.where(np.outer(there, there), gram, 0.0) + np.diag(np.where(there, 1e-12, 1.0) * whole)
        way = np.linalg.solve(held, np.where(there, now - want, 0.0))
        size = 1.0
        while True:
            tried = sums([*steps, (size * way).tolist()])
            if miss(tried[0]) < miss(now) - 1e-3:
                break
            size /= 2
            if size < 1e-3:
                warnings.warn(f"rates come no closer to their targets than {residual(now)}", RuntimeWarning, stacklevel=2)
                return steps
        steps.append((size * way).tolist())
        now, gram, _ = tried
    raise RuntimeError(f"rates did not settle in {most_steps} steps: residual {residual(now)}")


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, **options) -> tuple[DataFrame, Column, Column, Column]:
    """docs with two more columns; tokens, posteriors and the fitted rate as columns over it."""
    from docloom.llm.common import drop_table, materialise

    model = fit_classifier(docs, labels, **options)
    tokens, p = free_names(docs, "_tokens", "_p")
    scored = with_posteriors(docs, model, tokens, p)
    members = materialise(scored.select(F.col(tokens).alias("_tokens"), F.col(p).alias("_p")), "members")
    steps = fit_rates(members, targets or TARGETS)
    drop_table(members)
    return scored, F.col(tokens), F.col(p), rate(steps, p)


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, **options) -> DataFrame:
    """The rows of docs as often as their rates say: the whole part, and one more by a hash of the row against the rest."""
    scored, _, _, r = mixing_rates(docs, labels, targets, **options)
    chance = F.pmod(F.xxhash64("doc_id", "text", F.lit("mix")), F.lit(1 << 30)).cast("double") / float(1 << 30)
    # rows of rate 0 go after the generator: a filter before it would be pushed below the posteriors, which would be
    # planned and computed once more for each mention
    n, k = free_names(scored, "_n", "_k")
    got = scored.withColumn(n, F.floor(r + chance).cast("int")).withColumn(k, F.explode_outer(F.array_repeat(F.lit(1), F.col(n))))
    return got.where(F.col(k).isNotNull()).select(*(F.col(f"`{c}`") for c in docs.columns))
