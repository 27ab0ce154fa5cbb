"""Prefix trees of token sequences as tables, and searches that they constrain."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.numbering import checkpointed, numbered


def text(c: Column) -> Column:
    return F.array_join(c.cast("array<string>"), ",")


def next_tokens(sequences: DataFrame) -> DataFrame:
    """(prefix, next): the tokens that may follow each prefix of sequences(tokens array<int>); prefixes as text, the
    empty one included. Prefixes are counted by groups, and no tree is held in one place."""
    at = F.explode(F.sequence(F.lit(0), F.size("tokens") - 1)).alias("n")
    rows = sequences.where(F.size("tokens") > 0).select("tokens", at)
    return rows.groupBy(text(F.slice("tokens", F.lit(1), F.col("n"))).alias("prefix")).agg(F.array_sort(F.collect_set(F.get("tokens", F.col("n")))).alias("next"))


def lookup(trie: DataFrame, prefixes: DataFrame, pad: int = 0) -> DataFrame:
    """prefixes(prefix) with next, or the pad token where nothing may follow."""
    return prefixes.join(trie, "prefix", "left").withColumn("next", F.coalesce("next", F.array(F.lit(pad))))


def leaves(sequences: DataFrame, trie: DataFrame) -> DataFrame:
    """Distinct sequences(text) that are no strict prefix of another: what walking the tree yields."""
    return sequences.select(text(F.col("tokens")).alias("sequence")).distinct().join(trie.select(F.col("prefix").alias("sequence")), "sequence", "left_anti")


def appended(first: DataFrame, second: DataFrame, bos: int) -> DataFrame:
    """(prefix, next) of a trie with another appended at a token: where bos may follow, the other's first tokens may
    instead; prefixes that the first does not know are the other's."""
    roots = second.where("prefix = ''").select(F.col("next").alias("roots"))
    swapped = first.join(F.broadcast(roots), how="left")
    here = F.array_contains("next", bos)
    opened = swapped.select("prefix", F.when(here, F.array_sort(F.array_distinct(F.concat(F.array_remove("next", bos), F.coalesce("roots", F.array().cast("array<int>")))))).otherwise(F.col("next")).alias("next"))
    return opened.unionByName(second.where("prefix <> ''").join(first.select("prefix"), "prefix", "left_anti"))


#: Steps of a level up to which they are broadcast; states that many hypotheses share are on levels of few steps.
BROADCAST_STEPS = 1_000_000


def numbered_steps(sequences: DataFrame) -> DataFrame:
    """(depth, state, token, next, inner): the tree of sequences(tokens array<int>) with numbers for its nodes, 0 the root.
    inner says whether anything follows the node `next`. Level by level, the distinct steps out of its nodes are numbered
    in order; no prefix is ever spelled out. Empty sequences add nothing."""
    left = checkpointed(sequences.select("tokens").distinct().where(F.size("tokens") > 0).withColumn("state", F.lit(0).cast("long")))
    levels, depth, first = [], 0, 1
    while not left.isEmpty():
        token = F.get("tokens", F.lit(depth))
        ends = F.max(F.size("tokens") > depth + 1).alias("inner")
        steps = left.groupBy("state", token.alias("token")).agg(ends)
        steps = checkpointed(numbered(steps, [F.col("state"), F.col("token")], "next", first))
        n = steps.count()
        levels.append(steps.select(F.lit(depth).alias("depth"), "state", "token", "next", "inner"))
        to = steps.where("inner").select("state", F.col("token").alias("_t"), "next")
        to = F.broadcast(to) if n <= BROADCAST_STEPS else to
        going = left.where(F.size("tokens") > depth + 1).withColumn("_t", token)
        left = checkpointed(going.join(to, ["state", "_t"]).select("tokens", F.col("next").alias("state")))
        depth, first = depth + 1, first + n
    if not levels:
        return sequences.sparkSession.createDataFrame([], "depth int, state long, token int, next long, inner boolean")
    return checkpointed(reduce(DataFrame.unionByName, levels))


def following(steps: DataFrame, asked: DataFrame, pad: int = 0) -> DataFrame:
    """(tokens, next): the sorted tokens that may follow each of asked(tokens array<int>) in the tree of numbered_steps(),
    the pad token alone where none may. The tree is walked a level at a time by the numbers of its nodes."""
    left = checkpointed(asked.select("tokens").distinct().withColumn("state", F.lit(0).cast("long")))
    longest = left.agg(F.max(F.size("tokens"))).first()[0] or 0
    for depth in range(longest):
        token = F.get("tokens", F.lit(depth))
        to = _level(steps, depth).select("state", F.col("token").alias("_t"), "next")
        more = left.where(F.size("tokens") > depth).withColumn("_t", token).join(to, ["state", "_t"], "left").select("tokens", F.col("next").alias("state"))
        left = checkpointed(left.where(F.size("tokens") <= depth).unionByName(more))
    own = steps.groupBy("state").agg(F.array_sort(F.collect_list("token")).alias("next"))
    return left.join(own, "state", "left").select("tokens", F.coalesce("next", F.array(F.lit(pad))).alias("next"))


def _level(steps: DataFrame, depth: int) -> DataFrame:
    own = steps.where(F.col("depth") == depth).drop("depth")
    return F.broadcast(own) if own.count() <= BROADCAST_STEPS else own


def _best(rows: DataFrame, width: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("total"), text(F.col("tokens"))))
    return rows.withColumn("_p", place).where(F.col("_p") <= width).drop("_p")


def _finished(live: DataFrame) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("total"), text(F.col("tokens"))))
    return live.select("qid", rank.alias("rank"), text(F.col("tokens")).alias("sequence"), "total")


def beam_search(queries: DataFrame, steps: DataFrame, score, width: int, longest: int) -> DataFrame:
    """(qid, rank, sequence, total): the best sequences of each query among those of numbered_steps().

    A level at a time: hypotheses meet the steps out of their state, by its number, each step is scored by score(qid,
    prefix, token), and the best `width` a query are kept, finished ones among them; it ends at `longest` tokens or when no
    hypothesis is open. Ties go by the sequence as text."""
    none = F.array().cast("array<int>")
    live = queries.select("qid").withColumns({"state": F.lit(0).cast("long"), "tokens": none, "total": F.lit(0.0), "open": F.lit(True)})
    for depth in range(longest):
        grown = live.where("open").join(_level(steps, depth), "state")
        total = F.round(F.col("total") + score(F.col("qid"), text(F.col("tokens")), F.col("token")), 6)
        grown = grown.select("qid", F.col("next").alias("state"), F.array_append("tokens", F.col("token")).alias("tokens"), total.alias("total"), F.col("inner").alias("open"))
        live = checkpointed(_best(grown.unionByName(live.where("not open")), width))
        if live.where("open").isEmpty():
            break
    return _finished(live)


def generate(queries: DataFrame, steps: DataFrame, model: Callable[[], object], width: int, longest: int) -> DataFrame:
    """beam_search() with a model that scores in batches and keeps a state of its own for each hypothesis.

    model() makes one in a task, once. Its start(list of queries) gives a state (bytes) for each of queries(qid, query); its
    step(states, tokens, allowed) takes the states of hypotheses, their last tokens (None at first) and the tokens that may
    follow each, and gives a state after the last token and an array of scores in the order of allowed, for each. A
    hypothesis sends no more than `width` followers on, as no more can be kept."""
    begun = "qid string, state long, tokens array<int>, total double, open boolean, memory binary"

    def start(batches):
        m = model()
        for batch in batches:
            n = batch.num_rows
            memory = m.start(batch.column("query").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("qid"), pa.array([0] * n, pa.int64()), pa.array([[]] * n, pa.list_(pa.int32())), pa.array([0.0] * n), pa.array([True] * n), pa.array(memory, pa.binary())], ["qid", "state", "tokens", "total", "open", "memory"])

    def step(batches):
        m = model()
        for batch in batches:
            rows = batch.to_pylist()
            if not rows:
                continue
            memory, scores = m.step([r["memory"] for r in rows], [r["tokens"][-1] if r["tokens"] else None for r in rows], [[x["token"] for x in r["steps"]] for r in rows])
            out = []
            for r, mem, own in zip(rows, memory, scores):
                total = np.round(r["total"] + np.asarray(own, float), 6)
                tokens = [x["token"] for x in r["steps"]]
                best = sorted(range(len(tokens)), key=lambda i: (-total[i], str(tokens[i])))[:width]
                out += [{"qid": r["qid"], "state": r["steps"][i]["next"], "tokens": [*r["tokens"], tokens[i]], "total": float(total[i]), "open": r["steps"][i]["inner"], "memory": mem} for i in best]
            yield pa.RecordBatch.from_pylist(out, batch_schema)

    batch_schema = pa.schema([("qid", pa.string()), ("state", pa.int64()), ("tokens", pa.list_(pa.int32())), ("total", pa.float64()), ("open", pa.bool_()), ("memory", pa.binary())])
    live = checkpointed(queries.select(F.col("qid").cast("string").alias("qid"), "query").mapInArrow(start, begun))
    for depth in range(longest):
        own = steps.where(F.col("depth") == depth)
        follow = own.groupBy("state").agg(F.array_sort(F.collect_list(F.struct("token", "next", "inner"))).alias("steps"))
        follow = F.broadcast(follow) if own.count() <= BROADCAST_STEPS else follow
        grown = live.where("open").join(follow, "state").mapInArrow(step, begun)
        live = checkpointed(_best(grown.unionByName(live.where("not open")), width))
        if live.where("open").isEmpty():
            break
    return _finished(live)


def lookup_codes(generated: DataFrame, codes: DataFrame, seed: str) -> DataFrame:
    """(qid, rank, code, docid, place, how) of generated(qid, rank, code): the documents of a code, or of the code with
    or without a trailing ,1; documents of one code in the order of a draw. how is primary, alternate or none."""
    other = F.when(F.col("code").endswith(",1"), F.expr("substring(code, 1, length(code) - 2)")).otherwise(F.concat("code", F.lit(",1")))
    asked = generated.withColumn("alternate", other)
    known = codes.select("code").distinct()
    hit = asked.join(known.withColumn("_a", F.lit(True)), "code", "left")
    hit = hit.join(known.select(F.col("code").alias("alternate")).withColumn("_b", F.lit(True)), "alternate", "left")
    used = F.when(F.col("_a"), F.col("code")).when(F.col("_b"), F.col("alternate"))
    how = F.when(F.col("_a"), "primary").when(F.col("_b"), "alternate").otherwise("none")
    hit = hit.select("qid", "rank", F.col("code").alias("asked"), used.alias("code"), how.alias("how"))
    got = hit.join(codes, "code", "left")
    key = F.sha2(F.concat_ws("|", F.lit(seed), "qid", "docid"), 256)
    place = F.row_number().over(Window.partitionBy("qid", "rank").orderBy(key, "docid"))
    return got.select("qid", "rank", F.col("asked").alias("code"), "docid", place.alias("place"), "how")
