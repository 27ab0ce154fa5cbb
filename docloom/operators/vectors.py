"""Vectors in blocks: codebooks, codes and nearest neighbours, with codewords as matrices that have a fixed size."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.operators.numbering import checkpointed

#: Sums are kept as whole numbers of 2^-24, so that they do not depend on their order.
SCALE = 1 << 24
#: Words of a codebook at most: they are gathered.
MOST_WORDS = 1 << 16
#: Rows of a block of vectors, and of queries.
ROWS, ASKED = 4096, 512


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of one width, without nulls, as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def nearest_words(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The word nearest to each row, the first of equals by distances rounded to nine digits. One matrix product finds
    those that may be it; where several do, their distances are computed term by term."""
    far = (x * x).sum(1)[:, None] - 2 * (x @ words.T) + (words * words).sum(1)[None, :]
    least = far.min(1)
    scale = 1.0 + (x * x).sum(1) + (words * words).sum(1).max()
    may = far <= (least + 1e-8 + 1e-11 * scale)[:, None]
    out = far.argmin(1)
    for i in np.nonzero(may.sum(1) > 1)[0].tolist():
        some = np.nonzero(may[i])[0]
        exact = np.round(((x[i] - words[some]) ** 2).sum(1), 9)
        out[i] = some[int(exact.argmin())]
    return out


def coded(x: np.ndarray, books: list[np.ndarray], residual: bool) -> tuple[np.ndarray, np.ndarray]:
    """Codes by codebook, and what they leave over: books of successive parts of a vector, or of successive residuals."""
    codes, rest, at = np.zeros((len(x), len(books)), np.int32), x.copy(), 0
    for m, words in enumerate(books):
        part = slice(None) if residual else slice(at, at + words.shape[1])
        codes[:, m] = nearest_words(rest[:, part], words)
        rest[:, part] -= words[codes[:, m]]
        at += words.shape[1]
    return codes, rest


def encode(rows: DataFrame, vector: str, books: list[np.ndarray], residual: bool = False) -> DataFrame:
    """rows with codes array<int>, a block of vectors against the codebooks at a time. Vectors must not be null."""
    schema = T.StructType([*rows.schema.fields, T.StructField("codes", T.ArrayType(T.IntegerType()))])

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(vector))
            codes = coded(x, books, residual)[0] if len(x) else np.zeros((0, len(books)), np.int32)
            offsets = pa.array((np.arange(len(codes) + 1) * len(books)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(codes.ravel()))], [*batch.schema.names, "codes"])

    return rows.mapInArrow(run, schema)


def words_of(rows: DataFrame, order: str, vector: str) -> np.ndarray:
    """A codebook's words from rows, in order."""
    got = rows.select(order, vector).orderBy(order).limit(MOST_WORDS + 1).collect()
    if len(got) > MOST_WORDS:
        raise ValueError(f"a codebook has {MOST_WORDS} words at most")
    return np.array([r[1] for r in got], np.float64)


def seeds(rows: DataFrame, key: str, vector: str, k: int, seed: str) -> np.ndarray:
    """The k vectors whose ids have the least hashes, in that order."""
    mark = F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")))
    got = rows.select(mark.alias("h"), vector).orderBy("h").limit(k).collect()
    if len(got) < k:
        raise ValueError(f"{k} words need as many vectors")
    return np.array([r[1] for r in got], np.float64)


def lloyd_step(rows: DataFrame, vector: str, books: list[np.ndarray], fixed: int = 0, residual: bool = False) -> tuple[list[np.ndarray], float]:
    """(codebooks moved to the means of their vectors, sum of squared errors before): all codebooks in one aggregation.
    The first `fixed` ones stay. A task sends a row a word at most. Words without vectors stay where they are."""
    widths = [b.shape[1] for b in books]

    def run(batches):
        n = [np.zeros(len(b), np.int64) for b in books]
        sums = [np.zeros(b.shape, np.int64) for b in books]
        error = 0
        for batch in batches:
            x = _matrix(batch.column(vector))
            if not len(x):
                continue
            rest, at = x.copy(), 0
            for m, words in enumerate(books):
                part = slice(None) if residual else slice(at, at + widths[m])
                own = rest[:, part].copy()
                code = nearest_words(own, words)
                if m >= fixed:
                    np.add.at(n[m], code, 1)
                    np.add.at(sums[m], code, np.floor(own * SCALE + 0.5).astype(np.int64))
                rest[:, part] = own - words[code]
                at += widths[m]
            error += int(np.round((rest * rest).sum(1) * SCALE).astype(np.int64).sum())
        out = [{"m": m, "k": k, "n": int(n[m][k]), "i": i, "s": int(v)} for m in range(fixed, len(books)) for k in np.nonzero(n[m])[0].tolist() for i, v in enumerate(sums[m][k].tolist())]
        yield pa.RecordBatch.from_pylist([*out, {"m": -1, "k": 0, "n": 0, "i": 0, "s": error}], pa.schema([("m", pa.int32()), ("k", pa.int32()), ("n", pa.int64()), ("i", pa.int32()), ("s", pa.int64())]))

    parts = rows.select(vector).where(F.col(vector).isNotNull()).mapInArrow(run, "m int, k int, n long, i int, s long")
    total = parts.groupBy("m", "k", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    moved, error = [b.copy() for b in books], 0.0
    for r in total.collect():
        if r.m < 0:
            error = int(r.s) / SCALE
        else:
            moved[r.m][r.k, r.i] = int(r.s) / SCALE / r.n
    return moved, error


def product_books(rows: DataFrame, key: str, vector: str, parts: int, k: int, rounds: int = 10, seed: str = "42") -> list[np.ndarray]:
    """Codebooks of `parts` successive parts of a vector, k words each: all of them in one pass over the rows a round."""
    books = np.split(seeds(rows, key, vector, k, seed), parts, axis=1)
    for _ in range(rounds):
        moved, _ = lloyd_step(rows, vector, books)
        if all((a == b).all() for a, b in zip(moved, books)):
            break
        books = moved
    return books


def residual_books(rows: DataFrame, key: str, vector: str, levels: int, k: int, rounds: int = 10, seed: str = "42") -> list[np.ndarray]:
    """Codebooks of successive residuals, level by level; residuals are computed in the pass that sums them. A level's
    first words are the residuals of the vectors whose ids have the least hashes."""
    books: list[np.ndarray] = []
    for level in range(levels):
        first = seeds(rows, key, vector, k, f"{seed}.{level}")
        books.append(coded(first, books, True)[1] if books else first)
        for _ in range(rounds):
            moved, _ = lloyd_step(rows, vector, books, level, True)
            if (moved[level] == books[level]).all():
                break
            books = moved
    return books


def book_rows(spark, books: list[np.ndarray]) -> DataFrame:
    """(part, code, i, v) of codebooks."""
    rows = [(m, c, i, float(x)) for m, book in enumerate(books) for c, word in enumerate(book) for i, x in enumerate(word)]
    return spark.createDataFrame(rows, "part int, code int, i int, v double")


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


class Lists:
    """Inverted lists of unit vectors by the nearest word of a coarse codebook, in blocks of rows with codes.

    blocks(list, block, ids, vectors, codes, slack): packed arrays; slack is how far each vector lies from its codewords.
    facts: of each list its number of blocks and how near and far its vectors lie from its word, one row a list."""

    def __init__(self, rows: DataFrame, key: str, vector: str, lists: int = 64, parts: int = 8, k: int = 16, rounds: int = 5):
        unit = rows.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"))
        length = F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)
        unit = checkpointed(unit.where(length > 0).withColumn("x", F.transform("x", lambda v: v / F.sqrt(length))))
        n = unit.count()
        self.coarse = product_books(unit, "id", "x", 1, max(1, min(lists, n)), rounds)[0] if n else np.zeros((1, 1))
        self.books = product_books(unit, "id", "x", parts, max(1, min(k, n)), rounds) if n else []
        coarse, books = self.coarse, self.books

        def placed(batches):
            for batch in batches:
                x = _matrix(batch.column("x"))
                if len(x):
                    yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("x"), pa.array(nearest_words(x, coarse).astype(np.int32))], ["id", "x", "list"])

        def packed(group: pa.Table) -> pa.Table:
            x = _matrix(group.column("x").combine_chunks())
            codes, rest = coded(x, books, False)
            far = np.sqrt(((x - coarse[group.column("list")[0].as_py()]) ** 2).sum(1))
            row = {"list": group.column("list")[0].as_py(), "block": group.column("block")[0].as_py(), "ids": group.column("id").to_numpy().astype("<i8").tobytes(), "vectors": x.astype("<f8").tobytes(), "codes": codes.astype("<i4").tobytes(), "slack": np.sqrt((rest * rest).sum(1)).astype("<f8").tobytes(), "near": float(far.min()), "far": float(far.max())}
            return pa.Table.from_pylist([row], pa.schema([("list", pa.int32()), ("block", pa.int32()), *((c, pa.binary()) for c in ("ids", "vectors", "codes", "slack")), ("near", pa.float64()), ("far", pa.float64())]))

        own = checkpointed(unit.mapInArrow(placed, "id long, x array<double>, list int"))
        sizes = F.broadcast(own.groupBy("list").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("blocks")))  # a row a list
        dealt = own.join(sizes, "list").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks")
        self.blocks = checkpointed(dealt.groupBy("list", "block").applyInArrow(packed, "list int, block int, ids binary, vectors binary, codes binary, slack binary, near double, far double"))
        self.facts = {r.list: (r.n, r.near, r.far) for r in self.blocks.groupBy("list").agg(F.count("*").alias("n"), F.min("near").alias("near"), F.max("far").alias("far")).collect()}


def _probed(index: Lists, asked: DataFrame, choose, k: int) -> DataFrame:
    """(query_id, vec_id, cosine): of each query of asked(query_id, q, tau) its k best vectors in the lists that
    choose(distances to all words, tau) names, of those that may be nearer than tau. Blocks of queries meet blocks of a list."""
    facts, coarse, books = index.facts, index.coarse, index.books
    width = coarse.shape[1]

    def spread(batches):
        for batch in batches:
            q = _matrix(batch.column("q"))
            if not len(q):
                continue
            tau = batch.column("tau").to_numpy(zero_copy_only=False).astype(np.float64)
            to = np.sqrt(np.maximum(0, (q * q).sum(1)[:, None] - 2 * q @ coarse.T + (coarse * coarse).sum(1)[None, :]))
            picked = choose(to, tau)
            for name, (blocks, _, _) in facts.items():
                (there,) = np.nonzero(picked[:, name])
                for at in range(0, len(there), ASKED):
                    some = there[at : at + ASKED]
                    ids = batch.column("query_id").take(pa.array(some)).to_numpy().astype("<i8").tobytes()
                    row = {"list": name, "q_ids": ids, "q": q[some].astype("<f8").tobytes(), "taus": tau[some].astype("<f8").tobytes()}
                    yield pa.RecordBatch.from_pylist([row | {"block": b} for b in range(blocks)], pa.schema([("list", pa.int32()), ("q_ids", pa.binary()), ("q", pa.binary()), ("taus", pa.binary()), ("block", pa.int32())]))

    def compare(batches):
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for r in batch.to_pylist():
                ids, q_ids = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["q_ids"], "<i8")
                q, tau = np.frombuffer(r["q"], "<f8").reshape(-1, width), np.frombuffer(r["taus"], "<f8")
                x, slack = np.frombuffer(r["vectors"], "<f8").reshape(-1, width), np.frombuffer(r["slack"], "<f8")
                codes = np.frombuffer(r["codes"], "<i4").reshape(len(ids), -1)
                about, at = np.zeros((len(q), len(ids))), 0
                for m, words in enumerate(books):  # a table of distances from each query to the words of each part
                    part = q[:, at : at + words.shape[1]]
                    about += ((part[:, None, :] - words[None]) ** 2).sum(2)[:, codes[:, m]]
                    at += words.shape[1]
                may = np.sqrt(about) - slack[None, :] <= tau[:, None] + 1e-9
                for i in np.nonzero(may.any(1))[0].tolist():
                    there = np.nonzero(may[i] & (ids != q_ids[i]))[0]
                    cosine = np.round(x[there] @ q[i], 9)
                    best = np.lexsort((ids[there], -cosine))[:k]
                    out[0].extend([int(q_ids[i])] * len(best))
                    out[1].extend(ids[there][best].tolist())
                    out[2].extend(cosine[best].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "cosine"])

    sent = asked.select("query_id", "q", "tau").mapInArrow(spread, "list int, q_ids binary, q binary, taus binary, block int")
    return index.blocks.join(sent, ["list", "block"]).mapInArrow(compare, "query_id long, vec_id long, cosine double")


def neighbours(index: Lists, queries: DataFrame, k: int = 10, probes: int = 4) -> DataFrame:
    """(query_id, rank, vec_id, cosine): exactly the k vectors of the index with the greatest cosine to each of
    queries(query_id long, q array<double>), itself left out; ties, of cosines rounded to nine digits, go by id.

    The nearest `probes` lists give a distance within which k vectors lie. Every other list is read too that may hold one
    so near, by the triangle inequality from its word; of its vectors, those whose codes say that they may be so near."""
    length = F.aggregate("q", F.lit(0.0), lambda s, v: s + v * v)
    asked = queries.select("query_id", F.col("q").cast("array<double>").alias("q")).where(length > 0)
    asked = checkpointed(asked.withColumn("q", F.transform("q", lambda v: v / F.sqrt(length))))
    facts, lists = index.facts, len(index.coarse)
    there = np.zeros(lists, bool)
    there[list(facts)] = True
    low, high = np.zeros(lists), np.zeros(lists)
    for name, (_, near, far) in facts.items():
        low[name], high[name] = near, far

    def first(to, tau):
        rank = np.argsort(np.argsort(np.where(there, to, np.inf), axis=1, kind="stable"), axis=1)
        return (rank < probes) & there

    def others(to, tau):
        bound = np.maximum(np.maximum(to - high, low - to), 0)
        return ~first(to, tau) & there & (bound <= tau[:, None] + 1e-6)

    best = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")
    top = lambda rows: rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    found = checkpointed(top(_probed(index, asked.withColumn("tau", F.lit(math.inf)), first, k)))
    # of unit vectors, the squared distance is 2 - 2 cosine; a little more for rounding
    reach = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.min("cosine"))) + 1e-6
    tau = found.groupBy("query_id").agg(F.when(F.count("*") == k, reach).alias("tau"))
    known = asked.join(tau, "query_id", "left").withColumn("tau", F.coalesce("tau", F.lit(math.inf)))
    return top(found.drop("rank").unionByName(_probed(index, known, others, k))).select("query_id", "rank", "vec_id", "cosine")
