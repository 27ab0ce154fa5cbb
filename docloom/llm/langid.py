"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed 1- to 3-grams of letters per language in a distributed aggregation; what reaches the
driver is one (bucket x language) matrix, whose size is fixed by n_buckets and max_langs. The log-probability
matrix is broadcast, and numpy scores whole texts as sparse rows against it.

A text that is null or has no letter is 'und' with score 0. A null lang is never learned from. With nothing to
learn from, every text is 'und'. Rows are judged one by one, so repeated and null ids keep their rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import slices

UND = "und"
ORDERS = (1, 2, 3)
#: Grams that are scored at once.
GRAMS = 1 << 14
#: Fixed odd multipliers of the n-gram hash, one per position.
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_letters: dict[str, np.ndarray] = {}


def letter_table() -> np.ndarray:
    """True for each code point that is a letter; made once per process."""
    if "t" not in _letters:
        _letters["t"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters["t"]


def _folded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, texts, letters): the lower-cased texts end to end, anything but letters as one blank, the text of
    each of these code points, and each text's count of letters."""
    lowered = ["" if t is None else t.lower() for t in texts]
    cp = np.frombuffer(("\x00" + "\x00".join(lowered) + "\x00").encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
    is_letter = letter_table()[cp]
    at = np.repeat(np.arange(len(lowered), dtype=np.int32), sizes + 1)
    letters = np.bincount(at[is_letter[1:]], minlength=len(lowered)).astype(np.int64)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # a run of blanks counts once
    return np.where(is_letter, cp, np.uint32(32))[keep], np.concatenate([np.zeros(1, np.int32), at])[keep], letters


def _blocks(c: np.ndarray, at: np.ndarray, n_buckets: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, texts) of the grams of folded texts, of one order and about `size` places at a time; texts ascend."""
    n = len(c)
    for k in ORDERS:
        for lo in range(0, n - k + 1, size):
            hi = min(lo + size, n - k + 1)
            h = np.full(hi - lo, k * 0x632BE59BD9B4E019 % 2**64, np.uint64)
            for j in range(k):
                h = (h ^ c[lo + j : hi + j]) * np.uint64(MIX[j])
            h ^= h >> np.uint64(29)
            ok = (at[lo:hi] == at[lo + k - 1 : hi + k - 1]) & (c[lo:hi] != 32 if k == 1 else True)
            yield ((h >> np.uint64(7)) % np.uint64(n_buckets))[ok].astype(np.int32), at[lo:hi][ok]


def grams(texts: list[str | None], n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, starts, letters): the hashed grams of all texts end to end, where each text's begin (one more
    than texts), and each text's count of letters. Whole texts; anything but letters counts as one blank."""
    c, at, letters = _folded(texts)
    got = list(_blocks(c, at, n_buckets, max(1, len(c))))
    if not got:
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64), letters
    b, w = (np.concatenate(x) for x in zip(*got))
    order = np.argsort(w, kind="stable")
    return b[order], np.concatenate([[0], np.cumsum(np.bincount(w, minlength=len(texts)))]), letters


def train(labelled: DataFrame, n_buckets: int = 1 << 14, sample_rows: int = 20_000, max_langs: int = 256, alpha: float = 0.5) -> dict:
    """Fits on labelled(id, text, lang), of which about sample_rows are taken by a hash of the id where there are more
    (a documented bound on what a classifier learns from; predictions read everything), and of each language at least
    about sample_rows / max_langs, or all that it has: a rare language is learned too, and its prior stays that of all
    labels. Returns the model."""
    have = labelled.where("lang is not null and text is not null")
    sizes = {r.lang: r["count"] for r in have.groupBy("lang").count().limit(max_langs + 1).collect()}
    if len(sizes) > max_langs:
        raise ValueError(f"more than {max_langs} languages; raise max_langs")
    n = sum(sizes.values())
    if n > sample_rows:
        shares = {lang: max(sample_rows / n, sample_rows / max_langs / m) for lang, m in sizes.items()}
        parts = F.create_map(*(F.lit(x) for lang, share in shares.items() for x in (lang, min(1_000_000, math.ceil(1_000_000 * share)))))
        have = have.where(F.pmod(F.xxhash64(F.col("id"), F.lit("langid")), F.lit(1_000_000)) < parts[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for b in slices(batch, "text", 1 << 18):
                langs = b.column("lang").to_pylist()
                got, starts, _ = grams(b.column("text").to_pylist(), n_buckets)
                for lang in set(langs):
                    rows = [got[starts[i] : starts[i + 1]] for i, x in enumerate(langs) if x == lang]
                    c = np.bincount(np.concatenate(rows), minlength=n_buckets)
                    total[lang] = total.get(lang, 0) + np.append(c, len(rows))
        for lang, c in total.items():
            (at,) = np.nonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(c[at].astype(np.int64))], ["lang", "bucket", "n"])

    sums = have.select("text", "lang").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = sums.limit(max_langs * (n_buckets + 1) + 1).toArrow()
    langs = sorted(set(got.column("lang").to_pylist()))
    counts = np.zeros((n_buckets + 1, len(langs)))
    place = {x: i for i, x in enumerate(langs)}
    counts[got.column("bucket").to_numpy(), [place[x] for x in got.column("lang").to_pylist()]] = got.column("n").to_numpy()
    docs, counts = np.array([sizes[x] for x in langs], float), counts[:-1] + alpha
    return {"langs": langs, "n_buckets": n_buckets, "prior": np.log(docs / docs.sum()) if langs else np.zeros(0), "logp": np.log(counts / counts.sum(0)) if langs else np.zeros((n_buckets, 0))}


def score(texts: list[str | None], model: dict, evidence: int = 64) -> tuple[list[str], np.ndarray]:
    """Language and posterior of each text. The posterior counts the mean log-likelihood as `evidence` grams at most,
    as neighbouring grams depend on each other; this keeps it apart from 0 and 1 on long texts in two languages."""
    c, at, letters = _folded(texts)
    sizes, sums = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(model["langs"])))
    for b, w in _blocks(c, at, model["n_buckets"], GRAMS):
        if len(b) and len(model["langs"]):
            (first,) = np.nonzero(np.append(True, w[1:] != w[:-1]))
            sums[w[first]] += np.add.reduceat(model["logp"][b], first, axis=0)
            sizes[w[first]] += np.diff(np.append(first, len(b)))
    full = sizes > 0
    z = sums * (np.minimum(sizes, evidence) / np.maximum(sizes, 1))[:, None] + model["prior"]
    if not len(model["langs"]):
        return [UND] * len(texts), np.zeros(len(texts))
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    best = p.argmax(1)
    none = (letters == 0) | ~full
    return [UND if x else model["langs"][i] for x, i in zip(none, best, strict=True)], np.where(none, 0.0, p[np.arange(len(texts)), best])


def scorer(spark, model: dict, keep: list[str], names: tuple[str, str] = ("lang_pred", "score")) -> Callable:
    """A function for mapInArrow: the columns of keep, then language and score under these names, for each row."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", 1 << 18):
                langs, p = score(b.column("text").to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(langs, pa.string()), pa.array(p)], [*keep, *names])

    return run


def held_out(doc_id: Column) -> Column:
    """True for the third of ids that nothing is learned from; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def predict(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of docs, learning from its rows that are not held out."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    model = train(base.where(~held_out(F.col("doc_id"))).withColumnRenamed("doc_id", "id"), **options)
    run = scorer(docs.sparkSession, model, ["doc_id"])
    got = base.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, min_score: float = 0.5, **options) -> DataFrame:
    """The rows and columns of docs whose language is identified with min_score at least; und goes."""
    # positions stand for the columns of docs, so that no name can clash; the text goes to the scorer once
    text = next(i for i, c in enumerate(docs.columns) if c.lower() == "text")
    columns = ["text" if i == text else f"c{i}" for i in range(len(docs.columns))]
    kinds = [f.dataType.simpleString() for f in docs.schema.fields]
    base = docs.select(F.col("doc_id").cast("long").alias("id"), "text", "lang").where(~held_out(F.col("id")))
    model = train(base, **options)
    kind = ", ".join(f"{c} {k}" for c, k in zip(columns, kinds))
    got = docs.toDF(*columns).mapInArrow(scorer(docs.sparkSession, model, columns), f"{kind}, lang_pred string, score double")
    return got.where((F.col("lang_pred") != UND) & (F.col("score") >= min_score)).select(*columns).toDF(*docs.columns)


def crc_mod(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 3
