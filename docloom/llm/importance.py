"""Importance resampling towards a target: hashed bags of words weigh documents, a radix selection finds the last one drawn."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import id_text, materialise, slices

BUCKETS, GRAMS, PERCENT, LEAST_WORDS, SEED = 10_000, 1, 10, 20, "2024"
#: Bits of a digit of the selection: a pass gathers 2^16 counts at most, whatever the input.
DIGIT = 16
#: Bytes of a text that are split into words at once.
PIECE = 1 << 20
_TOP = 1 << 63
#: Letters in lower case; ASCII that is neither letter nor digit parts words.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def buckets_of(text: bytes, grams: int, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Piece by piece of a text: its number of words, and the buckets of all runs of 1 to grams words that end in it."""
    text, at, before = text.translate(_WORDS), 0, []
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        words = before + text[at:end].split()
        first = len(before)
        runs = list(map(crc32, words[first:]))
        for k in range(2, grams + 1):
            runs += [crc32(b" ".join(words[i - k + 1 : i + 1])) for i in range(max(first, k - 1), len(words))]
        yield len(words) - first, np.array(runs, np.uint32) % buckets
        before = words[max(0, len(words) - grams + 1) :] if grams > 1 else []
        at = end


def _counts(grams: int, buckets: int):
    def run(batches):
        held = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                for text in part.column("text").cast(pa.binary()):
                    for _, found in buckets_of(text.as_py() or b"", grams, buckets):
                        held += np.bincount(found, minlength=buckets)
        (there,) = np.nonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(held[there])], ["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket. A task sends a row a bucket at most, and their sums are one array of fixed length."""
    sums = texts.select("text").mapInArrow(_counts(grams, buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in sums.collect():
        out[row.bucket] = row.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares of each bucket in the target and in the corpus, rounded down."""
    n = len(corpus)
    s_all, t_all = float(corpus.sum() + n), float(target.sum() + n)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def noise(seed: str, doc_id: int | None) -> int:
    """Gumbel noise in thousandths, by a hash of the id; a null id reads as an empty one."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scored(gain: np.ndarray, grams: int, seed: str, with_text: bool):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                ids, rows = part.column("doc_id").to_pylist(), []
                for doc_id, text in zip(ids, part.column("text").cast(pa.binary())):
                    words = features = weight = 0
                    for n, found in buckets_of(text.as_py() or b"", grams, len(gain)):
                        words, features, weight = words + n, features + len(found), weight + int(gain[found].sum())
                    rows.append((words, features, weight, weight + noise(seed, doc_id)))
                numbers = [pa.array(x, pa.int64()) for x in zip(*rows)]
                names = ["doc_id", "n_words", "n_features", "weight", "score"]
                more = ([part.column("text")], ["text"]) if with_text else ([], [])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *numbers, *more[0]], names + more[1])

    return run


def kth(rows: DataFrame, keys: list[str], k: int) -> tuple[int, ...]:
    """The keys (long, not null) of the k-th row, from 1 on, in ascending order of keys: radix selection from the highest
    digit in which the rows left differ. A pass counts the digits of the rows that agree with all digits found so far;
    once one row is left, it is read. No row is sorted or moved."""
    found: list[int] = []
    for at, key in enumerate(keys):
        low, high = rows.agg(F.min(key), F.max(key)).first()
        if low == high:
            found.append(low)
            continue
        digits = F.col(key).bitwiseXOR(F.lit(-_TOP))  # in unsigned order
        low, high = low + _TOP, high + _TOP
        shift = ((low ^ high).bit_length() - 1) // DIGIT * DIGIT
        prefix = low >> (shift + DIGIT)
        while shift >= 0:
            counts = rows.groupBy(F.shiftrightunsigned(digits, shift).bitwiseAND(F.lit((1 << DIGIT) - 1)).alias("digit")).count()
            for digit, n in sorted(map(tuple, counts.collect())):
                if k <= n:
                    break
                k -= n
            prefix = prefix << DIGIT | digit
            least, most = (prefix << shift) - _TOP, (prefix + 1 << shift) - 1 - _TOP
            rows = rows.where(F.col(key).between(least, most))
            if n == 1:
                return (*found, *(rows.select(*keys[at:]).first()))
            shift -= DIGIT
        found.append(prefix - _TOP)
    return tuple(found)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, grams: int = GRAMS, buckets: int = BUCKETS, seed: str = SEED, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank[, text]) of each row of docs: weight is how much likelier its hashed
    words are among the texts of target than in docs, score adds noise by a hash of the id; rank numbers the rows drawn
    without replacement, the floor of percent of those with least_words words, by falling score, and is null elsewhere.

    Null and empty texts have no features and weigh 0. Ties go to the smaller id, null ids last, then to fewer features;
    repeated rows are drawn one by one. An empty target leaves the smoothed shares of docs; empty docs give no rows. Further
    columns are not read. Every text is read whole, twice: to count and to weigh. The array of gains has a fixed length. Only
    rows that are drawn are sorted, by ranges, and only the number of rows a range meets in one place."""
    rows = id_text(docs, id_col, text_col)
    gain = gains(bucket_counts(rows, grams, buckets), bucket_counts(target.select(F.col(target_col).cast("string").alias("text")), grams, buckets))
    kind = "doc_id long, n_words long, n_features long, weight long, score long" + (", text string" if with_text else "")
    scored = rows.mapInArrow(_scored(gain, grams, seed, with_text), kind)
    # the keys of the selection; the last one tells repeated rows apart, and is kept with the rows
    scored = materialise(scored.withColumn("tie", F.monotonically_increasing_id()), "scored")
    keyed = scored.withColumns({"down": -F.col("score"), "no_id": F.col("doc_id").isNull().cast("long"), "id": F.coalesce("doc_id", F.lit(0).cast("long"))})
    keys = ["down", "no_id", "id", "n_features", "tie"]
    may = keyed.where(F.col("n_words") >= least_words)
    k = may.count() * percent // 100
    out = [c for c in scored.columns if c != "tie"]
    null = F.lit(None).cast("long").alias("rank")
    if not k:
        return scored.select(*out, null)
    last = kth(may.select(*keys), keys, k)
    drawn = (F.col("n_words") >= least_words) & (F.struct(*keys) <= F.struct(*(F.lit(x).cast("long").alias(c) for c, x in zip(keys, last))))
    dealt = keyed.where(drawn).repartitionByRange(*keys).sortWithinPartitions(*keys).select(*out, F.monotonically_increasing_id().alias("place"))
    dealt = materialise(dealt, "drawn")
    # the place of a row has its partition above bit 33, and its number in it below
    sizes = sorted(map(tuple, dealt.groupBy(F.shiftright("place", 33).alias("part")).count().collect()))
    before = np.concatenate([[0], np.cumsum([n for _, n in sizes])])[:-1].tolist()
    offsets = docs.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, before)], "part long, before long")
    place = F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranked = dealt.withColumn("part", F.shiftright("place", 33)).join(F.broadcast(offsets), "part").select(*out, (F.col("before") + place).alias("rank"))
    return keyed.where(~drawn).select(*out, null).unionByName(ranked)

