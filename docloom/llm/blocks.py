"""Documents in blocks, and votes of blocks on hashed keys: what both substring operators stand on.

A block is a set of documents small enough for one task's memory, chosen by a hash of the row. Blocks send what they
know about keys (each key once a block, however often it occurs there) to buckets by key; a bucket sees all that any
block knows of its keys and answers each block about them. A key that a third of all documents hold costs a bucket
one entry a block. Everything is keyed by content, so a block that is computed again, in another order of rows, agrees
with answers that came before.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import parts

BLOCK_BYTES = 4 << 20
MESSAGE = "bucket int, blk int, payload binary"
NULL_ID = np.int64(2**63 - 1)
#: Fixed odd multiplier of the running-sum hash, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)


def in_blocks(docs: DataFrame, n_blocks: int, n_parts: int) -> DataFrame:
    """docs(doc_id, text) with blk, dealt by it once; every later use of this frame reuses that exchange."""
    return docs.withColumn("blk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int")).repartition(n_parts, "blk")


def block_count(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    """As many blocks as the texts' bytes need, and one for each shuffle partition at least."""
    (total,) = docs.select(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    return max(parts(docs), -(-total // block_bytes))


def pack(**arrays: np.ndarray) -> bytes:
    return zstandard.compress(pickle.dumps(arrays, 5), 1)


def unpack(data: bytes) -> dict[str, np.ndarray]:
    return pickle.loads(zstandard.decompress(data))


def planes(x: np.ndarray) -> np.ndarray:
    """Sorted numbers as byte planes of their differences, which pack well."""
    return np.ascontiguousarray(np.diff(x, prepend=x.dtype.type(0)).view(np.uint8).reshape(-1, x.dtype.itemsize).T)


def unplanes(x: np.ndarray, kind=np.uint64) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(x.T).view(kind).reshape(-1), dtype=kind)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of x, which it overwrites."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % 2**64, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Hashes of any run of units from running sums: equal runs have equal hashes wherever they stand."""

    def __init__(self, units: np.ndarray):
        self.sums = np.zeros(len(units) + 1, np.uint64)
        np.cumsum(units * powers(BASE, len(units)), out=self.sums[1:])
        self.back = powers(INVERSE, len(units) + 1)

    def __call__(self, start: np.ndarray, size) -> np.ndarray:
        return mixed((self.sums[start + size] - self.sums[start]) * self.back[start])

    def windows(self, size: int) -> np.ndarray:
        """Hash of the run of this size at every place."""
        n = len(self.sums) - size
        if n <= 0:
            return np.zeros(0, np.uint64)
        x = self.sums[size:] - self.sums[:n]
        x *= self.back[:n]
        return mixed(x)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of x[i : i + w] for every i."""
    span = 1
    while span * 2 <= w:
        x = np.minimum(x[:-span], x[span:]) if len(x) > span else x[:0]
        span *= 2
    rest = w - span
    return x if not rest else (np.minimum(x[:-rest], x[rest:]) if len(x) > rest else x[:0])


def bucket_of(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    """Keys are often the least of many hashes and crowd near zero, so they are mixed once more before they are dealt."""
    return ((mixed(keys ^ np.uint64(0xA24BAED4963EE407)) >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)


def bucket_count(n_blocks: int, n_parts: int) -> int:
    """Four buckets a partition, so that partitions are even; more only if a bucket would get more than four blocks' keys."""
    return max(min(n_blocks, 4 * n_parts), -(-n_blocks // 4))


def dealt(buckets: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(bucket, places of its entries in their order) for each bucket that has any."""
    order = np.argsort(buckets, kind="stable")
    at = np.nonzero(np.diff(buckets[order], prepend=-1))[0]
    return list(zip(buckets[order[at]].tolist(), np.split(order, at[1:]), strict=True)) if len(at) else []


def messages(blk: int, made: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table({"bucket": pa.array([b for b, _ in made], pa.int32()), "blk": pa.array([blk] * len(made), pa.int32()), "payload": pa.array([x for _, x in made], pa.binary())})


def ballots(blk: int, keys: np.ndarray, sure: np.ndarray, n_buckets: int, check: np.ndarray | None = None, weight: np.ndarray | None = None) -> pa.Table:
    """A block's distinct sorted keys, one message a bucket; sure: the block alone knows that the key repeats; weight: how much the block will send under a key."""
    made = []
    for b, s in dealt(bucket_of(keys, n_buckets)):
        made.append((b, pack(keys=planes(keys[s]), sure=np.packbits(sure[s]), **{k: x[s] for k, x in (("check", check), ("weight", weight)) if x is not None})))
    return messages(blk, made)


#: Weight of a key from which on it is called heavy; about an eighth of what a bucket should get.
HEAVY = 8000


def count_votes(group: pa.Table) -> pa.Table:
    """For one bucket: tells each block which of its keys repeat, in that block or between blocks, and which are heavy. A key with a check repeats only if both agree."""
    blks = group.column("blk").to_pylist()
    got = [unpack(x.as_py()) for x in group.column("payload")]
    keys = [unplanes(x["keys"]) for x in got]
    sizes = np.fromiter(map(len, keys), np.int64, len(keys))
    key = np.concatenate(keys)
    sure = np.concatenate([np.unpackbits(x["sure"], count=n).astype(bool) for x, n in zip(got, sizes, strict=True)])
    check = np.concatenate([x["check"] for x in got]) if "check" in got[0] else None
    order = np.argsort(key, kind="stable") if check is None else np.lexsort((check, key))
    same = key[order[1:]] == key[order[:-1]]
    if check is not None:
        same &= check[order[1:]] == check[order[:-1]]
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    again |= sure
    heavy = None
    if "weight" in got[0]:
        weight = np.concatenate([x["weight"] for x in got]).astype(np.int64)
        first = np.nonzero(np.append(True, ~same))[0]
        heavy = np.empty(len(key), bool)
        heavy[order] = np.repeat(np.add.reduceat(weight[order], first) > HEAVY, np.diff(np.append(first, len(key))))
    made, at = [], 0
    for blk, k, n in zip(blks, keys, sizes.tolist(), strict=True):
        mine = again[at : at + n]
        if mine.any():
            made.append((blk, pack(keys=planes(k[mine]), **{c: x[at : at + n][mine] for c, x in (("check", check), ("heavy", heavy)) if x is not None})))
        at += n
    return pa.table({"blk": pa.array([b for b, _ in made], pa.int32()), "payload": pa.array([x for _, x in made], pa.binary())})


def voted(ballot: DataFrame) -> DataFrame:
    return ballot.groupBy("bucket").applyInArrow(count_votes, "blk int, payload binary")


def answers(group: pa.Table, beside: str = "check") -> tuple[np.ndarray, np.ndarray | None]:
    """The sorted keys that repeat, and their checks (or heavy), of what the buckets answered a block."""
    got = [unpack(x.as_py()) for x in group.column("payload")]
    if not got:
        return np.zeros(0, np.uint64), None
    keys = np.concatenate([unplanes(x["keys"]) for x in got])
    order = np.argsort(keys)
    return keys[order], np.concatenate([x[beside] for x in got])[order] if beside in got[0] else None


def among(x: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    """Which of x are among the sorted keys."""
    if not len(sorted_keys):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_keys, x), len(sorted_keys) - 1)
    return sorted_keys[at] == x


def with_answers(blocks: DataFrame, replies: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """run(documents, replies) for each block."""

    def both(docs: pa.Table, reply: pa.Table) -> pa.Table:
        return run(docs, reply)

    return blocks.groupBy("blk").cogroup(replies.groupBy("blk")).applyInArrow(both, schema)
