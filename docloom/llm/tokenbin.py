"""Token-id files with directly addressable codes.

An id is cut into chunks of 8 bits, lowest first. Level 0 holds the lowest chunk of every id; a bitmap beside it
says which ids go on; level 1 holds the next chunk of those alone, and so on. Rank directories (ones before each
512-bit block, and before each word in its block) turn "the i-th id goes on" into its place in the next level, so any
token is read by at most one lookup and one rank a level, without decoding a block.

A file covers a run of documents in ascending order of doc_id, null ids first (texts of one id by their hash): header, document directory
(ids, null flags and running token counts), then the levels. Files travel as binary values of a table in the shared
folder, with their place in the order beside them, so that Spark's commit protocol covers them and any store serves.
A null or empty text has no ids but the end id. An empty table gives an empty file table. A file is closed at the first
document past `file_tokens`, so only a document of more tokens makes a file of more than twice that.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import id_text, materialise, parts, slices
from docloom.llm.pieces import encoder

MAGIC = b"DLTK0001"
#: Ids a block of the rank directory, and bitmap words in it.
BLOCK = 512
WORDS = BLOCK // 64
#: Tokens from which on a file is closed; and tokens that are read at once.
FILE_TOKENS = 1 << 20
READ_TOKENS = 1 << 18
FILES = "part int, seq int, n_docs long, n_tokens long, file binary"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def dac_write(ids: np.ndarray) -> bytes:
    """The levels of ids, each: count, chunks, bitmap words, ones before each block, ones before each word in its block."""
    out, rest = [], ids.astype(np.uint32)
    levels = 0
    while True:
        n = len(rest)
        out += [struct.pack("<Q", n), rest.astype(np.uint8).tobytes()]  # the lowest chunk
        rest >>= np.uint32(8)
        goes_on = rest > 0
        bits = np.packbits(np.append(goes_on, np.zeros(-n % BLOCK, bool)), bitorder="little")
        ones = np.bitwise_count(bits.view("<u8")).astype(np.uint16).reshape(-1, WORDS)
        inside = np.cumsum(ones, axis=1, dtype=np.uint16)
        total = np.cumsum(inside[:, -1], dtype=np.uint64)
        out += [bits.tobytes(), (total - inside[:, -1]).astype("<u8").tobytes(), (inside - ones).astype("<u2").tobytes()]
        levels += 1
        rest = rest[goes_on]
        if not len(rest):
            return struct.pack("<I", levels) + b"".join(out)


class Dac:
    """Random access into what dac_write() made."""

    def __init__(self, data: memoryview):
        (n_levels,) = struct.unpack_from("<I", data)
        at, self.levels = 4, []
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<Q", data, at)
            blocks = -(-n // BLOCK)
            at += 8
            level = []
            for kind, count in ((np.uint8, n), ("<u8", blocks * WORDS), ("<u8", blocks), ("<u2", blocks * WORDS)):
                level.append(np.frombuffer(data, kind, count, at))
                at += level[-1].nbytes
            self.levels.append(level)

    def access(self, at: np.ndarray) -> np.ndarray:
        """The ids at these places, in any order: a chunk and a rank a level."""
        at = np.asarray(at, np.int64)
        out = np.zeros(len(at), np.uint32)
        live: np.ndarray | slice = slice(None)
        for depth, (chunks, words, before_block, before_word) in enumerate(self.levels):
            out[live] |= chunks[at].astype(np.uint32) << np.uint32(8 * depth)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            bits = words[word]
            (goes_on,) = np.nonzero((bits >> bit) & np.uint64(1))
            if not len(goes_on):
                break
            live = goes_on if depth == 0 else live[goes_on]
            word, lower = word[goes_on], bits[goes_on] & ((np.uint64(1) << bit[goes_on]) - np.uint64(1))
            at = before_block[word // WORDS].astype(np.int64) + before_word[word] + np.bitwise_count(lower)
        return out


def file_write(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> bytes:
    known = np.array([x is not None for x in doc_ids], np.uint8)
    numbers = np.array([x or 0 for x in doc_ids], "<i8")
    upto = np.cumsum(sizes).astype("<u8")
    return MAGIC + struct.pack("<Q", len(doc_ids)) + numbers.tobytes() + known.tobytes() + upto.tobytes() + dac_write(ids)


class TokenFile:
    """A file read back: its documents, and access to their tokens."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        (n,) = struct.unpack_from("<Q", data, 8)
        numbers, known = np.frombuffer(data, "<i8", n, 16), np.frombuffer(data, np.uint8, n, 16 + 8 * n)
        self.doc_ids = [int(x) if k else None for x, k in zip(numbers, known, strict=True)]
        upto = np.frombuffer(data, "<u8", n, 16 + 9 * n).astype(np.int64)
        self.starts = np.concatenate([[0], upto])
        self.dac = Dac(memoryview(data)[16 + 17 * n :])

    def checksums(self) -> list[int]:
        """crc32 of each document's ids as little-endian 32-bit integers, all read by direct access, READ_TOKENS at a time."""
        out = [0] * len(self.doc_ids)
        for lo in range(0, int(self.starts[-1]), READ_TOKENS):
            hi = min(lo + READ_TOKENS, int(self.starts[-1]))
            ids = memoryview(self.dac.access(np.arange(lo, hi)).astype("<u4").tobytes())
            first, last = np.searchsorted(self.starts, lo, "right") - 1, np.searchsorted(self.starts, hi, "left")
            cuts = np.clip(self.starts[first : last + 1], lo, hi) - lo
            for i, (a, b) in enumerate(zip((4 * cuts[:-1]).tolist(), (4 * cuts[1:]).tolist(), strict=True), int(first)):
                out[i] = zlib.crc32(ids[a:b], out[i])
        return out

    def tokens(self, i: int, begin: int = 0, end: int | None = None) -> np.ndarray:
        """Ids begin..end of the i-th document, by direct access."""
        a, b = int(self.starts[i]), int(self.starts[i + 1])
        return self.dac.access(np.arange(a + begin, b if end is None else min(b, a + end)))


def write_files(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Encodes every whole text, appends end_id, and writes the file table: (part, seq) orders the files. Returns it as read back."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        enc = encoder(path)
        held_ids: list[int | None] = []
        sizes, ids, held = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, held_ids, sizes, ids, held
            n = np.concatenate(sizes)
            data = file_write(held_ids, n, np.concatenate(ids))
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(n)], pa.int64()), pa.array([int(n.sum())], pa.int64()), pa.array([data], pa.binary())], ["part", "seq", "n_docs", "n_tokens", "file"])
            seq, held_ids, sizes, ids, held = seq + 1, [], [], [], 0
            return row

        for batch in batches:
            for b in slices(batch, "text", 1 << 20):
                got, n = enc.encode([t or "" for t in b.column("text").to_pylist()])
                with_end = np.insert(got, np.cumsum(n), end_id)
                held_ids += b.column("doc_id").to_pylist()
                sizes.append(n + 1)
                ids.append(with_end)
                held += len(with_end)
                if held >= file_tokens:
                    yield flush()
        if held:
            yield flush()

    # ranges are cut by a hash of the text where ids are equal: their bounds go to the driver, texts must not
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    dealt = id_text(docs, id_col, text_col).repartitionByRange(parts(docs), *order).sortWithinPartitions(*order, F.col("text").asc_nulls_first())
    return materialise(dealt.mapInArrow(run, FILES), "tokens")


def read_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) for each document, from the files alone; start counts the ids of all documents before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, data in zip(batch.column("part").to_pylist(), batch.column("seq").to_pylist(), batch.column("file"), strict=True):
                f = TokenFile(data.as_py())
                n = len(f.doc_ids)
                crc = f.checksums()
                cols = [pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array(f.doc_ids, pa.int64()), pa.array(f.starts[:-1]), pa.array(np.diff(f.starts)), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["part", "seq", "doc_id", "in_file", "n_tokens", "ids_crc32"])

    docs = files.select("part", "seq", "file").mapInArrow(run, "part int, seq int, doc_id long, in_file long, n_tokens long, ids_crc32 long")
    # running totals over the files: one small row a file, without the files themselves
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    starts = files.select("part", "seq", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("file_start")).join(sums, "part")
    return docs.join(starts, ["part", "seq"]).select("doc_id", (F.col("part_start") + F.col("file_start") + F.col("in_file")).alias("start"), "n_tokens", "ids_crc32")
