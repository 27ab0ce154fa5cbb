"""Substring dedup by level-wise doubling.

A passage repeats if a window of `window` words (35) also starts anywhere else. Its first level looks at short
windows (about a quarter of the length), and of these only at anchors: those with the least hash among all short
windows of some full window, so that every full window holds an anchor that depends on its words alone. Anchors that
occur once are dropped. Those that repeat are extended to twice the length, to the right and to the left; what
repeats is extended again, to the full length in the last level, where every full window that still can repeat is
looked at. The levels end early if no candidates survive. All levels judge the input, not what is left.

Each level is a vote of blocks (blocks.py): two small exchanges of hashes of surviving candidates. Windows of the
last level carry 96 bits. Words are runs of characters other than space and 0x09-0x0D, taken unchanged. A null text
has no words. Repeated rows are documents of their own, so their windows repeat; null ids keep their rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docloom.llm.blocks import MESSAGE, Rolling, among, answers, ballots, block_count, bucket_count, in_blocks, mixed, sliding_min, voted, with_answers
from docloom.llm.common import id_text, parts

WINDOW = 35
#: Bits of a place in a block; the hash of an anchor has the rest.
PLACE = np.uint64((1 << 28) - 1)
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
_space = np.zeros(256, bool)
_space[[32, *range(9, 14)]] = True


class Words:
    """The words of a block's texts, end to end: where each begins and ends in the bytes, its hash, its text's end."""

    def __init__(self, texts: list[str | None]):
        raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
        self.data = b" ".join([*raw, b""])
        b = np.frombuffer(self.data, np.uint8)
        gap = _space[b]
        self.begin = np.nonzero(~gap & np.concatenate([[True], gap[:-1]]))[0] if len(b) else np.zeros(0, np.int64)
        self.end = np.nonzero(gap & np.concatenate([[False], ~gap[:-1]]))[0] if len(b) else np.zeros(0, np.int64)
        ends = np.cumsum([len(x) + 1 for x in raw])
        self.upto = np.searchsorted(self.begin, ends)  # words of the texts up to each
        self.counts = np.diff(np.append(0, self.upto))
        self.stop = np.repeat(self.upto, self.counts)  # per word, where its text's words end
        if len(self.begin):
            place = np.arange(len(b), dtype=np.uint64)
            size = self.end - self.begin
            first = np.zeros(len(b), np.uint64)
            first[self.begin] = np.diff(self.begin, prepend=0).astype(np.uint64)
            place -= np.cumsum(first)
            x = mixed((place << np.uint64(8)) | b)
            x[gap] = 0
            self.hash = mixed(np.add.reduceat(x, self.begin) + size.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
        else:
            self.hash = np.zeros(0, np.uint64)


def levels(window: int) -> list[int]:
    """Lengths, doubled up to the window: 9, 18, 35 for 35."""
    out = [window]
    while out[0] > 9:
        out.insert(0, -(-out[0] // 2))
    return out


def _anchors(w: Words, roll: Rolling, window: int, short: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of full windows, place of the anchor of each)."""
    n = len(w.hash)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # hash above, place below: the least is the leftmost place with the least hash
    spot = (roll.windows(short) & ~PLACE) | np.arange(n - short + 1, dtype=np.uint64)
    least = sliding_min(spot, window - short + 1)
    start = np.nonzero(np.arange(n - window + 1) + window <= w.stop[: n - window + 1])[0]
    place = (least[start] & PLACE).astype(np.int64)
    return start, place


def _repeats(keys: np.ndarray, check: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Distinct sorted keys (and checks), and which occur twice or more."""
    if check is None:
        u, n = np.unique(keys, return_counts=True)
        return u, n > 1, None
    order = np.lexsort((check, keys))
    keys, check = keys[order], check[order]
    first = np.ones(len(keys), bool)
    first[1:] = (keys[1:] != keys[:-1]) | (check[1:] != check[:-1])
    (at,) = np.nonzero(first)
    return keys[at], np.diff(np.append(at, len(keys))) > 1, check[at]


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """RESULT: per row of docs, how many of its words repeated windows cover, and what is left of it."""
    own = id_text(docs, id_col, text_col)
    n_blocks, n_parts = block_count(own), parts(docs)
    n_buckets = bucket_count(n_blocks, n_parts)
    blocks = in_blocks(own, n_blocks, n_parts)
    short, *between, full = levels(window) if len(levels(window)) > 1 else [window, window]

    def read(table: pa.Table) -> tuple[Words, Rolling]:
        w = Words(table.column("text").to_pylist())
        return w, Rolling(w.hash)

    def first(table: pa.Table) -> pa.Table:
        w, roll = read(table)
        _, place = _anchors(w, roll, window, short)
        keys, sure, _ = _repeats(roll(np.unique(place), short))
        return ballots(table.column("blk")[0].as_py(), keys, sure, n_buckets)

    def sides(w: Words, roll: Rolling, place: np.ndarray, size: int, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows of `size` at anchors: to the right, and to the left so that they end where the anchor ends. Which exist, and their hashes."""
        n = len(w.hash)
        begin = np.concatenate([[0], w.upto])[np.searchsorted(w.upto, place, side="right")]
        right, left = place + size <= w.stop[np.minimum(place, n - 1)], place + half - size >= begin
        a = np.where(right, place, 0)
        b = np.where(left, place + half - size, 0)
        return right, left, roll(a, np.where(right, size, 0)), roll(b, np.where(left, size, 0))

    def doubled(size: int, half: int):
        def run(table: pa.Table, reply: pa.Table) -> pa.Table:
            if not table.num_rows:
                return ballots(0, np.zeros(0, np.uint64), np.zeros(0, bool), n_buckets)
            w, roll = read(table)
            held, _ = answers(reply)
            place = np.unique(_anchors(w, roll, window, short)[1])
            if half == short:
                place = place[among(roll(place, short), held)]
            else:  # what the level before let through, on either side
                right, left, r, s = sides(w, roll, place, half, short)
                place = place[(right & among(r, held)) | (left & among(s, held))]
            right, left, r, s = sides(w, roll, place, size, short)
            begin = np.concatenate([place[right], place[left] + short - size])
            keys = np.concatenate([r[right], s[left]])
            _, one = np.unique(begin, return_index=True)  # two anchors may extend to one window
            keys, sure, _ = _repeats(keys[one])
            return ballots(table.column("blk")[0].as_py(), keys, sure, n_buckets)

        return run

    def candidates(w: Words, roll: Rolling, held: np.ndarray) -> np.ndarray:
        start, place = _anchors(w, roll, window, short)
        last = between[-1] if between else short
        if last == short:
            return start[among(roll(place, short), held)]
        u, inverse = np.unique(place, return_inverse=True)
        right, left, r, s = sides(w, roll, u, last, short)
        fits = place - start + last <= window
        ok_right, ok_left = (right & among(r, held))[inverse], (left & among(s, held))[inverse]
        fits_left = place + short - last >= start
        return start[np.where(fits, ok_right, True) & np.where(fits_left, ok_left, True)]

    def final_keys(w: Words, roll: Rolling, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        other = Rolling(mixed(w.hash ^ np.uint64(0x5851F42D4C957F2D)))
        return roll(at, window), (other(at, window) >> np.uint64(32)).astype(np.uint32)

    def last_level(table: pa.Table, reply: pa.Table) -> pa.Table:
        if not table.num_rows or not reply.num_rows:
            return ballots(0, np.zeros(0, np.uint64), np.zeros(0, bool), n_buckets)
        w, roll = read(table)
        at = candidates(w, roll, answers(reply)[0])
        keys, sure, check = _repeats(*final_keys(w, roll, at))
        return ballots(table.column("blk")[0].as_py(), keys, sure, n_buckets, check)

    def remove(table: pa.Table, reply: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({c: pa.array([], k) for c, k in (("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string()))})
        w = Words(table.column("text").to_pylist())
        n = len(w.hash)
        gone = np.zeros(n, bool)
        if reply.num_rows:
            roll = Rolling(w.hash)
            held, check = answers(reply)
            start = np.nonzero(np.arange(max(n - window + 1, 0)) + window <= w.stop[: max(n - window + 1, 0)])[0]
            key = roll(start, window)
            maybe = among(key, held)
            start, key = start[maybe], key[maybe]
            _, mine = final_keys(w, roll, start)
            ok = np.zeros(len(key), bool)
            order = np.lexsort((check, held))
            h, c = held[order], check[order]
            left = np.searchsorted(h, key, "left")
            while True:  # keys that share 64 bits stand side by side: nearly always one
                live = (left < len(h)) & ~ok
                live[live] = h[left[live]] == key[live]
                if not live.any():
                    break
                ok[live] = c[left[live]] == mine[live]
                left[live] += 1
            cover = np.zeros(n + 1, np.int64)
            np.add.at(cover, start[ok], 1)
            np.add.at(cover, start[ok] + window, -1)
            gone = np.cumsum(cover)[:n] > 0
        out, lost, texts = [], [], []
        starts = w.upto - w.counts
        for a, z in zip(starts.tolist(), w.upto.tolist(), strict=True):
            keep = np.nonzero(~gone[a:z])[0] + a
            kept = b" ".join([w.data[i:j] for i, j in zip(w.begin[keep].tolist(), w.end[keep].tolist(), strict=True)])
            lost.append(z - a - len(keep))
            out.append(hashlib.sha256(kept).hexdigest())
            texts.append(kept.decode("utf-8", "surrogatepass") if with_text else None)
        return pa.table({"doc_id": table.column("doc_id"), "n_words": pa.array(w.counts, pa.int64()), "n_removed": pa.array(lost, pa.int64()), "kept_sha256": pa.array(out), "kept_text": pa.array(texts, pa.string())})

    held = voted(blocks.groupBy("blk").applyInArrow(first, MESSAGE))
    half = short
    for size in between:
        held = voted(with_answers(blocks, held, doubled(size, half), MESSAGE))
        half = size
    held = voted(with_answers(blocks, held, last_level, MESSAGE))
    got = with_answers(blocks, held, remove, RESULT)
    return got if with_text else got.drop("kept_text")
