"""Suffix-array dedup by merging Burrows-Wheeler transforms.

Every byte that a `window`-byte string (50) covers goes, if that string also starts in a document with a smaller id.

No machine can hold the transform of a whole corpus, so its suffixes are dealt out: each window goes by its anchor,
the leftmost place with the least hash among its 16-byte grams, which depends on the window's bytes alone, so equal
windows meet in one bucket, their anchors at the same offset. First the blocks vote on these grams (blocks.py);
windows whose gram occurs in one document alone cannot repeat elsewhere and stop there. What is left travels as
segments: all windows of one anchor as one run of bytes, each distinct segment once a block, with the least id.

A block's segments for a bucket are its shard of the transform, bounded to `window` bytes: its rows are the anchors in
the order of what follows them, and its columns are the bytes that precede them, one step back after the other. A
bucket merges the shards of all blocks. The interleave of rows at the anchors is refined by stable counting sorts on the
bytes that follow; the common prefixes of neighbouring rows come from that order. From there the interleave moves
back by one preceding byte a step, as a Burrows-Wheeler transform is walked: a stable counting sort on that column
alone orders all suffixes that begin one byte earlier, so no suffix is sorted anew. At each step neighbouring rows with
equal bytes back to the anchor and a common prefix that reaches the window's end are one repeated interval, whose least
document id decides.

A gram with very many distinct segments (the vote tells) is heavy: its windows travel one by one, as 96 bits of hash
dealt by that hash, so that no bucket grows with a common phrase. Segments are told apart by 96 bits as well.

A null text is empty. A null id is no smaller than any id, and so removes nothing. Rows with equal ids never remove
each other's bytes. Repeated rows with other ids are documents like all others.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docloom.llm.blocks import MESSAGE, NULL_ID, Rolling, among, answers, ballots, block_count, bucket_count, bucket_of, dealt, in_blocks, messages, mixed, pack, sliding_min, unpack, voted, with_answers
from docloom.llm.common import id_text, parts

WINDOW, GRAM = 50, 16
#: Rows that are merged at once, at least one gram's.
ROWS = 20_000
#: Bits of a place in a block; the hash of an anchor has the rest.
PLACE = np.uint64((1 << 31) - 1)
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def runs_of(sizes: np.ndarray) -> np.ndarray:
    """0..n-1 for each n of sizes, end to end."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def changes(*columns: np.ndarray) -> np.ndarray:
    """True at the first row and wherever one of the columns differs from the row before."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = columns[0][1:] != columns[0][:-1]
    for c in columns[1:]:
        out[1:] |= c[1:] != c[:-1]
    return out


def anchor_order(after: np.ndarray, gram_size: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows in the order of their bytes from the anchor on, and the bytes that each has in common with the row
    before, -1 with another gram's. The interleave starts as the rows stand and is refined from the right, two bytes a
    round."""
    order = np.arange(len(after))
    width = after.shape[1]
    for at in range(width - 2, -1, -2):
        order = order[np.argsort(after[order, at].astype(np.uint16) << np.uint16(8) | after[order, at + 1], kind="stable")]
    if width % 2:
        order = order[np.argsort(after[order, 0], kind="stable")]
    common = np.full(len(order), -1, np.int64)
    if len(order) > 1:
        other = after[order[1:]] != after[order[:-1]]
        same = np.where(other.any(1), other.argmax(1), width)
        common[1:] = np.where(same < gram_size, -1, same)
    return order, common


def following(text: np.ndarray, begin: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """The width bytes from begin on, of which size are the row's own and the others 0."""
    at = begin[:, None] + np.arange(width)
    inside = np.arange(width) < size[:, None]
    return np.where(inside, text[np.minimum(at, len(text) - 1)], np.uint8(0))


def gram_hash(text: np.ndarray, anchor: np.ndarray, gram_size: int) -> np.ndarray:
    out = np.zeros(len(anchor), np.uint64)
    for i in range(gram_size):
        out = (out ^ text[anchor + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def merge_shards(text: np.ndarray, begin: np.ndarray, left: np.ndarray, size: np.ndarray, low: np.ndarray, window: int, gram_size: int) -> np.ndarray:
    """Per window of each segment, in order, the least of `low` among the segments that hold it at the same anchor.

    begin, size: the segments' places in text; left: bytes before the anchor. Window o of a segment begins o bytes
    before the anchor."""
    anchor, right = begin + left, size - left
    order, common = anchor_order(following(text, anchor, right, window), gram_size)
    rank = np.empty(len(order), np.int64)  # of a row in the order at the anchors
    rank[order] = np.arange(len(order))
    upto = np.cumsum(size - window + 1)
    first_of = upto - (size - window + 1)
    least = np.empty(int(upto[-1]), np.int64)
    alike = np.zeros(len(order), np.int64)  # rows with equal bytes from the step's place to the anchor
    for o in range(window - gram_size + 1):
        (here,) = np.nonzero(right[order] >= window - o)  # rows with a window at this step
        if len(here):
            rows = order[here]
            # rows with a common prefix up to the window's end have one number
            until = np.cumsum(common < window - o)[rank[rows]]
            (at,) = np.nonzero(changes(alike[here], until))
            least[first_of[rows] + left[rows] - o] = np.repeat(np.minimum.reduceat(low[rows], at), np.diff(np.append(at, len(rows))))
        on = left[order] > o
        order, alike = order[on], alike[on]
        if not len(order):
            break
        before = text[anchor[order] - (o + 1)]
        step = np.argsort(before, kind="stable")
        order = order[step]
        alike = np.cumsum(changes(before[step], alike[step]))
    return least


class Bytes:
    """A block's texts as bytes end to end, and the segments of its full windows."""

    def __init__(self, table: pa.Table, window: int, gram: int):
        self.raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in table.column("text").to_pylist()]
        self.joined = b"".join(self.raw)
        self.data = np.frombuffer(self.joined, np.uint8)
        sizes = np.fromiter(map(len, self.raw), np.int64, len(self.raw))
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        self.ids = np.array([NULL_ID if x is None else x for x in table.column("doc_id").to_pylist()], np.int64)
        self.window = window
        n = len(self.data)
        if n < window:
            self.start = self.size = self.left = self.doc = np.zeros(0, np.int64)
            self.gram = np.zeros(0, np.uint64)
            return
        self.roll = Rolling(mixed(self.data.astype(np.uint64) + np.uint64(0x2545F4914F6CDD1D)))
        grams = self.roll.windows(gram)
        # hash above, place below: the least is the leftmost place with the least hash
        anchor = (sliding_min((grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64), window - gram + 1) & PLACE).astype(np.int64)
        fits = np.zeros(n - window + 1, bool)
        for a, z in zip(self.begins.tolist(), self.ends.tolist(), strict=True):
            fits[a : max(z - window + 1, a)] = True
        new = changes(anchor)
        new[1:] |= ~fits[:-1]
        new[self.begins[self.begins < len(new)]] = True
        border = np.nonzero(new | ~fits)[0]
        until = np.append(border[1:], len(anchor))
        own = fits[border]
        self.start = border[own]
        self.size = until[own] - self.start + window - 1
        self.left = anchor[self.start] - self.start
        self.gram = grams[anchor[self.start]]
        self.doc = np.searchsorted(self.ends, self.start, side="right")

    def keep(self, which: np.ndarray) -> None:
        self.start, self.size, self.left, self.gram, self.doc = (x[which] for x in (self.start, self.size, self.left, self.gram, self.doc))

    def content(self) -> np.ndarray:
        """Hash of each segment: its bytes, their number and the anchor's place."""
        return mixed(self.roll(self.start, self.size) ^ ((self.size * 64 + self.left).astype(np.uint64) << np.uint64(40)))

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, begin, document) of each window of these segments."""
        n = self.size[which] - self.window + 1
        begin = np.repeat(self.start[which], n) + runs_of(n)
        return self.roll(begin, np.full(len(begin), self.window)), begin, np.repeat(self.doc[which], n)


def checks(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """32 more bits of each run of bytes."""
    view = memoryview(data)
    return np.fromiter((zlib.crc32(view[a : a + n]) for a, n in zip(start.tolist(), size.tolist(), strict=True)), np.uint32, len(start))


def distinct(key: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One place of each key, sorted by it; the key's least id; whether it has several ids."""
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    order = np.lexsort((ids, key))
    (at,) = np.nonzero(changes(key[order]))
    low, high = ids[order[at]], ids[order[np.append(at[1:], len(order)) - 1]]
    return order[at], low, low != high


def matches(key: np.ndarray, sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in key, place in sorted_keys) of every pair of equal keys."""
    left, right = np.searchsorted(sorted_keys, key, "left"), np.searchsorted(sorted_keys, key, "right")
    return np.repeat(np.arange(len(key)), right - left), runs_of(right - left) + np.repeat(left, right - left)


def merge_bucket(group: pa.Table, window: int, gram_size: int) -> pa.Table:
    """Tells each block of a bucket which windows of its segments, and which heavy windows, begin in a smaller id's document."""
    blks = group.column("blk").to_pylist()
    got = [unpack(x.as_py()) for x in group.column("payload")]
    told: list[dict] = [{} for _ in got]
    cat = lambda c: np.concatenate([x[c] for x in got])
    content, least, size, left, text = cat("content"), cat("least"), cat("size").astype(np.int64), cat("left").astype(np.int64), cat("text")
    if len(content):
        begin = np.cumsum(size) - size
        gram, check = gram_hash(text, begin + left, gram_size), checks(text, begin, size)
        # distinct segments, those of one gram together, each with the least id of all blocks
        order = np.lexsort((least, check, content, gram))
        first = changes(gram[order], content[order], check[order])
        seg = np.empty(len(order), np.int64)
        seg[order] = np.cumsum(first) - 1
        lead, low = order[first], least[order[first]]
        n_windows = size[lead] - window + 1
        upto = np.cumsum(n_windows)
        minimum = np.empty(int(upto[-1]), np.int64)
        grams = np.append(np.nonzero(changes(gram[lead]))[0], len(lead))
        a = 0
        while a < len(lead):
            z = int(grams[min(np.searchsorted(grams, a + ROWS), len(grams) - 1)])
            p = lead[a:z]
            minimum[upto[a] - n_windows[a] : upto[z - 1]] = merge_shards(text, begin[p], left[p], size[p], low[a:z], window, gram_size)
            a = z
        # runs of windows with one least id, per distinct segment
        which = np.repeat(np.arange(len(lead)), n_windows)
        (run,) = np.nonzero(changes(minimum, which))
        run_len, run_min, run_seg = np.diff(np.append(run, len(minimum))), minimum[run], which[run]
        run_off = run - (upto - n_windows)[run_seg]
        seg_runs = np.searchsorted(run_seg, np.arange(len(lead) + 1))
        at = 0
        for x, tell in zip(got, told, strict=True):
            s, bits = seg[at : at + len(x["size"])], check[at : at + len(x["size"])]
            at += len(s)
            count = seg_runs[s + 1] - seg_runs[s]
            pick, of = runs_of(count) + np.repeat(seg_runs[s], count), np.repeat(np.arange(len(s)), count)
            news = (run_min[pick] < x["least"][of]) | np.unpackbits(x["several"], count=len(s)).astype(bool)[of]
            if news.any():
                p, of = pick[news], of[news]
                tell |= {"content": x["content"][of], "check": bits[of], "off": run_off[p].astype(np.uint16), "n": run_len[p].astype(np.uint16), "least": run_min[p]}
    key = cat("w_key")
    if len(key):
        check, least = cat("w_check"), cat("w_least")
        order = np.lexsort((check, key))
        (at,) = np.nonzero(changes(key[order], check[order]))
        low = np.empty(len(key), np.int64)
        low[order] = np.repeat(np.minimum.reduceat(least[order], at), np.diff(np.append(at, len(order))))
        at = 0
        for x, tell in zip(got, told, strict=True):
            mine = low[at : at + len(x["w_key"])]
            at += len(mine)
            news = (mine < x["w_least"]) | x["w_several"]
            if news.any():
                tell |= {"w_key": x["w_key"][news], "w_check": x["w_check"][news], "w_least": mine[news], "w_gram": np.unique(x["w_gram"][news])}
    made = [(b, pack(**tell)) for b, tell in zip(blks, told, strict=True) if tell]
    return pa.table({"blk": pa.array([b for b, _ in made], pa.int32()), "payload": pa.array([x for _, x in made], pa.binary())})


def remove_later_copies(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = True) -> DataFrame:
    """RESULT: per row of docs, the bytes that go, the maximal runs of them, and what is left."""
    gram = min(gram, window)
    own = id_text(docs, id_col, text_col)
    n_blocks, n_parts = block_count(own), parts(docs)
    n_buckets = bucket_count(n_blocks, n_parts)
    blocks = in_blocks(own, n_blocks, n_parts)

    def vote(table: pa.Table) -> pa.Table:
        b = Bytes(table, window, gram)
        blk = table.column("blk")[0].as_py()
        if not len(b.gram):
            return messages(blk, [])
        ids, content = b.ids[b.doc], b.content()
        order = np.lexsort((content, b.gram))
        g = b.gram[order]
        (at,) = np.nonzero(changes(g))
        several = np.minimum.reduceat(ids[order], at) != np.maximum.reduceat(ids[order], at)
        return ballots(blk, g[at], several, n_buckets, weight=np.add.reduceat(changes(g, content[order]), at, dtype=np.uint32))

    def send(table: pa.Table, reply: pa.Table) -> pa.Table:
        if not table.num_rows or not reply.num_rows:
            return messages(0, [])
        b = Bytes(table, window, gram)
        held, heavy = answers(reply, "heavy")
        b.keep(among(b.gram, held))
        rest = among(b.gram, held[heavy])
        # the shards: distinct segments, a bucket's in the order of their anchors
        (light,) = np.nonzero(~rest)
        content = b.content()
        one, least, several = distinct(content[light], b.ids[b.doc[light]])
        one = light[one]
        order, _ = anchor_order(following(b.data, b.start[one] + b.left[one], b.size[one] - b.left[one], window), gram)
        one, least, several = one[order], least[order], several[order]
        # windows of heavy grams, one by one
        key, begin, doc = b.windows(np.nonzero(rest)[0])
        w, w_least, w_several = distinct(key, b.ids[doc])
        w_gram = np.repeat(b.gram[rest], b.size[rest] - window + 1)[w]
        w_key, w_check = key[w], checks(b.data, begin[w], np.full(len(w), window))
        sides = [dict(dealt(bucket_of(x, n_buckets))) for x in (b.gram[one], w_key)]
        none, view, made = np.zeros(0, np.int64), memoryview(b.joined), []
        for k in sorted(sides[0].keys() | sides[1].keys()):
            s, h = (side.get(k, none) for side in sides)
            o = one[s]
            text = b"".join([view[i : i + n] for i, n in zip(b.start[o].tolist(), b.size[o].tolist(), strict=True)])
            shard = {"left": b.left[o].astype(np.uint16), "size": b.size[o].astype(np.uint16), "content": content[o], "least": least[s], "several": np.packbits(several[s]), "text": np.frombuffer(text, np.uint8)}
            made.append((k, pack(**shard, w_key=w_key[h], w_check=w_check[h], w_least=w_least[h], w_several=w_several[h], w_gram=w_gram[h])))
        return messages(table.column("blk")[0].as_py(), made)

    def remove(table: pa.Table, reply: pa.Table) -> pa.Table:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        if not table.num_rows:
            return pa.table([pa.array([], k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())], names)
        if reply.num_rows:
            b = Bytes(table, window, gram)
            gone = covered(b, [unpack(x.as_py()) for x in reply.column("payload")])
        else:
            b = Bytes(table, 1 << 62, gram)
            gone = np.zeros(len(b.data), bool)
        lost, spans, digest, left_over = [], [], [], []
        for a, z in zip(b.begins.tolist(), b.ends.tolist(), strict=True):
            g = gone[a:z]
            n_gone = int(np.count_nonzero(g))
            lost.append(n_gone)
            spans.append(int(np.count_nonzero(g[1:] & ~g[:-1])) + int(g[0]) if n_gone else 0)
            kept = b.data[a:z][~g].tobytes() if n_gone else b.joined[a:z]
            digest.append(hashlib.sha256(kept).hexdigest())
            left_over.append(kept if with_bytes else None)
        return pa.table([table.column("doc_id"), pa.array(b.ends - b.begins), pa.array(lost, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest), pa.array(left_over, pa.binary())], names)

    def covered(b: Bytes, got: list[dict]) -> np.ndarray:
        """Which bytes of the block go, by what its buckets tell."""
        cover = np.zeros(len(b.data) + 1, np.int64)

        def add(key: np.ndarray, begin: np.ndarray, size: np.ndarray, doc: np.ndarray, news: dict[str, np.ndarray]) -> None:
            """key, begin, size, doc: the block's runs of bytes; news: of some keys, a run of windows inside and the least id."""
            order = np.argsort(news["key"], kind="stable")
            news = {c: x[order] for c, x in news.items()}
            # a key's other 32 bits, of one place each
            told = np.unique(news["key"])
            there, one = np.unique(key, return_index=True)
            one = one[among(there, told)]
            true = dict(zip(key[one].tolist(), checks(b.data, begin[one], size[one]).tolist(), strict=True))
            same = np.fromiter((true.get(k) == c for k, c in zip(news["key"].tolist(), news["check"].tolist(), strict=True)), bool, len(order))
            news = {c: x[same] for c, x in news.items()}
            of, pick = matches(key, news["key"])
            goes = news["least"][pick] < b.ids[doc[of]]
            first, n = begin[of[goes]] + news["off"][pick[goes]], news["n"][pick[goes]]
            np.add.at(cover, first, 1)
            np.add.at(cover, first + n + window - 1, -1)

        parts_of = [x for x in got if "content" in x]
        if parts_of:
            cat = lambda c: np.concatenate([x[c] for x in parts_of])
            add(b.content(), b.start, b.size, b.doc, {"key": cat("content"), "check": cat("check"), "off": cat("off").astype(np.int64), "n": cat("n").astype(np.int64), "least": cat("least")})
        parts_of = [x for x in got if "w_key" in x]
        if parts_of:
            cat = lambda c: np.concatenate([x[c] for x in parts_of])
            key, begin, doc = b.windows(np.nonzero(among(b.gram, np.unique(cat("w_gram"))))[0])
            none = np.zeros(len(cat("w_key")), np.int64)
            add(key, begin, np.full(len(key), window), doc, {"key": cat("w_key"), "check": cat("w_check"), "off": none, "n": none + 1, "least": cat("w_least")})
        return np.cumsum(cover[:-1]) > 0

    def merge(group: pa.Table) -> pa.Table:
        return merge_bucket(group, window, gram)

    held = voted(blocks.groupBy("blk").applyInArrow(vote, MESSAGE))
    sent = with_answers(blocks, held, send, MESSAGE)
    merged = sent.groupBy("bucket").applyInArrow(merge, "blk int, payload binary")
    got = with_answers(blocks, merged, remove, RESULT)
    return got if with_bytes else got.drop("kept")
