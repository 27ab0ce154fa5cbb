"""Byte-level BPE encoding that asks the tokenizers library once per distinct piece.

A byte-level BPE never merges across the pieces its pre-tokenizer makes. Most text repeats its pieces, so a batch
is cut into pieces with numpy, and only pieces not seen before in this process go to the library. Which code points
are letters, numbers, spaces or others is asked of the library's own pre-tokenizer, so both agree on every code point.
Texts that hold an added token's string are encoded whole by the library, and all texts are if the tokenizer file asks
for a normalizer or another pre-tokenizer than the plain byte-level one. Long texts are cut where a single blank stands
between two ASCII letters or digits: a piece begins there in any case.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from docloom.llm.blocks import among

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

LETTER, NUMBER, SPACE, OTHER, UNKNOWN = range(5)
#: Ends of the contractions that the pre-tokenizer keeps whole (fixed values of its pattern).
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Pieces that a process remembers; it starts anew beyond them.
MOST_PIECES = 1_000_000
#: Characters from which on a text is cut.
LONG = 1 << 18
_cut = re.compile(r"[A-Za-z0-9](?= [A-Za-z0-9])")
_open: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The process's encoder for a tokenizer file."""
    if path not in _open:
        _open[path] = PieceEncoder(path)
    return _open[path]


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of x, which it overwrites."""
    x += np.uint64(0x1F83D9ABFB41BD6B)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    return x


def cuts_like_byte_level(path: str) -> bool:
    """Whether the tokenizer file asks for the very cutting that _starts() does."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    pre = data.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
    added = data.get("added_tokens") or []
    return plain and data.get("normalizer") is None and data["model"].get("type") == "BPE" and not any(t.get("lstrip") or t.get("rstrip") or " " in t["content"] for t in added)


def chunks(text: str) -> list[str]:
    """The text in runs of about LONG characters at most where it can be cut; end to end they encode as the whole."""
    out, at = [], 0
    while len(text) - at > LONG and (m := _cut.search(text, at + LONG // 2)):
        out.append(text[at : m.end()])
        at = m.end()
    return [*out, text[at:]]


class PieceEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.added = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.known = cuts_like_byte_level(path)
        self.kind = np.full(0x110000, UNKNOWN, np.uint8)
        self.forget()

    def forget(self) -> None:
        self.key = np.zeros(0, np.uint64)  # hashes of the known pieces, sorted; the next three go with them
        self.check = np.zeros(0, np.uint64)  # a second hash
        self.first = np.zeros(0, np.int32)  # where a piece's ids begin in self.ids
        self.count = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def _learn_kinds(self, cp: np.ndarray) -> None:
        split = self.lib.pre_tokenizer.pre_tokenize_str
        for c in np.unique(cp[self.kind[cp] == UNKNOWN]).tolist():
            x = chr(c)
            if 0xD800 <= c < 0xE000:
                k = OTHER
            elif len(split("a" + x)) == 1:
                k = LETTER
            elif len(split("1" + x)) == 1:
                k = NUMBER
            elif len(split("%" + x)) == 1:
                k = OTHER
            else:
                k = SPACE
            self.kind[c] = k

    def _starts(self, cp: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """True where a piece begins, for texts end to end in cp; begins and ends are those of the texts."""
        k = self.kind[cp]
        n = len(cp)
        start = np.empty(n, bool)
        start[0] = True
        np.not_equal(k[1:], k[:-1], out=start[1:])
        start[begins] = True
        last = np.zeros(n, bool)
        last[ends - 1] = True
        space = k == SPACE
        # the last of some spaces before something else is a piece of its own, or goes with what follows if it is a blank
        tail = np.zeros(n, bool)
        tail[:-1] = space[:-1] & ~space[1:] & ~last[:-1]
        start |= tail
        (blank,) = np.nonzero(tail & (cp == 32))
        start[blank + 1] = False
        (quote,) = np.nonzero(cp == 39)
        if len(quote):
            before = np.where(quote > 0, quote - 1, 0)
            first = np.zeros(n, bool)
            first[begins] = True
            fresh = first[quote] | ((k[before] != OTHER) & (cp[before] != 32))
            at = quote[fresh]
            done = np.zeros(len(at), bool)
            for end in CONTRACTIONS:
                m = len(end)
                ok = ~done & (at + m < n)
                for j, c in enumerate(end, 1):
                    place = np.minimum(at + j, n - 1)
                    ok &= (cp[place] == ord(c)) & ~first[place]
                done |= ok
                hit = at[ok]
                start[hit] = True
                start[hit + 1] = False
                if m == 2:
                    start[hit + 2] = False
                after = hit + m + 1
                after = after[after < n]
                # what follows begins anew, unless it is a blank or spaces that begin by themselves
                start[after] = True
        return start

    def _add(self, texts: list[str], keys: np.ndarray, check: np.ndarray) -> None:
        """Learns the pieces texts, whose sorted hashes are keys."""
        ids = [e.ids for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]
        count = np.fromiter(map(len, ids), np.int32, len(ids))
        at = np.searchsorted(self.key, keys)
        self.first = np.insert(self.first, at, len(self.ids) + np.cumsum(count) - count)
        self.ids = np.concatenate([self.ids, np.fromiter((x for e in ids for x in e), np.uint32, int(count.sum()))])
        self.key, self.check, self.count = np.insert(self.key, at, keys), np.insert(self.check, at, check), np.insert(self.count, at, count)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, how many each has)."""
        if not self.known:
            return self._plain(texts)
        if any(len(t) > LONG for t in texts):
            cut = [chunks(t) for t in texts]
            got = [self._encode_cut(c) for c in cut]
            return np.concatenate([ids for ids, _ in got]), np.array([sizes.sum() for _, sizes in got], np.int64)
        return self._encode_cut(texts)

    def _encode_cut(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        whole = [any(a in t for a in self.added) for t in texts]
        plain = [t for t, w in zip(texts, whole, strict=True) if not w and t]
        ids, sizes = self._encode(plain) if plain else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        if len(plain) == len(texts):
            return ids, sizes
        out, counts, at, place = [], [], 0, 0
        for t, w in zip(texts, whole, strict=True):
            if w:
                got = np.array(self.lib.encode(t, add_special_tokens=False).ids, np.uint32)
            elif t:
                got = ids[at : at + sizes[place]]
                at, place = at + sizes[place], place + 1
            else:
                got = ids[:0]
            out.append(got)
            counts.append(len(got))
        return np.concatenate(out) if out else ids, np.array(counts, np.int64)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "".join(texts)
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        self._learn_kinds(cp)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lengths)
        (at,) = np.nonzero(self._starts(cp, ends - lengths, ends))
        until = np.append(at[1:], len(cp))
        size = until - at
        # hashes of the pieces from running sums: code points, mixed with their place in the piece
        place = np.arange(len(cp), dtype=np.int64)
        place -= np.repeat(at, size)
        x = place.view(np.uint64)
        x <<= np.uint64(21)
        x |= cp
        check = np.add.reduceat(x * np.uint64(0x9FB21C651E98DF25), at)
        key = np.add.reduceat(_mixed(x), at)
        if len(self.key) > MOST_PIECES:
            self.forget()
        uniq, one, inverse = np.unique(key, return_index=True, return_inverse=True)
        if (check != check[one][inverse]).any():  # two pieces with one hash: the library encodes all
            return self._plain(texts)
        new = ~among(uniq, self.key)
        if new.any():
            pick = one[new]
            self._add([joined[a:b] for a, b in zip(at[pick].tolist(), until[pick].tolist(), strict=True)], uniq[new], check[pick])
        there = np.searchsorted(self.key, uniq)
        if (self.check[there] != check[one]).any():
            return self._plain(texts)
        first, count = self.first[there][inverse].astype(np.int64), self.count[there][inverse].astype(np.int64)
        total = np.cumsum(count)
        step = np.repeat(first - (total - count), count)
        ids = self.ids[step + np.arange(total[-1])]
        upto = total[np.searchsorted(at, ends) - 1]
        return ids, np.diff(np.append(0, upto))

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter((x for e in got for x in e), np.uint32, int(sizes.sum())), sizes
