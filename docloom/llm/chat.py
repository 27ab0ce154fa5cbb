"""Chat formatting with offset-aligned loss masks.

A whole conversation is rendered, encoded once with offsets, and the spans of its assistant texts, sorted as they
are rendered, are intersected with the token spans by binary search. Turns are marked by added tokens, which the
tokenizer cuts out before it looks for pieces, so no token crosses a turn's border.

Template, per turn: <|im_start|>role<|im_sep|>text<|im_end|>. A control string inside a role or text is escaped by
a backslash after its '<' (and one more where there are some already), which is reversible.

Turns go by turn number; ties go by role, then text; null turns come first, a null role or text is empty. Repeated
rows are repeated turns. A null conv_id is a conversation of its own. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core, and threads of the library keep memory of their own
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
FORMATTED = "conv_id long, input_ids array<int>, loss_first array<int>, loss_last array<int>, formatted_chars long"
_open: dict[str, object] = {}


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def chat_tokenizer(path: str):
    """The tokenizer with the three marks as added tokens (nothing is trained)."""
    if path not in _open:
        from tokenizers import AddedToken, Tokenizer

        t = Tokenizer.from_file(path)
        t.add_special_tokens([AddedToken(x, normalized=False, special=True) for x in (START, SEP, END)])
        _open[path] = t
    return _open[path]


def render(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray]:
    """The formatted conversation, and (begin, end) of each assistant text in it, sorted."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEP}", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), np.array(spans, np.int64).reshape(-1, 2)


def align(spans: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token ranges [first, last) that the spans cover; offsets: (begin, end) of the tokens, both ascending."""
    first = np.searchsorted(offsets[:, 1], spans[:, 0], side="right")
    last = np.searchsorted(offsets[:, 0], spans[:, 1], side="left")
    return first, np.maximum(first, last)


def _byte_values() -> dict[str, int]:
    """Byte-level BPE's printable stand-ins: bytes that print stand for themselves, the others take 256, 257, ..."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Reader:
    """Token ids back to text, byte for byte."""

    def __init__(self, path: str):
        # from the vocabulary file alone: the library itself is not needed to read
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        values = _byte_values()
        added = {x["id"]: x["content"] for x in data.get("added_tokens", [])}
        self.bytes = {i: bytes(values[c] for c in x) for x, i in data["model"]["vocab"].items() if i not in added}
        first = max(*self.bytes, *added) + 1  # the marks follow all ids, as the library adds them
        self.marks = {x: first + i for i, x in enumerate((START, SEP, END))}
        self.bytes |= {i: x.encode() for i, x in added.items()} | {i: x.encode() for x, i in self.marks.items()}

    def text(self, ids) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "surrogatepass")

    def turns(self, ids: list[int]) -> list[tuple[str, str]]:
        out, at = [], 0
        while at < len(ids):
            sep, end = ids.index(self.marks[SEP], at), ids.index(self.marks[END], at)
            out.append((unescape(self.text(ids[at + 1 : sep])), unescape(self.text(ids[sep + 1 : end]))))
            at = end + 1
        return out


def format_chats(rows: DataFrame, tokenizer: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """FORMATTED: a row per conversation; loss_first and loss_last are the token ranges under the loss mask, one per assistant text."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias
    turn = F.struct(F.col(turn_col).cast("long").alias("turn"), empty(role_col)("role"), empty(text_col)("text"))
    convs = rows.select(F.col(conv_col).cast("long").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = chat_tokenizer(tokenizer)
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                b = batch.slice(lo, 64)
                made = [render([(x["role"], x["text"]) for x in turns]) for turns in b.column("turns").to_pylist()]
                ids, firsts, lasts = [], [], []
                for (_, spans), e in zip(made, t.encode_batch([text for text, _ in made], add_special_tokens=False), strict=True):
                    first, last = align(spans, np.array(e.offsets, np.int64).reshape(-1, 2))
                    ids.append(e.ids)
                    firsts.append(first)
                    lasts.append(last)
                ints = lambda x: pa.array(x, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column("conv_id"), ints(ids), ints([x.astype(np.int32) for x in firsts]), ints([x.astype(np.int32) for x in lasts]), pa.array([len(text) for text, _ in made], pa.int64())], ["conv_id", "input_ids", "loss_first", "loss_last", "formatted_chars"])

    return convs.mapInArrow(run, FORMATTED)


def read_back(formatted: DataFrame, tokenizer: str) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), all from the token ids and masks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(tokenizer)
        for batch in batches:
            out = []
            for conv, ids, firsts, lasts in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "input_ids", "loss_first", "loss_last")), strict=True):
                turns = reader.turns(ids)
                loss = "".join(unescape(reader.text(ids[a:b])) for a, b in zip(firsts, lasts, strict=True))
                digest = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in ("".join(f"{r}\n{t}\n" for r, t in turns), loss)]
                out.append((conv, len(turns), digest[0], len(loss), digest[1], len(reader.text(ids))))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            cols = [pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(cols, ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "input_ids", "loss_first", "loss_last").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
