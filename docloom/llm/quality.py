"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps the measurements and one failure bit per rule.
Policies are versioned sets of rules: applying one is a bitwise AND, and the effect of leaving a rule out
(ablation) is a bitwise aggregation over the ledger. Neither reads a text again.

Words are runs of characters other than space and 0x09-0x0D. A null text has none of anything.
Rows are judged one by one: repeated ids or texts give repeated rows, and a null id stays null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import SPACES, id_text, slices

SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_bang", "n_distinct_words", "n_long_words", "n_control")

#: Rule name -> failure as SQL over the measurements; the position is the bit. Append only: bits are stored.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > 1 * n_words",
    "shouting": "n_upper > n_lower and n_upper >= 100",
    "bangs": "10 * n_bang > 2 * n_words",
    "duplicate_lines": "10 * n_dup_lines > 3 * n_lines and n_dup_lines >= 2",
    "word_length": "word_chars < 2 * n_words or word_chars > 15 * n_words",
    "long_words": "10 * n_long_words > 1 * n_words",
    "few_distinct_words": "n_words >= 50 and n_words < 2000 and 100 * n_distinct_words < 15 * n_words",
    "control_characters": "100 * n_control > word_chars",
    "few_distinct_words_2": "n_words >= 50 and 100 * n_distinct_words < 15 * least(n_words, 2000)",
}
BASE = ("few_words", "repeated_windows")
#: Policy version -> rules that reject a document. Never changed once published; a new version is added instead.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": (*BASE, "symbols", "shouting", "bangs", "duplicate_lines", "word_length", "long_words", "few_distinct_words", "control_characters"),
    # more words never save a text with few distinct ones
    "v2": (*BASE, "symbols", "shouting", "bangs", "duplicate_lines", "word_length", "long_words", "few_distinct_words_2", "control_characters"),
}
PRODUCTION = "v2"


def mask(policy: str) -> int:
    """The bits of a policy's rules."""
    names = list(RULES)
    return sum(1 << names.index(x) for x in POLICIES[policy])


def repeat_words(ids: np.ndarray) -> int:
    """Words in 3-word windows found twice or more, first ones included; ids: one integer per word."""
    n = len(ids)
    if n < 4:
        return 0
    k = int(ids.max()) + 1
    pair = ids[:-1] * k + ids[1:]
    if k >= 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair[:-1] * k + ids[2:]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    hit = np.zeros(n + 1, np.int64)
    at = np.zeros(n - 2, bool)
    at[order[1:][same]] = True
    at[order[:-1][same]] = True
    for i in range(3):
        hit[i : i + n - 2] += at
    return int(np.count_nonzero(hit))


def measure(text: str | None) -> list[int]:
    """MEASURES of one whole text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    n_chars = len(text) - sum(map(text.count, SPACES))
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    upper, lower = int(np.count_nonzero((cp >= 65) & (cp <= 90))), int(np.count_nonzero((cp >= 97) & (cp <= 122)))
    control = int(np.count_nonzero((cp < 9) | ((cp > 13) & (cp < 32)) | (cp == 0xFFFD)))
    return [len(words), n_chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(ids), len(lines), upper, lower, text.count("!"), len(seen), sum(len(w) > 40 for w in words), control]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", *MEASURES]
    for batch in batches:
        for b in slices(batch, "text"):
            got = np.array([measure(x) for x in b.column("text").to_pylist()], np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(got[:, i]) for i in range(len(MEASURES)))], names)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, MEASURES, fail_bits): a row per row of docs, one scan, no shuffle."""
    got = id_text(docs, id_col, text_col).mapInArrow(_measured, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = " | ".join(f"(case when {rule} then {1 << i}L else 0L end)" for i, rule in enumerate(RULES.values()))
    return got.withColumn("fail_bits", F.expr(bits))


def apply_policy(kept_ledger: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """The ledger with policy, base_failed and kept."""
    fails = lambda p: F.col("fail_bits").bitwiseAND(F.lit(mask(p))) != 0
    return kept_ledger.withColumns({"policy": F.lit(policy), "base_failed": fails("base"), "kept": ~(fails("base") | fails(policy))})


def ablation(kept_ledger: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """Per rule of a policy: documents that fail it, and those that only it rejects. One pass, one row per rule."""
    bits = F.col("fail_bits").bitwiseAND(F.lit(mask(policy)))
    names = list(RULES)
    one = {x: F.lit(1 << names.index(x)) for x in POLICIES[policy]}
    sums = [F.count_if(bits.bitwiseAND(b) != 0).alias(f"f_{x}") for x, b in one.items()] + [F.count_if(bits == b).alias(f"o_{x}") for x, b in one.items()]
    cells = ", ".join(f"'{x}', f_{x}, o_{x}" for x in one)
    return kept_ledger.agg(*sums).selectExpr(f"stack({len(one)}, {cells}) as (rule, n_failed, n_only)")
