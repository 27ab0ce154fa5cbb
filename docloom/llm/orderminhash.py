"""Near-duplicate detection by Order MinHash.

A text's 5-word shingles are labelled with their occurrence (the third time a shingle comes is another element than
the first). For each of many hash functions the sketch takes the two labelled shingles with the least hashes and
keeps them in text order, so texts agree where they hold the same shingles in the same order: edit similarity rather
than set similarity. Sketches are joined in bands; texts that share a band are candidates.

Candidates are verified by a banded alignment of their words: with L words aligned of n and m, similarity is
L / (n + m - L), at least 0.8 for a link. Pairs of words further from the diagonal than the unmatched words that the
threshold allows lie outside the band. One edited word breaks five shingles but one word, so a pair at the threshold may
share only four shingles in ten: bands are of one sketch each, which a pair with a tenth of its words replaced meets in
one of 20 with probability 0.98. Words are compared by 32 bits there.

Copies of a text are one node, found by a digest, and never expanded. Every pair that shares a band's bucket is of one
class in the end, or was tested, or is ruled out by a bound, without all pairs of a bucket being formed:

1. Every text is compared with its buckets' pivots: the text that meets most others, as the copies of an edited text
   meet the text itself more often than each other. Links make classes, the connected components.
2. Buckets that hold several classes are open. L aligned words lie in at most n + m - 2 L + 1 unbroken runs, so two linked
   texts share at least 5 L - 2 (n + m) - 2 runs of three words. One aggregation counts, for each text, those that any
   other text of the open buckets holds; texts for which that is too little for any link go.
3. The texts left in an open bucket are dealt to blocks, those of its largest class apart from the others, and blocks meet
   blocks, but never two of the largest class. In a pair of blocks the runs of three words that two texts share are
   counted for all pairs at once from the runs' owners; pairs of different classes that share enough, and no earlier
   band, are aligned.

Classes are joined by the links of step 3; only the graph of classes is searched for components then.

A text without a word, null included, is in no class but its own row's; a text of fewer than 5 words is only ever the
copy of an equal one. The class id is the least doc_id of the class (null if no member has one). Repeated rows are
copies.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.blocks import Rolling, mixed
from docloom.llm.common import drop_table, materialise, slices
from docloom.llm.components import components
from docloom.llm.substrings import Words

SHINGLE, TAKEN, ROWS, BANDS, SIMILARITY = 5, 2, 1, 20, 0.8
#: Words in a run, for bounds.
RUN = 3
#: Places of a text that are aligned as one number.
BITS = 4096
#: Bytes of words in a block of an open bucket.
BLOCK_BYTES = 1 << 19
#: The most candidates' ids that are broadcast (about 60 bytes each); beyond it texts are joined by shuffle.
MOST_BROADCAST = 300_000


def labelled(hashes: np.ndarray) -> np.ndarray:
    """Shingle hashes with the number of their occurrence mixed in."""
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    first = np.ones(len(h), bool)
    first[1:] = h[1:] != h[:-1]
    if first.all():
        return hashes
    run = np.nonzero(first)[0]
    nth = np.arange(len(h)) - np.repeat(run, np.diff(np.append(run, len(h))))
    out = np.empty_like(hashes)
    out[order] = np.where(nth > 0, mixed(h + nth.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB)), h)
    return out


def shingles(texts: list[str | None], size: int = SHINGLE) -> list[np.ndarray]:
    """The labelled shingles of each whole text, in order."""
    w = Words(texts)
    roll = Rolling(w.hash).windows(size)
    starts = w.upto - w.counts
    return [labelled(roll[a : max(z - size + 1, a)]) for a, z in zip(starts.tolist(), w.upto.tolist(), strict=True)]


def runs(words: np.ndarray) -> np.ndarray:
    """The labelled runs of three words of a text given as word hashes."""
    w = words.astype(np.uint64)
    if len(w) < RUN:
        return w[:0]
    h = w[: len(w) - RUN + 1].copy()
    for k in range(1, RUN):
        h = mixed(h * np.uint64(0x8EBC6AF09C88C6E3) + w[k : len(w) - RUN + 1 + k])
    return labelled(h)


def least_runs(words, least: float):
    """Runs of three words that two texts of `words` words together share at least, if they are linked."""
    return ((2 * RUN - 1) * least / (1 + least) - (RUN - 1)) * words - (RUN - 1) - 1e-9


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return x[:n], x[n:] | np.uint64(1)


def sketch(s: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One hash a band; each joins `rows` order-min-hashes of two shingles in text order."""
    xor, odd = _seeds(bands * rows)
    picks = np.empty((bands * rows, TAKEN), np.int64)
    step = max(1, (1 << 18) // len(s))
    for lo in range(0, len(xor), step):
        v = (s[None, :] ^ xor[lo : lo + step, None]) * odd[lo : lo + step, None]
        r = np.arange(len(v))
        for t in range(TAKEN):
            at = v.argmin(1)
            picks[lo : lo + step, t] = at
            v[r, at] = np.uint64(2**64 - 1)
    picks.sort(1)
    x = np.arange(bands * rows, dtype=np.uint64)
    for t in range(TAKEN):
        x = mixed(x * np.uint64(0x8EBC6AF09C88C6E3) + s[picks[:, t]])
    x = x.reshape(bands, rows)
    out = x[:, 0].copy()
    for i in range(1, rows):
        out = mixed(out * np.uint64(0x589965CC75374CC3) + x[:, i])
    return out.view(np.int64)


def aligned(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """The most words of a and b that align at most `band` places from the diagonal (or a few more places).

    The row of the alignment table over BITS places of a is one number whose zero bits are the steps of the row; a word of
    b changes it by one addition, whose carry goes to the next places of a."""
    total, rows = 0, b.tolist()
    carry = bytearray(len(rows))
    full = (1 << BITS) - 1
    for start in range(0, len(a), BITS):
        places: dict[int, int] = {}
        for k, x in enumerate(a[start : start + BITS].tolist()):
            places[x] = places.get(x, 0) | 1 << k
        ones = (1 << min(BITS, len(a) - start)) - 1 if len(a) - start < BITS else full
        width = ones.bit_length()
        lo, hi = max(0, start - band), min(len(rows), start + width + band)
        v, out = ones, bytearray(len(rows))
        for j in range(lo, hi):
            u = v & places.get(rows[j], 0)
            if u or carry[j]:
                up = v + u + carry[j]
                out[j] = up >> width
                v = (up | (v - u)) & ones
        total += width - v.bit_count()
        carry = out
    return total


def alike(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether the aligned share of two texts, given as word hashes, is at least `least`."""
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < least * max(n, m):
        return False
    need = least * (n + m) / (1 + least) - 1e-9
    k = min(n, m)
    same = a[:k] == b[:k]
    first = k if same.all() else int(same.argmin())
    a, b, k = a[first:], b[first:], k - first
    same = a[len(a) - k :][::-1] == b[len(b) - k :][::-1]
    last = k if same.all() else int(same.argmin())
    a, b = a[: len(a) - last], b[: len(b) - last]
    need -= first + last
    if need <= 0:
        return True
    if min(len(a), len(b)) < need:
        return False
    # as sets of labelled words the texts share at least what aligns; if that is in one order, it aligns
    x, y = labelled(a.astype(np.uint64)), labelled(b.astype(np.uint64))
    by = np.argsort(y, kind="stable")
    at = np.minimum(np.searchsorted(y[by], x), len(y) - 1)
    hit = y[by][at] == x
    if np.count_nonzero(hit) < need:
        return False
    tails: list[int] = []
    for p in by[at[hit]].tolist():
        k = bisect_left(tails, p)
        if k == len(tails):
            tails.append(p)
        else:
            tails[k] = p
    return len(tails) >= need or aligned(a, b, int(len(a) + len(b) - 2 * need) + 1) >= need


def _sketches(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", 1 << 20):
                texts = b.column("text").to_pylist()
                got = [sketch(s, bands, rows) if len(s) else None for s in shingles(texts)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), b.column("worded"), pa.array(Words(texts).counts, pa.int32()), pa.array(got, pa.list_(pa.int64()))], ["doc_id", "key", "worded", "size", "bands"])

    return run


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in slices(batch, "text", 1 << 20):
            w = Words(b.column("text").to_pylist())
            short, starts = (w.hash >> np.uint64(32)).astype("<u4"), w.upto - w.counts
            got = [short[a:z].tobytes() for a, z in zip(starts.tolist(), w.upto.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(got, pa.binary())], ["key", "seq"])


def _verifier(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [alike(np.frombuffer(x.as_buffer(), "<u4"), np.frombuffer(y.as_buffer(), "<u4"), least) for x, y in zip(batch.column("seq_a"), batch.column("seq_b"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(near, pa.bool_())], ["a", "b", "near"])

    return run


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, key, worded): key is a digest of the whole text, worded whether it has a word."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.withColumns({"key": F.unhex(F.md5(F.col("text").cast("binary"))), "worded": F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))})


def joined_classes(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels(node, label) after links(a, b) between nodes, some of which may have no label yet."""
    named = links
    for end in ("a", "b"):
        named = named.join(labels.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label")), end, "left")
    edges = named.select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b")).where("a <> b").distinct()
    moved = materialise(components(edges), "moved")
    to = moved.select(F.col("node").alias("label"), F.col("label").alias("new"))
    old = labels.join(to, "label", "left").select("node", F.coalesce("new", "label").alias("label"))
    return materialise(old.unionByName(moved.join(labels.select("node"), "node", "left_anti")), "labels")


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in slices(batch, "seq", 1 << 20):
            seqs = [(runs(np.frombuffer(x.as_buffer(), "<u4")) >> np.uint64(32)).astype("<u4").view("<i4") for x in b.column("seq")]
            key = b.column("key").take(pa.array(np.repeat(np.arange(len(seqs)), [len(x) for x in seqs])))
            yield pa.RecordBatch.from_arrays([key, pa.array(np.concatenate(seqs))], ["key", "s"])


def open_buckets(cells: DataFrame, labels: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(band, h, key, label, size, major) of the buckets with several classes, without texts that cannot link; major: of
    the bucket's largest class."""
    # what is joined to a bucket's members is stored first: Spark splits a large partition of a join of two plain exchanges
    named = cells.select("band", "h", "key", "size").join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    several = lambda df: df.join(materialise(df.groupBy("band", "h").agg((F.min("label") != F.max("label")).alias("open")).where("open").select("band", "h"), "several"), ["band", "h"])
    still = materialise(several(named), "open")
    rows = texts.join(still.select("key").distinct(), "key", "left_semi").mapInArrow(_run_rows, "key binary, s int")
    held = rows.groupBy("s").agg(F.min("key").alias("key"), F.count("*").alias("n")).where("n = 1").groupBy("key").agg(F.count("*").alias("alone"))
    # the other text's words are between these
    fewest = F.least(*(least_runs(F.col("size") * (1 + x), least) for x in (least, 1 / least)))
    may = still.join(held, "key", "left").where(F.col("size") - (RUN - 1) - F.coalesce("alone", F.lit(0)) >= fewest).drop("alone")
    left = materialise(several(may), "pool")
    drop_table(still)
    largest = left.groupBy("band", "h", "label").agg(F.count("*").alias("n")).groupBy("band", "h").agg(F.max(F.struct("n", "label")).alias("top"))
    return materialise(left.join(materialise(largest, "largest"), ["band", "h"]).withColumn("major", F.col("label") == F.col("top.label")).drop("top"), "pool")


def in_block_pairs(pool: DataFrame, block_bytes: int) -> DataFrame:
    """The members of pool once for each pair (i, j) of blocks that their own block meets; own is that block."""
    weight = F.col("size") * 4 + 300
    blocks = lambda own: F.ceil(F.coalesce(F.sum(F.when(own, weight)), F.lit(0)) / block_bytes).cast("int")
    counts = pool.groupBy("band", "h").agg(blocks(~F.col("major")).alias("minors"), blocks(F.col("major")).alias("majors"))
    placed = pool.join(materialise(counts, "blocks"), ["band", "h"])
    among = lambda n: F.pmod(F.xxhash64("key"), n).cast("int")
    placed = placed.withColumn("own", F.when(F.col("major"), F.col("minors") + among(F.col("majors"))).otherwise(among(F.col("minors"))))
    others = F.sequence(F.lit(0), F.when(F.col("major"), F.col("minors") - 1).otherwise(F.col("minors") + F.col("majors") - 1))
    pair = F.explode(F.transform(others, lambda k: F.struct(F.least("own", k).alias("i"), F.greatest("own", k).alias("j"))))
    return placed.select("band", "h", "key", "label", "own", pair.alias("pair")).select("band", "h", "key", "label", "own", "pair.i", "pair.j")


def link_blocks(group: pa.Table, least: float) -> pa.Table:
    """(a, b) links between members of different classes of two blocks; once two classes are linked, no more of them."""
    band, own = group.column("band")[0].as_py(), np.array(group.column("own").to_pylist())
    key, label = group.column("key").to_pylist(), group.column("label").to_pylist()
    bands = np.array(group.column("bands").to_pylist(), np.int64).reshape(len(key), -1)
    seqs = [np.frombuffer(x.as_buffer(), "<u4") for x in group.column("seq")]
    class_of = np.unique(np.array([x.hex() for x in label]), return_inverse=True)[1]
    sizes = np.array([len(x) for x in seqs])
    i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
    # the owners of each run of three words on the other side
    grams = [runs(x) for x in seqs]
    other = np.nonzero(own == j)[0]
    held, owner = np.concatenate([grams[k] for k in other]) if len(other) else np.empty(0, np.uint64), np.repeat(other, [len(grams[k]) for k in other])
    by = np.argsort(held, kind="stable")
    held, owner = held[by], owner[by]

    def shared(x: int) -> np.ndarray:
        lo = np.searchsorted(held, grams[x])
        n = np.searchsorted(held, grams[x], "right") - lo
        at = np.arange(int(n.sum())) + np.repeat(lo - (np.cumsum(n) - n), n)
        return np.bincount(owner[at], minlength=len(seqs))

    up = list(range(int(class_of.max()) + 1))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    found = []
    for x in np.nonzero(own == i)[0].tolist():
        y = other[other > x] if i == j else other
        y = y[(class_of[y] != class_of[x]) & (shared(x)[y] >= least_runs(sizes[x] + sizes[y], least))]
        y = y[~(bands[y, :band] == bands[x, :band]).any(1)]
        for k in y.tolist():
            if root(class_of[x]) != root(class_of[k]) and alike(seqs[x], seqs[k], least):
                found.append((key[x], key[k]))
                up[root(class_of[x])] = root(class_of[k])
    return pa.table({c: pa.array([f[n] for f in found], pa.binary()) for n, c in enumerate("ab")})


def near_classes(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, least: float = SIMILARITY, block_bytes: int = BLOCK_BYTES, most_broadcast: int = MOST_BROADCAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, class_id, class_size) for each row of docs; key is a digest of the row's text, null for null."""
    base = keyed(docs, id_col, text_col)
    sketched = materialise(base.mapInArrow(_sketches(bands, rows), "doc_id long, key binary, worded boolean, size int, bands array<long>"), "sketches")
    # one node per distinct text; the bands of copies are equal
    nodes = sketched.where("worded").groupBy("key").agg(F.min("doc_id").alias("rep"), F.min("size").alias("size"), F.min("bands").alias("bands"), F.count("*").alias("copies"))
    nodes = materialise(nodes, "nodes")
    cells = nodes.where("bands is not null").select("key", "size", F.posexplode("bands").alias("band", "h"))
    shared = cells.groupBy("band", "h").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialise(shared, "shared")
    met_in = materialise(cells.join(shared, ["band", "h"]), "buckets")
    cells = materialise(met_in.join(met_in.groupBy("key").agg(F.sum("n").alias("meets")), "key"), "cells")
    for table in (shared, met_in):
        drop_table(table)
    members = cells.select("key").distinct()
    seen = materialise(members.join(nodes.select("key", "rep", "bands"), "key"), "members")
    of_text = seen.select(F.col("key").alias("seen_key"), "rep")
    if seen.count() <= most_broadcast:
        of_text = F.broadcast(of_text)
    same = F.col("key").eqNullSafe(F.col("seen_key")) & F.col("doc_id").eqNullSafe(F.col("rep"))
    texts = base.join(of_text, same, "left_semi").select("key", "text").mapInArrow(_sequences, "key binary, seq binary")
    texts = materialise(texts.dropDuplicates(["key"]), "sequences")

    # 1. every text with its buckets' pivots
    rank = F.struct(-F.col("meets"), F.xxhash64("key"))
    firsts = F.min(F.struct(rank.alias("rank"), F.col("key").alias("pivot"), F.col("size").alias("pivot_size")))
    pivots = materialise(cells.groupBy("band", "h").agg(firsts.alias("p")).select("band", "h", "p.pivot", "p.pivot_size"), "pivots")
    # sizes further apart than the threshold allows rule a pair out, as in alike()
    near = F.least("size", "pivot_size") >= F.lit(least) * F.greatest("size", "pivot_size")
    met = cells.join(pivots, ["band", "h"]).where((F.col("key") != F.col("pivot")) & near).select(F.least("key", "pivot").alias("a"), F.greatest("key", "pivot").alias("b")).distinct()
    one, two = texts.select(F.col("key").alias("a"), F.col("seq").alias("seq_a")), texts.select(F.col("key").alias("b"), F.col("seq").alias("seq_b"))
    judged = met.join(one, "a").join(two, "b").mapInArrow(_verifier(least), "a binary, b binary, near boolean")
    links = materialise(judged.where("near").select("a", "b"), "pairs")
    labels = components(links)
    drop_table(links)
    # 2. and 3. what is left in open buckets
    pool = open_buckets(cells, labels, texts, least)
    dealt = in_block_pairs(pool, block_bytes).join(texts, "key").join(seen.select("key", "bands"), "key")
    found = dealt.groupBy("band", "h", "i", "j").applyInArrow(lambda group: link_blocks(group, least), "a binary, b binary")
    found = materialise(found.distinct(), "pairs")
    if not found.isEmpty():
        labels = joined_classes(labels, found)
    for table in (cells, texts, found, seen, pivots, pool):
        drop_table(table)
    placed = nodes.join(labels.withColumnRenamed("node", "key"), "key", "left").select("key", "rep", "copies", F.coalesce("label", "key").alias("label"))
    classes = placed.groupBy("label").agg(F.min("rep").alias("class_id"), F.sum("copies").alias("class_size"))
    of_text = placed.join(classes, "label").select("key", "class_id", "class_size")
    with_words = sketched.where("worded").select("doc_id", "key").join(of_text, "key").select("doc_id", "key", "class_id", "class_size")
    return with_words.unionByName(sketched.where("not worded").select("doc_id", "key", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size")))


def keep_first_of_class(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs without near duplicates: of each class the row with the class id stays, and one only."""
    classes = near_classes(docs, **options)
    firsts = classes.where("doc_id <=> class_id").groupBy("doc_id", "key").agg((F.count_if(F.col("class_size") > 1) > 1).alias("repeated"))
    # no column of docs has one of these names
    taken = {c.lower() for c in docs.columns}
    keep_id, keep_key, repeated = (next(n for n in (f"_{x}{i}" for i in range(len(taken) + 1)) if n not in taken) for x in ("id", "key", "again"))
    lead = materialise(firsts.toDF(keep_id, keep_key, repeated), "kept")
    digest = F.unhex(F.md5(docs["text"].cast("string").cast("binary")))
    got = docs.join(lead, docs["doc_id"].cast("long").eqNullSafe(F.col(keep_id)) & digest.eqNullSafe(F.col(keep_key)))
    once = got.where(F.col(repeated)).dropDuplicates([keep_id, keep_key])
    return got.where(~F.col(repeated)).unionByName(once).select(*(F.col(f"`{c}`") for c in docs.columns))
