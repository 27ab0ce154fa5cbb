"""SimHash near-dedup: fingerprints as counts of bits by segment, joined on a grid of those counts, then compared bit by bit."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import drop_table, id_text, join_counted, materialise, slices
from docloom.llm.components import components
from docloom.llm.orderminhash import joined_classes

WORDS, SEED, MOST = 4, 42, 4
#: Bytes of a text that are split into words at once.
PIECE = 1 << 20
#: Fingerprints of a cell that one task compares with each other; cells with more go block by block.
BLOCK = 1 << 15
#: Runs of a cell up to this length are compared by shifts of whole arrays.
SHORT = 12
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: A fingerprint has 32 segments of two bits, a packed vector of counts 0, 1 and 2. A pair at Manhattan distance 4 or less
#: is at 2 or less in the first 17 counts, or at 1 or less in the other 15.
_EVEN, LEFT, RIGHT = 0x5555555555555555, 17, 15


def _bits(hashes: list[int]) -> np.ndarray:
    """How many of the hashes have each bit, the lowest first."""
    return np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """The SimHash of a text's shingles; 0 without words."""
    text, at, before = text.translate(_LOWER), 0, []
    counts, n = np.zeros(64, np.int64), 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end = min((x for x in (text.find(c, end) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")) if x >= 0), default=len(text))
        now = before + text[at:end].split()
        if len(now) >= words:
            flat, ends, stop = b" ".join(now), [], -1
            for w in now:
                stop += len(w) + 1
                ends.append(stop)
            starts = [0, *(e + 1 for e in ends)]
            hashes = [xxhash.xxh64_intdigest(flat[a:b], seed) for a, b in zip(starts, ends[words - 1 :])]
            counts, n = counts + _bits(hashes), n + len(hashes)
            before = now[len(now) - words + 1 :]
        else:
            before = now
        at = end
    if not n and before:
        counts, n = _bits([xxhash.xxh64_intdigest(b" ".join(before), seed)]), 1
    return sum(1 << i for i in np.nonzero(2 * counts > n)[0].tolist()) if n else 0


def _fingerprints(words: int, seed: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                found = [fingerprint(x.as_py() or b"", words, seed) for x in part.column("text").cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return run


def cells_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the grid and the places of the fingerprints in them. On the first counts, each vector and its neighbours:
    vectors at distance 2 have one in common. On the others, each vector, and the neighbours of those of even sum:
    vectors at distance 1 differ in that."""
    fps = fps.astype(np.uint64)
    counts = (fps & np.uint64(_EVEN)) + ((fps >> np.uint64(1)) & np.uint64(_EVEN))
    cells, who = [], []

    def put(vectors: np.ndarray, dims: int, side: int, spread: np.ndarray) -> None:
        every = np.arange(len(vectors))
        cells.append(vectors << np.uint64(1) | np.uint64(side))
        who.append(every)
        for i in range(dims):
            step, digit = np.uint64(1 << 2 * i), (vectors >> np.uint64(2 * i)) & np.uint64(3)
            for there, moved in (((digit < 2) & spread, vectors + step), ((digit > 0) & spread, vectors - step)):
                cells.append(moved[there] << np.uint64(1) | np.uint64(side))
                who.append(every[there])

    put(counts & np.uint64((1 << 2 * LEFT) - 1), LEFT, 0, np.ones(len(fps), bool))
    put(counts >> np.uint64(2 * LEFT), RIGHT, 1, np.bitwise_count(fps >> np.uint64(2 * LEFT)) % 2 == 0)
    return np.concatenate(cells).view(np.int64), np.concatenate(who)


def _cells(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 20_000):
            fps = batch.column("fp").slice(at, 20_000).to_numpy(zero_copy_only=False)
            cells, who = cells_of(fps.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(fps[who])], ["cell", "fp"])


class _Forest:
    """Links that join classes not joined before."""

    def __init__(self, most: int = 1 << 20):
        self.up, self.most, self.a, self.b = {}, most, [], []

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def add(self, a, b) -> None:
        if len(self.up) > self.most:
            self.up = {}
        for x, y in zip(a.tolist(), b.tolist()):
            if (r := self.root(x)) != (s := self.root(y)):
                self.up[r] = s
                self.a.append(x)
                self.b.append(y)

    def taken(self) -> tuple[list[int], list[int]]:
        out, self.a, self.b = (self.a, self.b), [], []
        return out


def _near(x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    return np.bitwise_count((x ^ y).view(np.uint64)) <= most


def link_all(fps: np.ndarray, most: int, forest: _Forest) -> None:
    """Links among all of fps, from each one reached to those not reached yet."""
    rest = fps
    while len(rest):
        stack, rest = [rest[0]], rest[1:]
        while stack and len(rest):
            x = stack.pop()
            near = _near(rest, x, most)
            if near.any():
                found, rest = rest[near], rest[~near]
                forest.add(np.full(len(found), x), found)
                stack += list(found)


def link_runs(cells: np.ndarray, fps: np.ndarray, most: int, forest: _Forest) -> None:
    """Links among fingerprints of equal cells, which stand together."""
    if not len(cells):
        return
    starts = np.concatenate([[0], np.nonzero(cells[1:] != cells[:-1])[0] + 1])
    sizes = np.diff(np.concatenate([starts, [len(cells)]]))
    for at, n in zip(starts[sizes > SHORT].tolist(), sizes[sizes > SHORT].tolist()):
        link_all(fps[at : at + n], most, forest)
    left = np.repeat(np.where(sizes > SHORT, 0, sizes), sizes) - (np.arange(len(cells)) - np.repeat(starts, sizes))
    for d in range(1, SHORT):
        (i,) = np.nonzero(left > d)
        if not len(i):
            break
        i = i[_near(fps[i], fps[i + d], most)]
        forest.add(fps[i], fps[i + d])


def _meet(most: int, block: int):
    """Rows in order of cell to links (a, b), and to blocks (cell, block, fp) of cells that hold more than one block."""

    def run(batches):
        forest, held, number = _Forest(), (np.zeros(0, np.int64), np.zeros(0, np.int64)), 0

        def out(cell=None, n=0, fps=()):
            a, b = forest.taken()
            none = lambda k, kind=pa.int64(): pa.nulls(k, kind)
            columns = [
                pa.chunked_array([pa.array(a, pa.int64()), none(len(fps))]),
                pa.chunked_array([pa.array(b, pa.int64()), none(len(fps))]),
                pa.chunked_array([none(len(a)), pa.array([cell] * len(fps), pa.int64())]),
                pa.chunked_array([none(len(a), pa.int32()), pa.array([n] * len(fps), pa.int32())]),
                pa.chunked_array([none(len(a)), pa.array(fps, pa.int64())]),
            ]
            yield from pa.table(columns, ["a", "b", "cell", "block", "fp"]).combine_chunks().to_batches()

        for batch in batches:
            cells = np.concatenate([held[0], batch.column("cell").to_numpy()])
            fps = np.concatenate([held[1], batch.column("fp").to_numpy()])
            if not len(cells):
                continue
            last = int(np.searchsorted(cells, cells[-1]))  # in order, so the cell that may go on begins here
            at = 0
            if number and last > 0:  # the end of a cell of several blocks
                at = int(np.searchsorted(cells, cells[0], "right"))
                link_all(fps[:at], most, forest)
                yield from out(int(cells[0]), number, fps[:at])
                number = 0
            link_runs(cells[at:last], fps[at:last], most, forest)
            while len(cells) - last > block:
                link_all(fps[last : last + block], most, forest)
                yield from out(int(cells[last]), number, fps[last : last + block])
                number, last = number + 1, last + block
            held = cells[last:], fps[last:]
            yield from out()
        link_all(held[1], most, forest)
        yield from out(int(held[0][0]), number, held[1]) if number else out()

    return run


def link_blocks(group: pa.Table, most: int) -> pa.Table:
    """(a, b) links between two blocks of a cell, of different classes each."""
    block, fps, label = (group.column(c).to_numpy() for c in ("block", "fp", "label"))
    one, label = block == block.min(), label.copy()
    mine, others, found = fps[one], fps[~one], []
    of_mine, of_others = label[one], label[~one]
    for i, x in enumerate(mine):
        near = _near(others, x, most)
        while (open_ := near & (of_others != of_mine[i])).any():
            y = int(open_.argmax())
            found.append((int(x), int(others[y])))
            joined = of_others[y]
            of_mine[of_mine == joined] = of_mine[i]
            of_others[of_others == joined] = of_mine[i]
    return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})


def labels_of(fps: DataFrame, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """(node, label) of the distinct fingerprints fps(fp) that link with any: the least one that each reaches."""
    if most > MOST:
        raise ValueError(f"the grid finds pairs that differ in {MOST} bits or fewer")
    cells = fps.select("fp").mapInArrow(_cells, "cell long, fp long")
    dealt = cells.repartition("cell").sortWithinPartitions("cell")
    met = materialise(dealt.mapInArrow(_meet(most, block), "a long, b long, cell long, block int, fp long"), "met")
    links = materialise(met.where("a is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = components(links)
    drop_table(links)
    crowd = met.where("cell is not null").select("cell", "block", "fp")
    if not crowd.isEmpty():
        crowd = crowd.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
        crowd = materialise(crowd, "crowd")
        open_cells = crowd.groupBy("cell").agg((F.max("block") + 1).alias("blocks"), F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("cell", "blocks")
        # at most one such cell a block of rows
        pairs = F.expr("filter(transform(sequence(0, blocks - 1), k -> struct(least(block, k) as i, greatest(block, k) as j)), p -> p.i != p.j)")
        split = crowd.join(open_cells, "cell").select("cell", "block", "fp", "label", F.explode(pairs).alias("pair"))
        found = split.groupBy("cell", "pair.i", "pair.j").applyInArrow(lambda g: link_blocks(g, most), "a long, b long")
        found = materialise(found.distinct(), "pairs")
        if not found.isEmpty():
            labels = joined_classes(labels, found)
        drop_table(crowd)
    drop_table(met)
    return labels


def simhash_components(docs: DataFrame, most: int = MOST, block: int = BLOCK, words: int = WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long, component_id) of each row of docs: its fingerprint, and the least id that links of at most `most`
    differing bits reach.

    Null texts and texts without a word have the fingerprint 0, which links like any other. Repeated rows stay; null ids
    count for nothing in a component, and one that has no other id is null. An empty table gives no rows. Further columns
    are not read. Whole texts are read.

    Only distinct fingerprints are compared. Each goes to about 39 cells of the grid, in which two that lie within the
    Manhattan distance meet; the bits of pairs in a cell are then compared. A cell of many fingerprints goes block by
    block. A cell gives a spanning forest of links, not all pairs. Joins on keys that may be hot broadcast those keys that
    hold over a thousandth of all rows, of which there are less than a thousand."""
    rows = materialise(id_text(docs, id_col, text_col).mapInArrow(_fingerprints(words, seed), "doc_id long, fp long"), "fingerprints")
    fps = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "distinct")
    labels = labels_of(fps, most, block)
    linked = materialise(fps.join(labels.withColumnRenamed("node", "fp"), "fp", "left"), "linked")
    classes = linked.where("label is not null").groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    several = join_counted(linked.where("label is not null").select("fp", "copies", "label"), materialise(classes, "classes"), "label", "members")
    alone = linked.where("label is null").select("fp", "copies", F.col("least").alias("component_id"))
    placed = materialise(several.select("fp", "copies", "component_id").unionByName(alone), "placed")
    for table in (fps, linked):
        drop_table(table)
    return join_counted(rows, placed, "fp", "copies").select("doc_id", "fp", "component_id")
