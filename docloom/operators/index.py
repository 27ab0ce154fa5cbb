"""A stored inverted index: postings in blocks with positions, searched with bounds.

A block is the postings of a term in up to 64 neighbouring documents, with the greatest frequency and the least length among
them, from which the most that the block can add to a score follows for any parameters. A search keeps a threshold for each
query, the k-th best score known so far, and leaves out terms, blocks and documents that cannot reach it."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions.text import tokenize
from docloom.operators.bm25 import BROADCAST_TERMS, PARTS, SLACK, TOKENS, WAITING, Tokenizer, ends, pieces, starts
from docloom.operators.numbering import checkpointed
from docloom.sources import manifest

#: Documents of a block, as bits of a document number: numbers go from 0 on within a partition of the index.
BLOCK_BITS = 6
_DOCS = "docid string, contents string, len int, tf map<string,int>"
_POSTINGS = "term string, block long, docs array<int>, tfs array<int>, lens array<int>, places array<array<int>>, top_tf int, low_len int"
_GATHERED = "block long, docs array<tinyint>, terms array<int>, tfs array<int>, lens array<int>, docids array<string>"
#: Postings, times k, that are summed for a query's first threshold.
SEED_POSTINGS = 32


def _counted(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Of an array of token lists: document, term and place of each token, the terms, and the lengths."""
    lengths = tokens.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    terms = tokens.flatten().dictionary_encode()
    doc = np.repeat(np.arange(len(tokens)), lengths)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return doc, terms.indices.to_numpy(zero_copy_only=False).astype(np.int64), place, terms.dictionary, lengths


def _offsets(starts: np.ndarray, n: int) -> pa.Array:
    return pa.array(np.concatenate([starts, [n]]).astype(np.int32))


def _parts(batches, blocks: bool = False):
    """Slices of batches of about TOKENS tokens, of whole blocks if asked for."""
    for batch in batches:
        lengths = batch.column("toks").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for a, z in pieces(lengths, TOKENS, batch.column("docno").to_numpy() >> BLOCK_BITS if blocks else None):
            yield batch.slice(a, z - a)


def _forward(batches):
    for batch in _parts(batches):
        doc, term, _, names, lengths = _counted(batch.column("toks"))
        order = np.lexsort((term, doc))
        doc, term = doc[order], term[order]
        at = starts(doc, term)
        n = np.diff(np.concatenate([at, [len(doc)]]))
        ends = np.concatenate([[0], np.cumsum(np.bincount(doc[at], minlength=len(lengths)))])
        tf = pa.MapArray.from_arrays(pa.array(ends.astype(np.int32)), names.take(pa.array(term[at])), pa.array(n.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([batch.column("docid"), batch.column("contents"), pa.array(lengths.astype(np.int32)), tf], ["docid", "contents", "len", "tf"])


def _blocks(batches):
    for batch in _parts(batches, True):
        docno = batch.column("docno").to_numpy()
        doc, term, place, names, lengths = _counted(batch.column("toks"))
        block = docno >> BLOCK_BITS
        order = np.lexsort((place, doc, block[doc], term))
        doc, term, place = doc[order], term[order], place[order]
        posting = starts(term, doc)
        tf = np.diff(np.concatenate([posting, [len(doc)]]))
        d, t = doc[posting], term[posting]
        row = starts(t, block[d])
        if not len(row):
            continue
        lists = lambda values: pa.ListArray.from_arrays(_offsets(row, len(posting)), values)
        ints = lambda x: pa.array(x.astype(np.int32))
        places = pa.ListArray.from_arrays(_offsets(posting, len(place)), ints(place))
        yield pa.RecordBatch.from_arrays(
            [names.take(pa.array(t[row])), pa.array(block[d[row]]), lists(ints(docno[d] & ((1 << BLOCK_BITS) - 1))), lists(ints(tf)), lists(ints(lengths[d])), lists(places), ints(np.maximum.reduceat(tf, row)), ints(np.minimum.reduceat(lengths[d], row))],
            ["term", "block", "docs", "tfs", "lens", "places", "top_tf", "low_len"],
        )


def build(docs: DataFrame, at: str, cut: Tokenizer = tokenize) -> None:
    """Writes the index of docs(docid, contents) to the folder at: documents with their texts, lengths and frequencies,
    postings, counts. A null text has no tokens. Blocks hold neighbours of the input. A task writes the postings of its own
    documents, slice by slice in order of terms, so neither texts nor postings are shuffled or spilled."""
    spark = docs.sparkSession
    docno = F.monotonically_increasing_id().alias("docno")
    toks = F.coalesce(cut("contents"), F.array().cast("array<string>")).alias("toks")
    dealt, tasks = docs.select("docid", "contents"), spark.sparkContext.defaultParallelism
    if dealt.rdd.getNumPartitions() < tasks and (least := min(tasks, dealt.count() // 1000)) > 1:
        dealt = dealt.repartition(least)  # a small table in few files
    dealt.select("docid", "contents", toks).mapInArrow(_forward, _DOCS).select("*", docno).write.parquet(f"{at}/docs", compression="zstd")
    held = spark.read.parquet(f"{at}/docs")
    held.select("docno", toks).mapInArrow(_blocks, _POSTINGS).write.parquet(f"{at}/postings", compression="zstd")
    held.agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("total")).coalesce(1).write.parquet(f"{at}/stats")


class Index:
    """A folder that build() wrote."""

    def __init__(self, spark: SparkSession, at: str, cut: Tokenizer = tokenize):
        self.at, self.cut = at, cut
        self.docs, self.postings = (spark.read.parquet(f"{at}/{x}") for x in ("docs", "postings"))
        self.n, total = spark.read.parquet(f"{at}/stats").first()
        self.mean = total / self.n if self.n else 0.0

    def part(self, tf: Column | str, length: Column | str, k1: float, b: float) -> Column:
        """What a term adds to a score, but for its weight; it grows with tf and falls with the length."""
        tf, length = (F.col(x) if isinstance(x, str) else x for x in (tf, length))
        return tf / (tf + k1 * (1 - b + b * length / F.lit(self.mean or 1.0)))


def opened(docs: DataFrame, at: str, cut: Tokenizer = tokenize, **params) -> Index:
    """The index of docs in the folder at, built if none is there that was made from the same files with the same params."""
    spark = docs.sparkSession
    mark = manifest.fingerprint({"index": 1, "block_bits": BLOCK_BITS, **params}, docs)
    return Index(spark, manifest.made(spark, at, mark, lambda folder: build(docs, folder, cut)), cut)


def _docno(block: Column, doc: Column) -> Column:
    return F.shiftleft(block, BLOCK_BITS) + doc


def _summed(index: Index, weighted: DataFrame, k1: float, b: float) -> DataFrame:
    """(qid, docno, partial): sums over the postings of weighted(qid, term, idf)."""
    hits = index.postings.select("term", "block", "docs", "tfs", "lens").join(weighted, "term")
    each = hits.select("qid", "idf", "block", F.explode(F.arrays_zip("docs", "tfs", "lens")).alias("p"))
    score = F.col("idf") * index.part(F.col("p.tfs"), F.col("p.lens"), k1, b)
    return each.groupBy("qid", _docno(F.col("block"), F.col("p.docs")).alias("docno")).agg(F.sum(score).alias("partial"))


def _kth(sums: DataFrame, k: int) -> DataFrame:
    """(qid, tau): the k-th best partial sum of each query that has so many."""
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("partial")))
    return sums.withColumn("_p", place).where(F.col("_p") <= k).where(F.col("_p") == k).select("qid", F.col("partial").alias("tau"))


def _judged(index: Index, terms: DataFrame, k: int, k1: float, b: float) -> DataFrame:
    """(qid, term, idf, set_aside, tau, rest) of terms(qid, term) that the index holds.

    1. Of the terms that can add most, so many are summed as have SEED_POSTINGS * k postings: the k-th best sum is a
       threshold. Any sums give one, so terms left out here cost time later and no result.
    2. Terms that together stay below half of it are set aside: no document has a chance by all of these alone, the rest, and
       few have one by one other term and these."""
    few = terms.count() <= BROADCAST_TERMS
    small = F.broadcast if few else lambda df: df
    tops = index.postings.select("term", F.size("docs").alias("n"), index.part("top_tf", "low_len", k1, b).alias("top"))
    per_term = tops.join(small(terms.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"), F.max("top").alias("top"))
    idf = F.log(1 + (index.n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = checkpointed(terms.join(per_term, "term").select("qid", "term", "df", idf.alias("idf"), (idf * F.col("top")).alias("most")))
    best_first = Window.partitionBy("qid").orderBy(F.desc("most"), "term").rowsBetween(Window.unboundedPreceding, 0)
    seeds = weights.where(F.col("df") <= SEED_POSTINGS * k).withColumn("_n", F.sum("df").over(best_first)).where(F.col("_n") <= SEED_POSTINGS * k).select("qid", "term", "idf")
    tau = checkpointed(_kth(_summed(index, small(seeds), k1, b), k))
    least_first = Window.partitionBy("qid").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0)
    judged = weights.join(tau, "qid", "left").withColumn("aside", F.sum("most").over(least_first))
    judged = judged.withColumn("set_aside", F.coalesce(F.col("aside") + SLACK < F.col("tau") / 2, F.lit(False)))
    rest = F.coalesce(F.max(F.when(F.col("set_aside"), F.col("aside"))).over(Window.partitionBy("qid")), F.lit(0.0))
    return checkpointed(judged.select("qid", "term", "idf", "set_aside", "tau", rest.alias("rest")))


def _of_blocks(block: np.ndarray, **columns) -> pa.RecordBatch:
    """One row for each block, with lists of what the columns hold of it."""
    order = np.argsort(block, kind="stable")
    at = starts(block[order])
    offsets = _offsets(at, len(block))
    lists = {name: pa.ListArray.from_arrays(offsets, column.take(pa.array(order))) for name, column in columns.items()}
    none = lambda kind: pa.nulls(len(at), pa.list_(kind))
    kinds = {"docs": pa.int8(), "terms": pa.int32(), "tfs": pa.int32(), "lens": pa.int32(), "docids": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(block[order][at]), *(lists[x] if x in lists else none(kind) for x, kind in kinds.items())], ["block", *kinds])


def _gathered(batches):
    """Postings (block, number of the term, docs, tfs), a row for each block of a batch."""
    for batch in batches:
        n = batch.column("docs").value_lengths().to_numpy()
        row = np.repeat(np.arange(len(batch)), n)
        if len(row):
            docs, tfs = (batch.column(x).flatten() for x in ("docs", "tfs"))
            yield _of_blocks(batch.column("block").to_numpy()[row], docs=docs.cast(pa.int8()), terms=batch.column("number").take(pa.array(row)), tfs=tfs)


def _gathered_docs(batches):
    """Documents (docno, docid, len), a row for each block of a batch."""
    for batch in batches:
        if len(batch):
            docno = batch.column("docno").to_numpy()
            docs = pa.array((docno & ((1 << BLOCK_BITS) - 1)).astype(np.int8))
            yield _of_blocks(docno >> BLOCK_BITS, docs=docs, lens=batch.column("len"), docids=batch.column("docid"))


def _whole_blocks(batches):
    """Batches in order of blocks, cut anew where a block ends."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        block = batch.column("block").to_numpy()
        last = int(np.searchsorted(block, block[-1]))
        if last or (waiting and waiting[-1].column("block")[-1].as_py() != block[-1]):
            yield pa.Table.from_batches([*waiting, batch.slice(0, last)]).combine_chunks().to_batches()[0]
            waiting = []
        waiting.append(batch.slice(last))
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]


def _spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs of these lengths: which run an element is of, and its place there."""
    run = np.repeat(np.arange(len(n)), n)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)


def _cells(cell: np.ndarray, add: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The different ones of n cells, and their sums; what is added is above 0."""
    if n <= 4 * len(cell):
        sums = np.bincount(cell, add, n)
        cell = np.nonzero(sums)[0]
        return cell, sums[cell]
    cell, back = np.unique(cell, return_inverse=True)
    return cell, np.bincount(back, add, len(cell))


def _searching(shared, k: int, k1: float, b: float):
    """A task that reads rows of _gathered and _gathered_docs in order of blocks and gives (qid, docid, raw) of what may be
    among the k best, and a row of the counts (read, scored) a batch.

    1. A block is read for a query if what the query's terms can add there, and all set aside, reaches the threshold.
    2. Terms set aside are added where the sum and all of them reach the threshold.
    3. The k best sums of a batch raise the threshold; of equal ones those of the least docids stay."""

    def run(batches):
        qids, first, whose, idf, aside, start, rest, mean = shared.value
        n_of, many, tau = np.diff(first), max(1, len(qids)), start.copy()

        def pruned(found, places):
            q, doc, raw = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((places[doc], -raw, q))
            q, doc, raw = q[order], doc[order], raw[order]
            at = starts(q)
            n = ends(at, len(q)) - at
            full = n >= k
            tau[q[at[full]]] = np.maximum(tau[q[at[full]]], raw[at[full] + k - 1])
            equal = starts(q, raw)
            alike = _spread(ends(equal, len(q)) - equal)[1]
            kept = (_spread(n)[1] < k) | ((raw >= tau[q] - SLACK) & (alike < k))
            return q[kept], doc[kept], raw[kept]

        def scored(block, doc, term, part):
            """(query, doc, sum) of what may be among the best, of postings in order of block and term; how many pairs were read."""
            run_at = starts(block, term)
            size = ends(run_at, len(block)) - run_at
            kind, place = _spread(n_of[term[run_at]])
            pair = first[term[run_at]][kind] + place
            q, at = whose[pair], (np.cumsum(np.diff(block[run_at], prepend=block[0]) != 0))[kind]
            most = np.maximum.reduceat(part, run_at)
            key, back = np.unique(at * many + q, return_inverse=True)
            reach = np.bincount(back, np.where(aside[pair], 0.0, idf[pair] * most[kind]), len(key))
            open_ = ((reach > 0) & (reach + rest[key % many] + SLACK >= tau[key % many]))[back]

            def added(some):
                row, place = _spread(size[kind[some]])
                i = run_at[kind[some]][row] + place
                return doc[i] * many + q[some][row], idf[pair[some]][row] * part[i]

            cell, sums = _cells(*added(np.nonzero(open_ & ~aside[pair])[0]), (int(doc.max()) + 1) * many)
            n, good = len(cell), sums + rest[cell % many] + SLACK >= tau[cell % many]
            cell, sums = cell[good], sums[good]
            if len(cell) and (open_ & aside[pair]).any():
                more, add = added(np.nonzero(open_ & aside[pair])[0])
                i = np.minimum(np.searchsorted(cell, more), len(cell) - 1)
                met = cell[i] == more
                sums = sums + np.bincount(i[met], add[met], len(cell))
            return (cell % many, cell // many, sums), n

        for batch in _whole_blocks(batches):
            block, held = batch.column("block").to_numpy(), batch.column("docids").is_valid().to_numpy(zero_copy_only=False)
            flat = lambda rows, name: rows.column(name).flatten()
            number = lambda rows: np.repeat(rows.column("block").to_numpy(), rows.column("docs").value_lengths().to_numpy()) * (1 << BLOCK_BITS) + flat(rows, "docs").to_numpy()
            own = batch.filter(pa.array(held))
            docno, docids, length = number(own), flat(own, "docids"), flat(own, "lens").to_numpy()
            order = np.argsort(docno)
            docno, docids, length = docno[order], docids.take(pa.array(order)), length[order]
            places = np.empty(len(docno), np.int64)
            places[pc.array_sort_indices(docids).to_numpy() if not docids.null_count else np.argsort(pc.rank(docids, null_placement="at_start").to_numpy())] = np.arange(len(docno))
            norm = k1 * (1 - b + b * length / mean)
            rows = batch.filter(pa.array(~held))
            block = block[~held]
            n_terms = rows.column("terms").value_lengths().to_numpy().astype(np.int64)
            total = np.concatenate([[0], np.cumsum(n_of[flat(rows, "terms").to_numpy()])])
            parts = np.diff(total[np.concatenate([[0], np.cumsum(n_terms)])])
            found, waiting, read, full = [], 0, 0, 0
            for x, z in pieces(parts, PARTS, block):
                some = rows.slice(x, z - x)
                term, tf, key = flat(some, "terms").to_numpy(), flat(some, "tfs").to_numpy().astype(np.int64), number(some)
                order = np.lexsort((key, term, key >> BLOCK_BITS))
                term, tf, key = term[order], tf[order], key[order]
                doc = np.searchsorted(docno, key)
                low = int(doc.min())
                (q, doc, raw), n = scored(key >> BLOCK_BITS, doc - low, term, tf / (tf + norm[doc]))
                read, full = read + n, full + len(q)
                good = raw >= tau[q] - SLACK
                found.append((q[good], doc[good] + low, raw[good]))
                waiting += int(good.sum())
                if waiting > WAITING:
                    found = [pruned(found, places)]
                    waiting = len(found[0][0])
            q, doc, raw = pruned(found, places) if waiting else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            count = lambda n: pa.array([None] * len(q) + [n], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([x, pa.nulls(1, x.type)]) for x in (qids.take(pa.array(q)), docids.take(pa.array(doc)), pa.array(raw))] + [count(read), count(full)],
                ["qid", "docid", "raw", "read", "scored"],
            )

    return run


def _found(index: Index, terms: DataFrame, k: int, k1: float, b: float) -> DataFrame:
    """What _searching gives of terms(qid, term), which go to all tasks. The only shuffle is of the postings of these terms,
    packed by block: it does not grow with the number of queries that share a term."""
    spark = index.postings.sparkSession
    context = spark.sparkContext
    judged = _judged(index, terms, k, k1, b).toArrow().sort_by([("term", "ascending"), ("qid", "ascending")]).combine_chunks()
    one = lambda c: judged.column(c).combine_chunks()
    names, qids = pc.unique(one("term")), pc.unique(one("qid"))
    whose = pc.index_in(one("qid"), value_set=qids).to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.searchsorted(pc.index_in(one("term"), value_set=names).to_numpy(zero_copy_only=False), np.arange(len(names) + 1))
    tau, rest = np.full(len(qids), -np.inf), np.zeros(len(qids))
    tau[whose] = pc.fill_null(one("tau"), -np.inf).to_numpy(zero_copy_only=False)
    rest[whose] = one("rest").to_numpy(zero_copy_only=False)
    aside = one("set_aside").to_numpy(zero_copy_only=False).astype(bool)
    shared = context.broadcast((qids, first, whose, one("idf").to_numpy(zero_copy_only=False), aside, tau, rest, index.mean or 1.0))
    numbers = spark.createDataFrame(pa.table({"term": names.cast(pa.string()), "number": pa.array(np.arange(len(names)).astype(np.int32))}))
    hits = index.postings.select("term", "block", "docs", "tfs").join(F.broadcast(numbers), "term").select("block", "number", "docs", "tfs").mapInArrow(_gathered, _GATHERED)
    packed = hits.unionByName(index.docs.select("docno", "docid", "len").mapInArrow(_gathered_docs, _GATHERED))
    kind = terms.schema["qid"].dataType.simpleString()
    in_order = packed.repartition("block").sortWithinPartitions("block")
    return in_order.mapInArrow(_searching(shared, k, k1, b), f"qid {kind}, docid string, raw double, read long, scored long")


def candidates(index: Index, queries: DataFrame, k: int, k1: float, b: float) -> DataFrame:
    """(qid, docid, raw, read, scored): documents that may be among the k best of a query, with their sums, and rows that say
    how many pairs of queries and documents were read in part and scored in full. Queries of more than BROADCAST_TERMS
    terms in all are searched in groups."""
    terms = checkpointed(queries.select("qid", F.explode(index.cut("query")).alias("term")).distinct())
    groups = -(-terms.count() // BROADCAST_TERMS)
    if groups <= 1:
        return _found(index, terms, k, k1, b)
    groups *= 2
    each = [terms.where(F.pmod(F.xxhash64("qid"), F.lit(groups)) == i) for i in range(groups)]
    return reduce(DataFrame.unionByName, (_found(index, some, k, k1, b) for some in each))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    scored = found.where("read is null").select("qid", "docid", F.round("raw", 6).alias("score"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "docid")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "docid", "rank", "score")


def search(index: Index, queries: DataFrame, k: int = 200, k1: float = 0.82, b: float = 0.68) -> DataFrame:
    """(qid, docid, rank, score): the k best documents of each of queries(qid, query), as bm25.top_k gives them."""
    return _ranked(candidates(index, queries, k, k1, b), k)


def search_counted(index: Index, queries: DataFrame, k: int = 200, k1: float = 0.82, b: float = 0.68) -> tuple[DataFrame, DataFrame]:
    """search(), and one row of what it read: pairs of queries and documents that there are, that were read in part, and
    that were scored in full."""
    found = checkpointed(candidates(index, queries, k, k1, b))
    of = lambda x: F.coalesce(F.sum(x), F.lit(0)).alias(x)
    return _ranked(found, k), found.agg(F.lit(queries.count() * index.n).alias("pairs"), of("read"), of("scored"))


def phrases(index: Index, asked: DataFrame) -> DataFrame:
    """(pid, docid, n): how often documents hold the tokens of asked(pid, phrase), one after the other. Blocks and then
    documents that lack one of the terms go before positions are looked at; a phrase without tokens is in none."""
    each = asked.select("pid", F.posexplode(index.cut("phrase")).alias("at", "term"))
    terms = checkpointed(each.groupBy("pid", "term").agg(F.collect_list("at").alias("ats")))
    per = terms.groupBy("pid").agg(F.count("*").alias("terms"), F.sum(F.size("ats")).alias("places"))
    small = F.broadcast if terms.count() <= BROADCAST_TERMS else lambda df: df
    every = lambda *key: F.count("*").over(Window.partitionBy(*key)) == F.col("terms")
    # a block may lie in two rows of a term, so terms are told apart
    blocks = index.postings.select("term", "block").distinct().join(small(terms), "term").join(small(per), "pid")
    blocks = blocks.withColumn("_all", every("pid", "block")).where("_all").drop("_all")
    hits = index.postings.select("term", "block", "docs", "places").join(blocks.withColumnRenamed("places", "needed"), ["term", "block"])
    in_docs = hits.select("pid", "ats", "terms", "needed", "block", F.explode(F.arrays_zip("docs", "places")).alias("p"))
    in_docs = in_docs.select("pid", "ats", "terms", "needed", _docno(F.col("block"), F.col("p.docs")).alias("docno"), F.col("p.places").alias("places"))
    in_docs = in_docs.withColumn("_all", every("pid", "docno")).where("_all")
    begins = F.explode(F.flatten(F.transform("ats", lambda a: F.transform("places", lambda p: p - a)))).alias("start")
    whole = in_docs.select("pid", "docno", "needed", begins).groupBy("pid", "docno", "needed", "start").agg(F.count("*").alias("n")).where("n = needed")
    found = whole.groupBy("pid", "docno").agg(F.count("*").alias("n"))
    return found.join(index.docs.select("docno", "docid"), "docno").select("pid", "docid", "n")
