"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, the units that follow them, and names are replaced by typed placeholders, so a question with other values
has the same template. Windows of eight template tokens of all documents are hash-joined with those of the
benchmark. Hits on one diagonal of a document and an item (the same distance between their places) are one run. A
stretch of a run, from anywhere to anywhere, is a match if its hits cover `min_tokens` tokens, or the whole item where
it is shorter, and its slots are consistent: each value of the item stands for one value of the document over the
stretch; a verbatim copy maps each value to itself. A stretch with fewer than four words that agree says too little and
must be verbatim. So one value changed later, or in one place, does not hide the text around it.

Digits within a word are part of it. A name is a capitalised word. In an item, those that no lower-case letter, digit
or one of , ; : and a blank precede may begin a sentence only: its windows are read with them as names and as words,
the first word and the others apart. Items of four to seven tokens are searched for as one window of their own length; shorter ones
tell nothing and are not. Null texts and null items match nothing. Repeated rows are judged together by (doc_id, text);
null ids are judged too. Equal hits of several items give a row each; texts that share an item_id are items of their
own, of which one row is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import materialise

WINDOW, MIN_TOKENS, LEAST_WORDS, LEAST_ITEM = 8, 13, 4, 4
#: The most benchmark windows, and keys of documents with hits, that are broadcast (24 bytes each); beyond it the joins
#: are shuffled.
MOST_BROADCAST = 2_000_000
MARK = "\x02"
#: Units that may follow a number (fixed values).
UNITS = "km|cm|mm|m|kg|g|mg|lbs?|oz|l|ml|miles?|feet|foot|ft|inch(?:es)?|hours?|hrs?|minutes?|mins?|seconds?|days?|weeks?|months?|years?|dollars?|euros?|pounds?|cents?|percent|degrees?|mph|kmh|%|€|\\$|£"
_NAME = r"(?<![\p{L}\p{N}])(\p{Lu}[\p{Ll}]+)"
_INITIAL = r"(?<![\p{L}\p{N}])(?<![\p{Ll}\p{N},;:] )(\p{Lu}[\p{Ll}]+)"


def tokens(text: Column, initials: bool = False) -> Column:
    """Template tokens in order; a placeholder is MARK, its type, and the value it stands for. With initials, names that
    may only begin a sentence are of type i."""
    named = F.regexp_replace(F.regexp_replace(text, _INITIAL, f"{MARK}i$1") if initials else text, _NAME, f"{MARK}p$1")
    joined = F.regexp_replace(named, r"(?<=[0-9])[.,](?=[0-9])", "\x03")
    numbered = F.regexp_replace(joined, r"(?<![\p{L}\p{N}])[$€£]?([0-9][0-9\x03]*+)(?:\s?(" + UNITS + r")(?![\p{L}\p{N}]))?(?!\p{L})", f" {MARK}n$1 {MARK}u$2 ")
    whole = F.when(text.rlike("[0-9]"), numbered).otherwise(named)
    return F.filter(F.split(F.lower(whole), r"[^\p{L}\p{N}\x02\x03]+"), lambda t: (t != "") & (t != f"{MARK}u"))


def _template(t: Column) -> Column:
    return F.when(t.startswith(MARK), F.substring(t, 1, 2)).otherwise(t)


def _readings(toks: Column) -> Column:
    """The ways to read an item's names of type i, as names or as words: the first token and the others apart."""
    word = lambda t: F.substring(t, 3, 1 << 30)
    name = lambda t: F.concat(F.lit(f"{MARK}p"), word(t))

    def read(first, others):
        return F.transform(toks, lambda t, i: F.when(~t.startswith(f"{MARK}i"), t).when(i == 0, first(t)).otherwise(others(t)))

    return F.array_distinct(F.array(*(read(a, b) for a in (name, word) for b in (name, word))))


def windows(rows: DataFrame, keep: list[str], toks: Column, size: int = WINDOW, values: bool = False) -> DataFrame:
    """keep, pos (from 0) and h for each template window of size tokens, or with values for each window of the tokens
    themselves; a window's hash comes from those of its parts.

    Each level is a column of its own, as an expression that names its operand several times is evaluated as often."""
    got = rows.withColumn("_toks", toks).withColumn("_h1", F.transform("_toks", lambda t: F.xxhash64(t if values else _template(t))))
    joined = lambda one, two, span, more: F.zip_with(F.slice(one, 1, more), F.slice(two, span + 1, more), lambda a, b: F.xxhash64(a, b))
    span = 1
    while span * 2 <= size:
        h = f"_h{span}"
        got = got.withColumn(f"_h{2 * span}", joined(h, h, span, F.greatest(F.size(h) - span, F.lit(0))))
        span *= 2
    h = f"_h{span}"
    while span < size:  # the powers of two that size is made of
        part = 1 << ((size - span).bit_length() - 1)
        got = got.withColumn(f"_w{span + part}", joined(h, f"_h{part}", span, F.greatest(F.size(h) - part, F.lit(0))))
        span += part
        h = f"_w{span}"
    # outer: else the hashes are computed once more to filter on their number
    return got.select(*keep, F.posexplode_outer(h).alias("pos", "h"))


def contaminated(docs: DataFrame, benchmark: DataFrame, min_tokens: int = MIN_TOKENS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(row_key, doc_id, item_id, n_windows, first_token, n_slots) per document and item that match; row_key is the
    64-bit hash of the row's id and text."""
    few = lambda df: F.broadcast(df) if df.limit(most_broadcast + 1).count() <= most_broadcast else df
    raw = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    base = raw.withColumn("row_key", F.xxhash64("doc_id", "text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), tokens(F.col(item_text_col).cast("string"), initials=True).alias("item_toks"))
    items = items.where(F.size("item_toks") >= LEAST_ITEM).distinct().withColumn("item_key", F.xxhash64("item_id", "item_toks"))
    words = F.size(F.filter("item_toks", lambda t: ~t.startswith(MARK) | t.startswith(f"{MARK}i")))
    read = items.select("item_key", F.size("item_toks").alias("n"), (words >= LEAST_WORDS).alias("worded"), F.explode(_readings(F.col("item_toks"))).alias("reading"))
    hits = None
    # items that can match verbatim alone are met by the values too: a page of numbers is not met at every number
    exact = ~F.col("worded")
    for n, plain in sorted({(min(r.n, WINDOW), not r.worded) for r in read.select("n", "worded").distinct().collect()} | {(WINDOW, False)}):
        want = windows(read.where((F.col("n") >= n if n == WINDOW else F.col("n") == n) & (exact if plain else ~exact)), ["item_key"], F.col("reading"), n, plain)
        want = few(want.where("h is not null").select("item_key", F.col("pos").alias("item_pos"), "h").distinct())
        have = windows(base, ["row_key"], tokens(F.col("text")), n, plain)
        met = have.join(want, "h").select("row_key", "item_key", (F.col("pos") - F.col("item_pos")).alias("shift"), "item_pos").distinct()
        hits = met if hits is None else hits.unionByName(met)
    runs = hits.groupBy("row_key", "item_key", "shift").agg(F.collect_list("item_pos").alias("at"))
    size, least = F.least(F.lit(WINDOW), F.size("item_toks")), F.greatest(F.lit(1), F.least(F.lit(min_tokens), F.size("item_toks")) - (WINDOW - 1))
    runs = runs.join(items, "item_key").withColumns({"least": least, "size": size})
    runs = materialise(runs.where(F.size("at") >= F.col("least")), "runs")
    # only the few texts with runs are read again, cut into tokens once a text; each run then meets its own places of them
    with_runs = base.join(few(runs.select("row_key").distinct()), "row_key", "left_semi").dropDuplicates(["row_key"])
    theirs = with_runs.select("row_key", "doc_id", F.posexplode(tokens(F.col("text"))).alias("place", "d"))
    place = F.sequence(F.array_min("at"), F.array_max("at") + F.col("size") - 1)
    mine = F.transform(place, lambda p: F.struct(p.alias("pos"), F.get("item_toks", p).alias("i"), F.array_contains("at", p).alias("starts"), F.array_contains("at", p - F.col("size") + 1).alias("ends")))
    cells = runs.select("row_key", "item_key", "item_id", "shift", "least", F.inline(mine)).withColumn("place", F.col("pos") + F.col("shift"))
    found = _stretches(cells.join(theirs, ["row_key", "place"]))
    return found.groupBy("row_key", "doc_id", "item_id").agg(F.max("n_windows").cast("long").alias("n_windows"), F.min("first_token").alias("first_token"), F.max("n_slots").alias("n_slots"))


def _stretches(cells: DataFrame) -> DataFrame:
    """The ends of stretches that match, of the places of all runs: (i, d) are an item's and a document's token, starts and
    ends tell whether a hit begins or ends there.

    Two neighbouring slots of one item value with two document values are a conflict. The longest consistent stretch up to
    a place begins behind the last first half of a conflict so far; the longest verbatim one behind the last slot whose
    values differ. What a stretch holds is what was counted up to its end, less what was counted before it began."""
    run = ["row_key", "item_key", "shift"]
    order = Window.partitionBy(*run).orderBy("pos")
    i = F.regexp_replace("i", f"^{MARK}i", f"{MARK}p")
    slot = i.startswith(MARK) & (F.substring(i, 1, 2) == F.substring("d", 1, 2))
    word = ~F.col("d").startswith(MARK) & ((F.col("i") == F.col("d")) | (F.col("i") == F.concat(F.lit(f"{MARK}i"), "d")))
    so_far = lambda c: F.sum(c.cast("int")).over(order)
    counted = cells.withColumns({"slot": slot, "value": F.when(slot, i)})
    counted = counted.withColumns({"hits": so_far(F.col("starts")), "done": so_far(F.col("ends")), "words": so_far(word), "slots": so_far(F.col("slot"))})
    here = F.struct("pos", "hits", "words", "slots")
    same = Window.partitionBy(*run, "value").orderBy("pos")
    counted = counted.withColumns({"before": F.lag(here).over(same), "d_before": F.lag("d").over(same)})
    differs = F.col("slot") & (F.col("d") != F.col("d_before"))
    counted = counted.withColumns({"cut": F.max(F.when(differs, F.col("before"))).over(order), "cut_exact": F.max(F.when(F.col("slot") & (F.col("d") != F.col("value")), here)).over(order)})
    held = lambda now, cut, what: F.col(now) - F.coalesce(F.col(f"{cut}.{what}"), F.lit(0))
    enough = lambda cut: held("done", cut, "hits") >= F.col("least")
    begin = lambda cut: F.coalesce(F.col(f"{cut}.pos") + 1, F.min("pos").over(order)) + F.col("shift")
    of = lambda cut: F.struct(held("done", cut, "hits").alias("n_windows"), begin(cut).alias("first_token"), held("slots", cut, "slots").alias("n_slots"))
    loose = F.when(enough("cut") & (held("words", "cut", "words") >= LEAST_WORDS), of("cut"))
    match = F.coalesce(loose, F.when(enough("cut_exact"), of("cut_exact")))
    return counted.select("row_key", "doc_id", "item_id", "ends", match.alias("match")).where("ends and match is not null").select("row_key", "doc_id", "item_id", "match.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that match no item."""
    taken = {c.lower() for c in docs.columns}
    name = next(n for n in (f"_bad{i}" for i in range(len(taken) + 1)) if n not in taken)
    bad = contaminated(docs, benchmark, **options).select(F.col("row_key").alias(name)).distinct()
    return docs.join(bad, F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string")) == F.col(name), "left_anti")
