"""Files that many tasks read, though their rows depend on what stands before: numbered lines, and JSON arrays.

Spark's text reader cuts files into byte ranges at separators. What a range starts with follows from short summaries of the
ranges before it: how many lines they hold, or how they change the state of a JSON scanner."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Columns of a text scan: where the row's range begins, and its order within it.
_PLACE = ("_metadata.file_path as path", "_metadata.file_block_start as block", "monotonically_increasing_id() as n")
_OPENS, _ESCAPED = re.compile(r"[\[{]"), re.compile(r"\\.", re.DOTALL)
_CLOSES = re.compile(r"[\]}]")


def numbered_lines(spark: SparkSession, files: list[str]) -> DataFrame:
    """(line_no, line, path) of text files: line_no from 1 on within each file, exact for any split of the files. The
    ranges are counted in one scan; a row a range says where its numbers begin."""
    rows = spark.read.text(files).selectExpr("value as line", *_PLACE)
    sizes = rows.groupBy("path", "block").agg(F.count("*").alias("lines"), F.min("n").alias("first"))
    before = F.coalesce(F.sum("lines").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("path", "block", "first", before.alias("before")))  # a row a range
    return rows.join(starts, ["path", "block"]).select((F.col("before") + F.col("n") - F.col("first") + 1).alias("line_no"), "line", "path")


def _runs(batches) -> Iterator[tuple[tuple[str, int], str]]:
    """((path, block), text with its closing brace) of each row, in order."""
    for batch in batches:
        for path, block, text in zip(*(batch.column(c).to_pylist() for c in ("path", "block", "value"))):
            yield (path, block), text + "}"


def _turns(text: str) -> tuple[bool, int, int]:
    """Whether a text changes between inside and outside of strings, and how it changes the depth if it starts outside of
    one, or inside. It does not start within an escape: ranges and rows start after a brace."""
    parts = _ESCAPED.sub("", text).split('"')
    change = lambda some: sum(len(_OPENS.findall(p)) - len(_CLOSES.findall(p)) for p in some)
    return len(parts) % 2 == 0, change(parts[::2]), change(parts[1::2])


def _summaries(batches):
    at, flips, deltas = None, False, [0, 0]
    out = []

    def row():
        return {"path": at[0], "block": at[1], "flips": flips, "outside": deltas[0], "inside": deltas[1]}

    for place, text in _runs(batches):
        if place != at:
            if at:
                out.append(row())
            at, flips, deltas = place, False, [0, 0]
        turn, even, odd = _turns(text)
        # a range that starts outside of a string is inside of one here if it has flipped
        deltas[0] += odd if flips else even
        deltas[1] += even if flips else odd
        flips ^= turn
    if at:
        out.append(row())
    yield pa.RecordBatch.from_pylist(out, pa.schema([("path", pa.string()), ("block", pa.int64()), ("flips", pa.bool_()), ("outside", pa.int64()), ("inside", pa.int64())]))


def _elements(starts: dict[tuple[str, int], tuple[bool, int, bool]]):
    """Elements that lie within a range (part null), and the pieces of those that do not (part 0 where one begins, 1 where
    it goes on)."""

    def run(batches):
        schema = pa.schema([("path", pa.string()), ("block", pa.int64()), ("part", pa.int32()), ("text", pa.string())])
        out, size = [], 0
        at, inside, depth, last, held, goes_on = None, False, 0, False, [], False

        def rest():
            """What a range ends with: a piece, or the end of the array."""
            text = "".join(held)
            if last:
                whole = re.fullmatch(r"\s*(\[\s*)?\]\s*\}", text)
                if goes_on or inside or depth != -1 or not whole:
                    raise ValueError(f"bad JSON: the array of {at[0]} does not end")
            elif text.strip(" \t\r\n,"):
                out.append({"path": at[0], "block": at[1], "part": int(goes_on), "text": text})

        for place, text in _runs(batches):
            if place != at:
                if at:
                    rest()
                at, held = place, []
                inside, depth, last = starts[place]
                goes_on = depth > 1 or inside
                opened = depth > 0
            turn, even, odd = _turns(text)
            depth += odd if inside else even
            inside ^= turn
            held.append(text)
            if not inside and depth == 1:
                whole, held = "".join(held), []
                if not opened:
                    whole, opened = re.sub(r"^\s*\[", "", whole), True
                out.append({"path": at[0], "block": at[1], "part": 1 if goes_on else None, "text": whole})
                size, goes_on = size + len(whole), False
                if size > 1 << 20:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, size = [], 0
        if at:
            rest()
        yield pa.RecordBatch.from_pylist(out, schema)

    return run


def json_array(spark: SparkSession, files: list[str]) -> DataFrame:
    """(path, text): the elements of files that each hold one JSON array of objects, read in as many tasks as they have
    ranges. A file that is not such an array is an error that names it, here or where an element is parsed.

    Rows end at closing braces. The first scan sums up each range: whether it ends inside a string, and how deep, for both
    states that it may start in; these rows, one a range, give all starts. The second cuts the elements; pieces of those
    that lie in several ranges are put together by file and place."""
    rows = spark.read.option("lineSep", "}").text(files).selectExpr("value", *_PLACE[:2])
    ranges = rows.mapInArrow(_summaries, "path string, block long, flips boolean, outside long, inside long").collect()
    starts: dict[tuple[str, int], tuple[bool, int, bool]] = {}
    path, inside, depth = None, False, 0
    ordered = sorted(ranges, key=lambda r: (r.path, r.block))
    for r, after in zip(ordered, [*ordered[1:], None]):
        if r.path != path:
            path, inside, depth = r.path, False, 0
        starts[r.path, r.block] = inside, depth, after is None or after.path != path
        depth += r.inside if inside else r.outside
        inside ^= r.flips
    got = rows.mapInArrow(_elements(starts), "path string, block long, part int, text string")
    pieces = got.where("part is not null")
    number = F.sum(F.when(F.col("part") == 0, 1).otherwise(0)).over(Window.partitionBy("path").orderBy("block", F.desc("part")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda p: p["text"])
    joined = pieces.withColumn("number", number).groupBy("path", "number").agg(F.array_join(parts, "").alias("text"))
    opened = F.regexp_replace("text", r"^\s*\[", "")  # of the first element, if it lies in several ranges
    whole = got.where("part is null").select("path", "text").unionByName(joined.select("path", opened.alias("text")))
    return whole.select("path", F.regexp_replace("text", r"^[\s,]+", "").alias("text"))
