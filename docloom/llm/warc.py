"""Not-modified revisits of web archives, resolved by an as-of join.

A revisit record says that a server answered "not modified". It is resolved to the latest full response of the same
canonical URL captured strictly earlier, if the validators agree: the ETag if the revisit has one (compared weakly:
a leading W/ is ignored), else Last-Modified if it has that, else nothing says otherwise and it holds. The resolved
record has the response's headers, except that those a 304 may update replace the stored ones, and its body.

The as-of join never gathers a URL in one task: captures are cut into time slots, the last response of each (URL,
slot) is found by a partial aggregation, a window over slots alone carries it on, and revisits look only at their own
slot and at what is carried to it. A URL with a third of all captures is spread over its slots.

Canonical URL: scheme and host in lower case, no "www.", default port, fragment or trailing slash, query parameters
sorted. Records without a URL or time resolve to nothing. Of responses with the same URL and time the one with the
greatest id counts; null ids come first. Repeated revisits are resolved each. Null headers are no
headers. Values of header names that differ in case only are joined by ", " in their order. A null or empty body is a
body.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Header fields that a 304 answer may update (fixed values, RFC 9110, 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
SLOTS = 4096
RECORD = "record_id long, kind string, url string, ts long, headers map<string,string>, body string"


def canonical(url: Column) -> Column:
    """The URL that captures are compared by, without its scheme."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, "^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    ordered = F.array_join(F.array_sort(F.split(query, "&")), "&")
    return F.concat(host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), ordered)))


def resolve(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(record_id, url_key, ts, response_id, response_ts, status, headers) per revisit of records(RECORD); status is
    resolved, validator_mismatch or no_response. Bodies are fetched by response_id with with_bodies()."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    base = records.select("record_id", "kind", canonical(F.col("url")).alias("url_key"), "ts", F.coalesce("headers", none).alias("headers"))
    low, high = base.agg(F.min("ts"), F.max("ts")).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) // slots))
    base = base.withColumn("slot", F.floor((F.col("ts") - F.lit(low or 0)) / width))
    full = F.struct("ts", "record_id", "headers")
    answers = base.where("kind = 'response' and url_key is not null and ts is not null")
    last = answers.select("url_key", "slot", "ts", "record_id", F.map_entries("headers").alias("headers")).groupBy("url_key", "slot").agg(F.max(full).alias("last"))
    # records without a URL or time have nothing to look for, and would all be of one key
    lost = base.where("kind = 'revisit' and (url_key is null or ts is null)")
    asked = base.where("kind = 'revisit' and url_key is not null and ts is not null")
    # what earlier slots hand on, for slots with revisits
    marks = last.select("url_key", "slot", "last").unionByName(asked.select("url_key", "slot").distinct().withColumn("last", F.lit(None).cast(last.schema["last"].dataType)))
    marks = marks.groupBy("url_key", "slot").agg(F.max("last").alias("last"), F.count_if(F.col("last").isNull()).alias("asked"))
    before = Window.partitionBy("url_key").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.withColumn("carried", F.last("last", ignorenulls=True).over(before)).where("asked > 0").select("url_key", "slot", "carried")
    # within a slot
    own = answers.select("url_key", "slot", F.col("ts").alias("a_ts"), F.struct(F.col("ts"), F.col("record_id"), F.map_entries("headers").alias("headers")).alias("near"))
    asked = asked.withColumn("row", F.struct("record_id", "ts", F.map_entries("headers").alias("headers")))
    both = asked.select("url_key", "slot", "ts", F.lit(1).alias("is_asked"), "row", F.lit(None).cast(own.schema["near"].dataType).alias("near")).unionByName(own.select("url_key", "slot", F.col("a_ts").alias("ts"), F.lit(0).alias("is_asked"), F.lit(None).cast(asked.schema["row"].dataType).alias("row"), "near"))
    # strictly earlier: revisits come before responses of their own time; the greatest id last
    order = Window.partitionBy("url_key", "slot").orderBy("ts", F.col("is_asked").desc(), F.col("near.record_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = both.withColumn("near", F.last("near", ignorenulls=True).over(order)).where("is_asked = 1")
    got = inside.join(carried, ["url_key", "slot"], "left").select(F.col("row.record_id").alias("record_id"), "url_key", F.col("row.ts").alias("ts"), F.map_from_entries("row.headers").alias("mine"), F.coalesce("near", "carried").alias("r"))
    got = got.select("record_id", "url_key", "ts", "r", _lowered(F.map_entries("mine")).alias("mine"), _lowered(F.col("r.headers")).alias("theirs"))
    tag = lambda h: F.regexp_replace(F.try_element_at(h, F.lit("etag")), "^W/", "")
    since = lambda h: F.try_element_at(h, F.lit("last-modified"))
    mine, theirs = F.col("mine"), F.col("theirs")
    agrees = F.when(tag(mine).isNotNull(), F.coalesce(tag(mine) == tag(theirs), F.lit(False))).when(since(mine).isNotNull(), F.coalesce(since(mine) == since(theirs), F.lit(False))).otherwise(True)
    status = F.when(F.col("r").isNull(), "no_response").when(agrees, "resolved").otherwise("validator_mismatch")
    update = F.map_filter(mine, lambda k, v: k.isin(*PERMITTED))
    kept = F.map_filter(theirs, lambda k, v: ~F.map_contains_key(update, k))
    ok = status == "resolved"
    found = got.select(
        "record_id",
        "url_key",
        "ts",
        F.when(ok, F.col("r.record_id")).alias("response_id"),
        F.when(ok, F.col("r.ts")).alias("response_ts"),
        status.alias("status"),
        F.when(ok, F.map_concat(kept, update)).alias("headers"),
    )
    nothing = {c: F.lit(None).cast(found.schema[c].dataType) for c in ("response_id", "response_ts", "headers")}
    return found.unionByName(lost.select("record_id", "url_key", "ts", F.lit("no_response").alias("status")).withColumns(nothing))


def _lowered(entries: Column) -> Column:
    """A map of header names in lower case, sorted by name."""
    names = F.array_sort(F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"]))))
    values = lambda n: F.array_sort(F.filter(F.transform(F.filter(entries, lambda e: F.lower(e["key"]) == n), lambda e: e["value"]), lambda v: v.isNotNull()))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.when(F.size(values(n)) > 0, F.array_join(values(n), ", "))))


def with_bodies(resolved: DataFrame, records: DataFrame) -> DataFrame:
    """Resolved revisits with the bodies of their responses."""
    bodies = records.where("kind = 'response'").select(F.col("record_id").alias("response_id"), "body")
    return resolved.join(bodies, "response_id", "left")


def read_warc(data: bytes) -> Iterator[dict]:
    """Records of WARC bytes, gzip members or plain: fields of RECORD without ids."""
    from datetime import datetime

    raw = io.BytesIO(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)
    while line := raw.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        head = {}
        while (line := raw.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            head[k.strip().lower()] = v.strip()
        block = raw.read(int(head.get("content-length", 0)))
        http, _, body = block.partition(b"\r\n\r\n")
        lines = http.decode("latin-1").split("\r\n")
        headers: dict[str, str] = {}
        for k, _, v in (x.partition(":") for x in lines[1:]):
            if k:  # repeated fields are one list, in their order (RFC 9110, 5.3)
                headers[k.strip()] = f"{headers[k.strip()]}, {v.strip()}" if k.strip() in headers else v.strip()
        when = head.get("warc-date")
        ts = int(datetime.fromisoformat(when.replace("Z", "+00:00")).timestamp()) if when else None
        yield {"kind": head.get("warc-type"), "url": head.get("warc-target-uri"), "ts": ts, "headers": headers, "body": body.decode("utf-8", "replace")}


def read_warcs(spark, path: str) -> DataFrame:
    """RECORD for the WARC files at path, through Spark's reader; ids number the records within the order of their files."""
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, data in zip(pdf["path"], pdf["content"], strict=True):
                rows = [{"path": p, "n": i, **r} for i, r in enumerate(read_warc(bytes(data)))]
                if rows:
                    yield pd.DataFrame(rows)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    got = files.mapInPandas(run, "path string, n long, kind string, url string, ts long, headers map<string,string>, body string")
    return got.select(F.xxhash64("path", "n").alias("record_id"), "kind", "url", "ts", "headers", "body")


def captures(pages: DataFrame) -> DataFrame:
    """pages as the captures of an archive (RECORD): each page is a capture, at ts 10 * page_id, of a section of its
    domain (the last two labels of the host and the first segment of the path), whose URL is written in six ways. Of every seven pages two are full
    responses; the others are revisits, which may come before any response. A section's validators change every 40 pages.
    Of the revisits most have an ETag, one in seven Last-Modified alone, and one in seven neither. record_id is page_id."""
    page, k = F.col("page_id"), F.pmod(F.col("page_id"), F.lit(7))
    section = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*\.)?([^./?#]+\.[^./?#]+/[^/?#]*)", 1)
    host = F.when(page % 2 == 0, "http://").otherwise("https://www.")
    written = F.when(page % 3 == 0, "").when(page % 3 == 1, "/").otherwise("#top")
    version = F.floor(page / 40).cast("string")
    tag, stamp = F.concat(F.lit('"v'), version, F.lit('"')), F.concat(F.lit("t"), version)
    full = F.create_map(F.lit("ETag"), tag, F.lit("Last-Modified"), stamp, F.lit("Content-Type"), F.lit("text/html"), F.lit("Date"), F.concat(F.lit("d"), page.cast("string")))
    late = (F.lit("date"), F.concat(F.lit("u"), page.cast("string")), F.lit("x-other"), F.lit("no"))
    again = F.when(k == 5, F.create_map(F.lit("last-modified"), stamp, *late)).when(k == 6, F.create_map(*late)).otherwise(F.create_map(F.lit("etag"), F.concat(F.lit("W/"), tag), *late))
    whole = k.isin(0, 3)
    return pages.select(
        page.cast("long").alias("record_id"),
        F.when(whole, "response").otherwise("revisit").alias("kind"),
        F.concat(host, section, written).alias("url"),
        (page.cast("long") * 10).alias("ts"),
        F.when(whole, full).otherwise(again).alias("headers"),
        F.when(whole, F.col("html")).alias("body"),
    )
