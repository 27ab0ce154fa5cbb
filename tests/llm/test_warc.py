"""Revisits against a scan of all captures."""

import gzip
import random

from docloom.llm.warc import PERMITTED, RECORD, canonical, read_warc, read_warcs, resolve, with_bodies

URLS = ["http://www.A.com/x/", "https://a.com/x", "http://a.com:80/x#top", "http://b.org/p?b=2&a=1", "http://b.org/p?a=1&b=2", None]


def test_canonical(spark):
    from pyspark.sql import functions as F

    got = {r.u: r.c for r in spark.createDataFrame([(u,) for u in URLS], "u string").select("u", canonical(F.col("u")).alias("c")).collect()}
    assert {got[u] for u in URLS[:3]} == {"a.com/x"} and {got[u] for u in URLS[3:5]} == {"b.org/p?a=1&b=2"} and got[None] is None


def test_as_of(spark):
    rnd = random.Random(4)
    key = {URLS[0]: 1, URLS[1]: 1, URLS[2]: 1, URLS[3]: 2, URLS[4]: 2}
    rows = []
    for i in range(600):
        url = rnd.choice(URLS[:1] * 6 + URLS)
        h = {rnd.choice(["ETag", "etag"]): rnd.choice(['"1"', 'W/"1"', '"2"'])} if rnd.random() < 0.7 else {"Last-Modified": rnd.choice(["x", "y"])}
        if rnd.random() < 0.1:
            h = {}
        h |= {"Date": f"t{i}", "X-Other": f"o{i}"}
        rows.append((i, rnd.choice(["response", "revisit"]), url, rnd.choice([rnd.randrange(300), None]) if i % 40 == 0 else rnd.randrange(300), h, None if i % 50 == 0 else f"body{i}"))
    rows.append((None, "revisit", URLS[0], 500, None, None))
    df = spark.createDataFrame(rows, RECORD)
    got = {r.record_id: r for r in resolve(df, slots=16).collect()}
    low = lambda h: {k.lower(): v for k, v in (h or {}).items()}
    bare = lambda x: x[2:] if x and x.startswith("W/") else x
    revisits = [r for r in rows if r[1] == "revisit"]
    assert len(got) == len(revisits)
    for rid, _, url, ts, h, _ in revisits:
        past = [r for r in rows if r[1] == "response" and ts is not None and r[3] is not None and key.get(url) is not None and key.get(r[2]) == key.get(url) and r[3] < ts]
        r = got[rid]
        if not past:
            assert r.status == "no_response" and r.response_id is None
            continue
        best = max(past, key=lambda p: (p[3], p[0]))
        mine, theirs = low(h), low(best[4])
        if "etag" in mine:
            ok = bare(mine["etag"]) == bare(theirs.get("etag"))
        elif "last-modified" in mine:
            ok = mine["last-modified"] == theirs.get("last-modified")
        else:
            ok = True
        assert r.status == ("resolved" if ok else "validator_mismatch")
        if ok:
            assert r.response_id == best[0] and r.headers == {**theirs, **{k: v for k, v in mine.items() if k in PERMITTED}}
    assert resolve(df.limit(0)).collect() == []
    bodies = with_bodies(resolve(df), df).where("status = 'resolved'").first()
    assert bodies.body == rows[bodies.response_id][5]


def test_files(spark, tmp_path):
    def record(kind, url, date, http):
        return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\nWARC-Date: {date}\r\nContent-Length: {len(http)}\r\n\r\n{http}\r\n\r\n".encode()

    a = record("response", "http://a.com/x", "2024-01-01T00:00:00Z", 'HTTP/1.1 200 OK\r\nETag: "1"\r\nDate: d1\r\n\r\nhello\r\n\r\nworld')
    b = record("revisit", "http://www.a.com/x/", "2024-01-02T00:00:00Z", 'HTTP/1.1 304 Not Modified\r\nETag: "1"\r\nDate: d2\r\n\r\n')
    (tmp_path / "w.warc.gz").write_bytes(gzip.compress(a) + gzip.compress(b))
    assert [r["kind"] for r in read_warc((tmp_path / "w.warc.gz").read_bytes())] == ["response", "revisit"]
    records = read_warcs(spark, str(tmp_path / "*.gz"))
    r = with_bodies(resolve(records), records).first()
    assert (r.status, r.body, r.headers) == ("resolved", "hello\r\n\r\nworld", {"etag": '"1"', "date": "d2"})


def test_header_names_that_differ_in_case(spark):
    rows = [
        (1, "response", "http://a.com/x", 1, {"ETag": '"1"', "etag": '"1"', "X-A": "2", "x-a": "1", "Vary": None}, "b"),
        (2, "revisit", "http://a.com/x", 2, {"ETAG": '"1", "1"', "Date": "d", "date": "c"}, None),
        (3, "revisit", None, 2, {"ETag": '"1"'}, None),
        (4, "revisit", "http://a.com/x", None, None, None),
    ]
    got = {r.record_id: r for r in resolve(spark.createDataFrame(rows, RECORD)).collect()}
    assert got[2].status == "resolved" and got[2].headers == {"etag": '"1", "1"', "x-a": "1, 2", "vary": None, "date": "c, d"}
    assert [got[k].status for k in (3, 4)] == ["no_response"] * 2 and got[3].headers is None and len(got) == 3
