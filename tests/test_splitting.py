"""Numbered lines and JSON arrays, in one task and in many."""

import gzip
import json
import random

import pytest

from docloom.sources import readers
from docloom.sources.splitting import json_array


@pytest.fixture(params=[97, 1000, 128 << 20])
def ranges(spark, request):
    """Sets how many bytes a task reads."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(request.param))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield request.param
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_line_numbers(spark, tmp_path, ranges):
    rnd = random.Random(1)
    want = []
    for f in range(3):
        lines = ["x" * rnd.choice([0, 1, 30, 200]) + str(i) for i in range(rnd.choice([1, 50]))]
        (tmp_path / f"{f}.txt").write_text("\n".join(lines) + ("\n" if f else ""))
        want += [(n, line, f"{f}.txt") for n, line in enumerate(lines, 1)]
    got = [(r.line_no, r.line, r.path.rsplit("/", 1)[1]) for r in readers.lines_numbered(spark, str(tmp_path)).collect()]
    assert sorted(got, key=lambda r: (r[2], r[0])) == want


def records(rnd, n):
    odd = ['"', "\\", "}", "{", "]", "[", ",", "\n", "é", "\\\"}", " ", "x" * 150]
    some = lambda: "".join(rnd.choice(odd) for _ in range(rnd.randint(0, 6)))
    return [{"id": i, "text": some(), "more": {some(): [{"a": some()}, [], {}]}} for i in range(n)]


def test_arrays(spark, tmp_path, ranges):
    rnd = random.Random(ranges)
    want = []
    for f, form in enumerate([{"indent": 2}, {"separators": (",", ":")}, {"ensure_ascii": False}, {}]):
        rows = records(rnd, rnd.choice([1, 7, 60]))
        want += rows
        text = json.dumps(rows, **form)
        (tmp_path / f"{f}.json").write_text(" \n" * (f % 2) + text + "\n" * f, encoding="utf-8")
    with gzip.open(tmp_path / "z.json.gz", "wt") as f:
        f.write(json.dumps(more := records(rnd, 20)))
    want += more
    (tmp_path / "none.json").write_text(" [ ] ")
    (tmp_path / "lines.json").write_text('{"id": -1, "text": "line"}\n')
    files = [str(p) for p in tmp_path.iterdir() if p.name != "lines.json"]
    got = json_array(spark, files)
    key = lambda x: json.dumps(x, sort_keys=True)
    assert sorted(map(key, (json.loads(r.text) for r in got.collect()))) == sorted(map(key, want))
    if ranges == 97:
        assert got.where("path like '%0.json'").rdd.getNumPartitions() > 10
    both = readers.json_records(spark, str(tmp_path), "id long, text string").collect()
    assert sorted((r.id, r.text) for r in both) == sorted([(-1, "line"), *((x["id"], x["text"]) for x in want)])
    assert readers.json_records(spark, str(tmp_path)).count() == len(want) + 1


@pytest.mark.parametrize("text", ['[{"a": 1}', '[{"a": 1}, {"b": ]', '[{"a": "x}]', '[{"a": 1}] 7', '[{"a" 1}]'])
def test_torn_arrays(spark, tmp_path, text):
    (tmp_path / "torn.json").write_text(text)
    with pytest.raises(Exception, match="bad JSON.*torn.json"):
        readers.json_records(spark, str(tmp_path / "torn.json")).collect()
