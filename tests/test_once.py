"""Keys that come again, in the same file, in a later one, or in a later run."""

import json
import os

from docloom.streaming.once import append_once


def test_each_key_once(spark, tmp_path):
    (tmp_path / "in").mkdir()

    def put(name, rows, time):
        path = tmp_path / "in" / name
        path.write_text("\n".join(json.dumps(r) for r in rows))
        os.utime(path, (time, time))

    def run(known=None):
        append_once(spark, str(tmp_path / "in"), "id string, n long, t timestamp", str(tmp_path / "out"), str(tmp_path / "state"), "id", known)
        return sorted((str(r.id), r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    put("b.json", [{"id": "x", "n": 5, "t": "2020-01-02T03:04:05.678901Z"}, {"id": "x", "n": 4}, {"id": None, "n": 1}], 1000)
    put("a.json", [{"id": "x", "n": 1}, {"id": "y", "n": 2}, {"id": "old", "n": 3}], 2000)
    known = spark.createDataFrame([("old",), (None,)], "id string")
    assert run(known) == [("None", 1), ("x", 4), ("y", 2)]
    assert run(known) == [("None", 1), ("x", 4), ("y", 2)]
    put("c.json", [{"id": "y", "n": 9}, {"id": "z", "n": None, "t": "2020-01-02T03:04:05.678901Z"}, {"id": None, "n": 9}, {"id": "old", "n": 9}], 500)
    assert run(known) == [("None", 1), ("x", 4), ("y", 2), ("z", None)]
    assert spark.read.parquet(str(tmp_path / "out")).where("id = 'z'").selectExpr("date_format(t, 'ss.SSSSSS') as t").first().t == "05.678901"
