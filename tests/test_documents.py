"""Documents: order, JSON and text; selectors, scopes and agents; changed sources."""

import json

import pytest
from pyspark.sql import functions as F

from tokenloom.operators import selection
from tokenloom.sinks import documents
from tokenloom.sources import changes, logs


def test_orders(spark):
    rows = spark.createDataFrame([("b", "claude"), (None, "pi"), ("a", "pi"), (None, "claude"), (None, None)], "thread string, agent string")
    got = [tuple(r) for r in rows.orderBy(*documents.sessions_order()).collect()]
    assert got == [(None, "claude"), (None, "pi"), (None, None), ("a", "pi"), ("b", "claude")]
    codes = spark.createDataFrame([("thread-orphan",), ("zzz",), ("counter-gap",), ("conflicting-reread",), ("counter-reset",)], "code string")
    got = [r[0] for r in codes.orderBy(*documents.diagnostics_order()).collect()]
    assert got == ["conflicting-reread", "counter-reset", "counter-gap", "thread-orphan", "zzz"]


def test_json_and_text(spark, tmp_path):
    rows = spark.sql("SELECT DATE'2024-01-02' AS date, 1234567L AS n, CAST(NULL AS BIGINT) AS m UNION ALL SELECT NULL, 0L, 5L UNION ALL SELECT DATE'2024-01-01', 1L, 2L")
    order = documents.daily_order()
    made = json.loads(documents.document("daily", {"zone": "UTC"}, rows, order))
    assert made["query"] == {"zone": "UTC"}
    assert made["rows"] == [{"date": "2024-01-01", "n": 1, "m": 2}, {"date": "2024-01-02", "n": 1234567, "m": None}, {"date": None, "n": 0, "m": 5}]
    with pytest.raises(documents.TooManyRows):
        documents.document("daily", {}, rows, order, most=2)
    documents.write_json(rows, order, str(tmp_path / "json"))
    lines = [json.loads(x) for f in sorted((tmp_path / "json").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines == made["rows"]
    documents.write_text(rows, ["date", "n", "m"], order, str(tmp_path / "text"))
    text = [x for part in ("header", "rows") for f in sorted((tmp_path / "text" / part).glob("part-*")) for x in f.read_text().splitlines()]
    assert text == ["DATE | N | M", "2024-01-01 | 1 | 2", "2024-01-02 | 1,234,567 | -", "- | 0 | 5"]
    assert json.loads(documents.document("daily", {}, rows.limit(0), order))["rows"] == []


def test_selectors(spark):
    rows = [("t1", "a", "/x", True), ("t2", "b", "/x", False), ("t3", "c", "/y", False), ("t4", "c", "/z", False), ("t5", None, "/y", False), ("t1", "a", "/z", False)]
    threads = spark.createDataFrame(rows, "id string, native_id string, path string, located boolean")
    assert selection.resolve(threads, "t2") == "t2"
    assert selection.resolve(threads, "a") == "t1"
    assert selection.resolve(threads, "/x") == "t1"  # only a path, and located there
    for ambiguous in ("c", "/y"):
        with pytest.raises(selection.AmbiguousSelector):
            selection.resolve(threads, ambiguous)
    with pytest.raises(selection.UnknownSelector):
        selection.resolve(threads, "none")


def test_current_session():
    names = {"one": "ONE_ID", "two": "TWO_ID"}
    assert selection.current_session({"ONE_ID": "s1", "TWO_ID": ""}, names) == ("one", "s1")
    assert selection.current_session({"ONE_ID": "s1", "TWO_ID": "s2"}, names, ("two",)) == ("two", "s2")
    with pytest.raises(selection.AmbiguousSelector):
        selection.current_session({"ONE_ID": "s1", "TWO_ID": "s2"}, names)
    with pytest.raises(selection.UnknownSelector):
        selection.current_session({}, names)


def test_scopes(spark):
    threads = spark.createDataFrame([("a", "one"), ("b", "one"), ("c", "two"), ("d", "one")], "id string, agent string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "parent string, child string")
    ids = lambda **k: sorted(r["id"] for r in selection.covered(threads, edges, **k).collect())
    one = threads.filter(F.col("id") == "a").select("id")
    assert ids(clauses=[one]) == ["a", "b", "c"]
    assert ids(clauses=[one], scope="self") == ["a"]
    assert ids(clauses=[one], agents=("two",)) == ["c"]
    assert ids(clauses=[], everything=True, agents=("one",)) == ["a", "b", "d"]
    with pytest.raises(ValueError):
        ids(clauses=[])


def test_changed_logs(spark, tmp_path):
    for name, text in (("same", '{"a":1}\n'), ("grows", '{"a":1}\n'), ("shrinks", '{"a":1}\n{"a":2}\n'), ("goes", '{"a":1}\n')):
        (tmp_path / f"{name}.jsonl").write_text(text)

    def seen():
        found = changes.listing(spark, str(tmp_path)).join(changes.first_records(logs.read_lines(spark, str(tmp_path))), "path", "left")
        return spark.createDataFrame(found.collect(), found.schema)  # as it was then

    before = seen()
    (tmp_path / "grows.jsonl").write_text('{"a":1}\n{"a":2}\n')
    (tmp_path / "shrinks.jsonl").write_text('{"b":1}\n')
    (tmp_path / "goes.jsonl").unlink()
    (tmp_path / "comes.jsonl").write_text('{"a":1}\n')
    got = sorted((r["path"].rsplit("/", 1)[1].split(".")[0], r["change"]) for r in changes.changes(before, seen()).collect())
    assert got == [("comes", "new"), ("goes", "vanished"), ("grows", "grew"), ("shrinks", "first record changed"), ("shrinks", "truncated")]
