import gzip
import json

import pytest
import zstandard
from pyspark.sql import functions as F

from tokenloom.functions.measures import inclusive_input
from tokenloom.operators import rollups
from tokenloom.sources import logs, transcripts


def record(message, output, block=None, model="m1", **usage):
    return {"type": "assistant", "sessionId": "s1", "timestamp": "2026-09-16T05:00:00.123456789Z", "cwd": "/home/x/proj/", "apiBlockIndex": block, "message": {"id": message, "model": model, "usage": {"output_tokens": output, **usage}}}


LINES = [
    record("a", 5, 0, input_tokens=3, cache_read_input_tokens=100, cache_creation_input_tokens=10, cache_creation={"ephemeral_5m_input_tokens": 4, "ephemeral_1h_input_tokens": 6}),
    record("a", 40, 1, input_tokens=3, cache_read_input_tokens=100, cache_creation_input_tokens=10),
    record("b", 7.0, input_tokens="9", cache_creation_input_tokens=8, cache_creation={"ephemeral_5m_input_tokens": 1}),
    record("c", 1.5, input_tokens=3),
    record("d", 2, model="<synthetic>"),
    {"type": "user", "message": {"output_tokens": 1}},
]
BODY = "\n".join([*map(json.dumps, LINES), "", "{broken", '{"a": NaN}', '{"type": "assistant", "message"']).encode()


@pytest.mark.parametrize("suffix", ["", ".gz", ".zst"])
def test_lines_and_requests(spark, tmp_path, suffix):
    pack = {"": lambda b: b, ".gz": lambda b: gzip.compress(b[:200]) + gzip.compress(b[200:]), ".zst": lambda b: zstandard.compress(b[:200]) + zstandard.compress(b[200:])}[suffix]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / f"s1.jsonl{suffix}").write_bytes(pack(BODY))
    lines = logs.read_lines(spark, str(tmp_path))
    states = {r["state"]: r["n"] for r in lines.groupBy("state").agg(F.count("*").alias("n")).collect()}
    assert states == {"record": 6, "blank": 1, "malformed": 2, "pending": 1}
    for r in lines.collect():
        assert r["line"] is None or BODY[r["offset"] : r["offset"] + r["length"]].decode() == r["line"]
    made = transcripts.requests(transcripts.attributed(transcripts.observations(lines)))
    got = {r["request"].removeprefix("m:"): r.asDict() for r in made.collect()}
    assert set(got) == {"a", "b"}
    assert (got["a"]["output"], got["a"]["revisions"], got["a"]["owner"], got["a"]["project"]) == (40, 2, "s1", "proj")
    assert (got["a"]["cache_write_unspecified"], got["b"]["cache_write_unspecified"], got["b"]["output"]) == (10, 8, 7)
    assert {str(r["date"]) for r in rollups.daily(made, "last_seen", "America/Los_Angeles").collect()} == {"2026-09-15"}
    assert made.select(inclusive_input().alias("i")).agg(F.sum("i")).first()[0] == 3 + 100 + 10 + 8  # a count written as text is absent


def test_twins_and_damage(spark, tmp_path):
    (tmp_path / "x.jsonl").write_bytes(b'{"a": 1}\n')
    (tmp_path / "x.jsonl.gz").write_bytes(gzip.compress(b'{"b": 1}\n'))
    (tmp_path / "y.jsonl.gz").write_bytes(gzip.compress(b'{"c": 1}\n' * 9)[:-6])
    (tmp_path / "z.txt").write_bytes(b"no log")
    lines = logs.read_lines(spark, str(tmp_path)).collect()
    assert [r["line"] for r in lines if r["locator"].endswith("x.jsonl")] == ['{"a": 1}']
    assert [r["state"] for r in lines if r["locator"].endswith("y.jsonl")][-1] == "failed"
    assert logs.manifest(logs.read_lines(spark, str(tmp_path))).count() == 2
    (tmp_path / "w.jsonl").write_bytes(b"{\n{\n")
    lost = logs.losses(logs.manifest(logs.read_lines(spark, str(tmp_path))))
    assert sorted(map(tuple, lost.collect())) == [("failed", 1, 1), ("malformed", 1, 2)]
    (tmp_path / "none").mkdir()
    assert logs.read_lines(spark, str(tmp_path / "none")).count() == 0
