"""Content of nested records: against a plain recursive walk, at any depth, and on awkward texts."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from tokenloom.operators import nested
from tokenloom.sources import records
from tokenloom.sources.dialects import MESSAGES, ROLLOUTS

RULE = nested.Content(("content", "inp\"ut"), ("usage",), 4, 12)


def compact(value):
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def walk(value, rule, found, name=None, inside=None):
    """The value without content; `inside` tells whether it is an object's or an array's member."""
    size = len(value.encode()) if isinstance(value, str) else 0
    if inside == "object" and name in rule.never:
        stub = False
    elif inside == "object" and name in rule.names:
        stub = size > rule.short if isinstance(value, str) else bool(value) and not all(isinstance(v, dict) for v in value) if isinstance(value, list) else bool(value) if isinstance(value, dict) else False
    elif inside == "object" and isinstance(value, list):
        stub = bool(value) and all(isinstance(v, str) for v in value) and sum(len(v.encode()) for v in value) > rule.long
    else:
        stub = size > rule.long and inside is not None
    if stub:
        raw = (value if isinstance(value, str) else compact(value)).encode()
        found.append(len(raw))
        return {"$b": len(raw), "$d": hashlib.sha256(raw).hexdigest()}
    if isinstance(value, dict):
        return {k: walk(v, rule, found, k, "object") for k, v in value.items()}
    return [walk(v, rule, found, None, "array") for v in value] if isinstance(value, list) else value


def made(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        return rng.choice([None, True, 0, -12, 7, "", "a:", "b,", "x" * rng.randint(1, 20), 'q"\\\n{[é', "ü" * 9, "{}"])
    if rng.random() < 0.5:
        return [made(rng, depth - 1) for _ in range(rng.randint(0, 4))]
    return {k: made(rng, depth - 1) for k in rng.sample(["content", 'inp"ut', "usage", "a", "b:", "c,"], rng.randint(0, 4))}


def strip_all(spark, texts, rule=RULE):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    got = {r["id"]: r for r in nested.stripped(rows, ["id"], "text", rule).collect()}
    assert len(got) == len(texts)
    return [got[i] for i in range(len(texts))]


def test_equals_a_recursive_walk(spark):
    rng = random.Random(5)
    things = [{"r": made(rng, rng.randint(0, 6))} for _ in range(300)]
    loose = [json.dumps(t, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])).replace(",", " ,") if "b," not in json.dumps(t) and "c," not in json.dumps(t) else json.dumps(t) for t in things]
    for thing, text, got in zip(things, loose, strip_all(spark, loose), strict=True):
        found = []
        want = walk(json.loads(text), RULE, found)
        assert json.loads(got["stripped"]) == want, text
        assert (got["stubs"], got["stubbed_bytes"]) == (len(found), sum(found))
        assert thing


def test_deep_long_and_empty(spark):
    deep = '{"a":' * 400 + '{"content":["long enough"]}' + "}" * 400
    long = compact({"content": 'y\\"\n' * 200_000, "many": list(range(20_000)), "flat": ["z" * 5] * 3})
    texts = [deep, long, "{}", "[]", "7", '""', None, "", '{"content":{}}', '{"content":[]}', '{"content":[{"content":"abcdefgh"},{}]}', '{"usage":{"content":"abcdefgh"}}']
    got = strip_all(spark, texts)
    assert [r["stubs"] for r in got] == [1, 2, 0, 0, 0, 0, 0, 0, 0, 0, 1, 1]
    assert [r["stripped"] for r in got[2:10]] == ["{}", "[]", "7", '""', None, None, '{"content":{}}', '{"content":[]}']
    assert json.loads(got[1]["stripped"])["many"][-1] == 19_999 and got[1]["stubbed_bytes"] == len(('y\\"\n' * 200_000).encode()) + len(compact(["z" * 5] * 3))


def test_no_rows_and_repeated_columns(spark):
    rows = spark.createDataFrame([], "pos long, text string")
    assert nested.stripped(rows.withColumnRenamed("pos", "id"), ["id"], "text", RULE).count() == 0


@pytest.mark.parametrize("dialect, line, want", [
    (MESSAGES, {"type": "assistant", "message": {"usage": {}}}, "usage"), (MESSAGES, {"type": "assistant", "message": {"usage": 3}}, "structure"), (MESSAGES, {"type": "assistant", "quotaLimits": [1]}, "usage"),
    (MESSAGES, {"type": "user"}, "structure"), (MESSAGES, {"type": "attachment"}, "conversation"), (MESSAGES, {"type": "progress"}, "display"), (MESSAGES, {}, "display"),
    (ROLLOUTS, {"type": "event_msg", "payload": {"type": "token_count"}}, "usage"), (ROLLOUTS, {"type": "event_msg", "payload": {"type": "error"}}, "structure"), (ROLLOUTS, {"type": "event_msg", "payload": {"type": "said"}}, "display"),
    (ROLLOUTS, {"type": "response_item", "payload": {"type": "reasoning"}}, "conversation"), (ROLLOUTS, {"type": "response_item", "payload": {"type": "call"}}, "structure"), (ROLLOUTS, {"type": "session_meta"}, "structure"),
])
def test_classes(spark, dialect, line, want):
    assert spark.range(1).select(records.class_of(dialect, F.lit(json.dumps(line))).alias("c")).first()["c"] == want


def test_captured_logs(spark):
    lines = [{"type": "assistant", "message": {"id": "m", "usage": {"output_tokens": 3}, "content": [{"type": "text", "text": "what was said, at length"}]}}, {"type": "attachment", "data": "x" * 99}]
    rows = spark.createDataFrame([("f", i, len(json.dumps(x)), "record", json.dumps(x)) for i, x in enumerate(lines)] + [("f", 9, 3, "malformed", None)], "locator string, offset long, length long, state string, line string")
    got = records.captured(rows, MESSAGES).collect()
    assert len(got) == 1 and got[0]["class"] == "usage" and got[0]["stubbed_bytes"] == len("what was said, at length")
    kept = json.loads(got[0]["stripped"])["message"]
    assert kept["usage"] == {"output_tokens": 3} and kept["content"][0]["type"] == "text" and kept["content"][0]["text"]["$b"] == 24
    assert {r["class"]: r["records"] for r in records.volumes(rows, MESSAGES).collect()} == {"usage": 1, "conversation": 1}
