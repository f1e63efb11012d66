"""Transcripts and rollouts, as files made here, to owners and totals."""

import json

import pytest
from pyspark.sql import functions as F

from tokenloom.sources import accounting, logs, rollouts, transcripts


def write(root, name, rows):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))


def said(message, output, session, minute, uuid=None, model="m1", request=None, **more):
    usage = {"input_tokens": 1, "output_tokens": output, **more.pop("usage", {})}
    body = {"sessionId": session, "uuid": uuid, "requestId": request, "timestamp": f"2026-09-16T05:{minute:02}:00Z", "cwd": "/w/proj", "message": {"id": message, "model": model, "usage": usage, **more.pop("extra", {})}}
    return {"type": "assistant", **body, **more}


@pytest.fixture
def transcript(spark, tmp_path):
    write(tmp_path, "p/one.jsonl", [
        said("a", 10, "one", 1, "u1", extra={"content": [{"type": "tool_use", "id": "call1"}]}),
        said("b", 20, "one", 2, "u2", request="r1"),
        said(None, 25, "one", 3, "u3", request="r1"),
        {**said("c", 30, "one", 4, "u4"), "isSidechain": True},
        {**said("d", 40, "one", 5, "u5"), "isSidechain": True},
        {"type": "user"},
        {**said("e", 50, "one", 6, "u6"), "isSidechain": True},
    ])
    write(tmp_path, "p/two.jsonl", [said("a", 10, "one", 1, "u1"), said("f", 60, "two", 7, "u7"), said("f", 55, "two", 7, "u8", usage={"input_tokens": 2})])
    write(tmp_path, "p/one/subagents/agent-x.jsonl", [said("a", 10, None, 8, "u9"), said("g", 70, None, 9, "u10"), {"type": "progress", "data": {"message": said("g", 70, None, 9, "u11")}}])
    write(tmp_path, "p/two/subagents/w/agent-y.jsonl", [said("h", 80, "two", 10, "u12"), said("i", 1, "two", 11, "u13", usage={"iterations": [{"type": "advisor_message", "model": "big", "input_tokens": 5, "output_tokens": 100}]})])
    write(tmp_path, "p/three.jsonl", [said("z", 5, "three", 12, "u14", model="m1"), said("z", 6, "three", 13, "u15", model="m2"), said("z", 7, "three", 13, None, model="<synthetic>")])
    return transcripts.attributed(transcripts.observations(logs.read_lines(spark, str(tmp_path))))


def test_owners_and_copies(transcript):
    rows = transcript.collect()
    copies = {(r["thread"], r["message"], r["owner"]) for r in rows if r["copy"]}
    assert copies == {("two", "a", "one"), ("one/x", "a", "one"), ("one/x", "g", "one/x")}
    inline = {r["thread"] for r in rows if r["side"]}
    assert len(inline) == 2 and all(t.startswith("one/inline-") for t in inline)


def test_requests_of_transcripts(transcript):
    got = {r["request"]: r for r in transcripts.requests(transcript).collect()}
    outputs = sorted(r["output"] for r in got.values() if r["counting"] == "counted")
    assert outputs == [5, 6, 10, 25, 30, 40, 50, 60, 70, 80, 101]  # b and the record of its request are one; f is its largest
    assert all(r["status"] == "owned" for r in got.values())
    f = next(r for r in got.values() if r["output"] == 60)
    assert f["disagree"] and f["uncached_input"] == 1 and f["revisions"] == 2
    a = next(r for r in got.values() if r["output"] == 10)
    assert (a["originals"], a["copies"], a["owner"]) == (1, 2, "one")
    assert next(r for r in got.values() if r["output"] == 101)["components"][0]["model"] == "big"


def test_order_and_split_do_not_matter(spark, transcript):
    once = sorted(map(str, transcripts.requests(transcript).drop("components").collect()))
    again = sorted(map(str, transcripts.requests(transcript.orderBy(F.rand(5)).repartition(3)).drop("components").collect()))
    assert once == again


def test_edges_of_transcripts(spark, transcript):
    sidecars = spark.createDataFrame([("one", "x", "call1")], "session string, agent string, tool_use string")
    got = {(r["kind"], r["source"], r["target"], r["proven"]) for r in transcripts.edges(transcript, sidecars).collect() if r["kind"] != "inline"}
    assert got == {("fork", "one", "two", True), ("spawn", "one", "one/x", True), ("spawn", "two", "two/y", False)}


def test_instants_do_not_follow_the_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        got = spark.sql("SELECT '2026-09-16T05:00:00.25Z' AS t").select(transcripts.utc(F.col("t").try_cast("timestamp")).cast("string")).first()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == "2026-09-16 05:00:00.25"


PARENT, CHILD = "a" * 36, "b" * 36


def used(i, c, o, total=None):
    return {"input_tokens": i, "cached_input_tokens": c, "output_tokens": o, "total_tokens": i + o if total is None else total}


def count(total, last, ordinal=None):
    return {"type": "event_msg", "ordinal": ordinal, "timestamp": "2026-09-16T05:00:00Z", "payload": {"type": "token_count", "info": {"total_token_usage": total, "last_token_usage": last}}}


def record(thread, response, usage, turn="t1"):
    return {"type": "token_usage_record", "timestamp": "2026-09-16T05:00:00Z", "payload": {"thread_id": thread, "response_id": response, "turn_id": turn, "usage": usage}}


def observed(spark, root, files):
    for name, rows in files.items():
        write(root, f"sessions/rollout-2026-09-16T05-00-00-{name}.jsonl", rows)
    rows = rollouts.events(logs.read_lines(spark, str(root)))
    return rows, accounting.observe(rows)


def test_counters_of_a_rollout(spark, tmp_path):
    meta = {"type": "session_meta", "payload": {"id": PARENT, "model_provider": "prov"}}
    context = {"type": "turn_context", "payload": {"turn_id": "t1", "model": "m9", "effort": "high"}}
    steps = [used(10, 2, 1), used(10, 2, 1), used(25, 2, 4), used(0, 0, 0, 99), used(8, 1, 6), used(9, 20, 7)]
    rows, found = observed(spark, tmp_path, {PARENT: [meta, context, *(count(t, used(0, 0, 0, 99) if t == used(0, 0, 0, 99) else used(3, 1, 2)) for t in steps)]})
    got = [(r["what"], r["code"], r["uncached_input"], r["cache_read"], r["output"], r["epoch"]) for r in found.orderBy("offset", F.desc("code")).collect()]
    assert got == [
        ("usage", None, 8, 2, 1, 0), ("usage", None, 15, 0, 3, 0), ("diagnostic", "estimate-window", None, None, None, 1), ("diagnostic", "epoch-reset", None, None, None, 1),
        ("usage", None, 7, 1, 6, 1), ("gap", "input-below-cache", None, None, None, 1),
    ]
    context = rollouts.in_context(found.filter("what = 'usage'"), rows).select("model", "effort", "provider").distinct().collect()
    assert [tuple(r) for r in context] == [("m9", "high", "prov")]


def test_boundary_twins_and_compaction(spark, tmp_path):
    child = [
        {"type": "session_meta", "ordinal": 0, "payload": {"id": CHILD, "parent_thread_id": PARENT, "subagent_history_start_ordinal": 5}},
        count(used(100, 0, 10), used(100, 0, 10), 1),
        count(used(130, 0, 15), used(30, 0, 5), 6),
        record(CHILD, "x1", used(7, 0, 3)),
        count(used(137, 0, 18), used(7, 0, 3), 8),
        {"type": "compacted", "payload": {"latest_token_usage_record": {"thread_id": CHILD, "response_id": "x2", "usage": used(4, 0, 4)}}},
        {"type": "compacted", "payload": {"latest_token_usage_record": {"thread_id": CHILD, "response_id": "x1", "usage": used(7, 0, 3)}}},
    ]
    rows, found = observed(spark, tmp_path, {CHILD: child})
    found = found.orderBy("offset").collect()
    assert [(r["what"], r["copy"], r["owner"], r["output"]) for r in found] == [
        ("usage", True, PARENT, 10), ("usage", False, CHILD, 3), ("twin", None, None, None), ("usage", False, CHILD, 4), ("usage", True, CHILD, 3),
    ]
    assert [tuple(r) for r in rollouts.relations(rows).select("kind", "source", "target", "found").collect()] == [("spawn", PARENT, CHILD, False)]


def test_names_of_rollouts(spark):
    files = spark.createDataFrame([(f"sessions/rollout-x-{PARENT}.jsonl",), (f"archived/rollout-x-{PARENT}.jsonl",), (f"s/rollout-x-{PARENT}_r2.jsonl",)], "locator string")
    assert {tuple(r[0]) for r in files.select(rollouts.named(F.col("locator"))).collect()} == {(PARENT, PARENT), (PARENT, "r2")}
    assert [(r["rollout"], r["locations"]) for r in rollouts.duplicate_locations(files).collect()] == [(PARENT, 2)]


def test_lines_without_usage_are_not_shuffled(spark, tmp_path):
    """What is shuffled of a line is where it is and what it says of threads; only lines that may have usage are parsed."""
    write(tmp_path, "p/s.jsonl", [{"type": "user", "sessionId": "s", "isSidechain": True, "message": {"content": "x" * 5000}}, said("a", 5, "s", 1, "u1", extra={"isSidechain": True}), {"type": "assistant", "message": {"usage": {"output_tokens": "9"}}}])
    rows = transcripts.located(logs.read_lines(spark, str(tmp_path)))
    assert "line" not in rows.columns
    got = rows.orderBy("offset").select(F.col("r").isNotNull().alias("parsed"), "side", "_named").collect()
    assert [(r["parsed"], r["_named"]) for r in got] == [(False, "s"), (True, "s"), (True, "s")]
    assert transcripts.records(logs.read_lines(spark, str(tmp_path))).count() == 1
