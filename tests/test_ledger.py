"""From files of both dialects to reports, against results made by hand."""

import json

import pytest
from pyspark.sql import functions as F

from tests.test_dialects import count, record, said, used, write
from tokenloom import ledger
from tokenloom.sources import dialects, logs


def name(i):
    return f"{i:036}"


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("ledger")
    use = {"usage": {"cache_read_input_tokens": 4}}
    # one session with a subagent, one that replays a message of it, one apart
    write(top, "m/p/one.jsonl", [said("a", 5, "one", 1, "u1", request="ra", **use), said("a", 9, "one", 2, "u2", request="ra"), said("b", 3, "one", 3, "u3", extra={"content": [{"type": "tool_use", "id": "call1"}]})])
    write(top, "m/p/one/subagents/agent-x.jsonl", [said("c", 7, "one", 4, "u4")])
    (top / "m/p/one/subagents/agent-x.meta.json").write_text(json.dumps({"toolUseId": "call1"}))
    write(top, "m/p/two.jsonl", [said("a", 9, "one", 2, "u2", request="ra"), said("d", 2, "two", 5, "u5", model="m2")])
    write(top, "m/q/three.jsonl", [said("e", 1, "three", 59, "u6"), {"type": "assistant", "message": 3}])
    # a parent, its child with a copied prefix, and one apart whose first step proves nothing
    write(top, f"r/sessions/rollout-2026-09-16T05-00-00-{name(50)}.jsonl", [{"type": "session_meta", "payload": {"id": name(50), "cwd": "/w/proj", "model_provider": "prov"}}, {"type": "turn_context", "payload": {"turn_id": "p1", "model": "m9", "effort": "high"}}, count(used(100, 20, 10), used(100, 20, 10))])
    child = [{"type": "session_meta", "ordinal": 0, "payload": {"id": name(51), "parent_thread_id": name(50), "subagent_history_start_ordinal": 5}}, count(used(100, 20, 10), used(100, 20, 10), 1), count(used(130, 20, 13), used(30, 0, 3), 6)]
    write(top, f"r/sessions/rollout-2026-09-16T05-00-00-{name(51)}.jsonl", child)
    lone = [{"type": "session_meta", "payload": {"id": name(60)}}, record(name(60), "r1", used(8, 0, 2)), count(used(8, 0, 2), used(8, 0, 2)), {"type": "session_meta", "payload": {"id": name(60)}}, count(used(5, 9, 1), used(5, 9, 1))]
    write(top, f"r/archived_sessions/rollout-2026-09-16T05-00-00-{name(60)}.jsonl", lone)
    return top


@pytest.fixture(scope="module")
def read(spark, root):
    stats = ledger.Stats()
    made = ledger.read(spark, ledger.sources(spark, [f"{root}/m", f"{root}/r"]), stats=stats)
    made.stats = stats.lines()
    return made


SUMS = ("uncached_input", "cache_read", "output")


def test_report_of_both_dialects(read):
    got = ledger.report(read).first()
    assert tuple(got[m] for m in SUMS) == (5 + 80 + 30 + 8, 20, 9 + 3 + 7 + 2 + 1 + 10 + 3 + 2)
    assert (got["owned"], got["possible"], got["gaps"], got["complete"]) == (8, 0, 1, False)
    agents = {r["value"]: (r["requests"], r["output"]) for r in ledger.by(read, F.col("agent")).collect()}
    assert agents == {"claude": (5, 22), "codex": (3, 15)}
    models = {r["value"]: r["output"] for r in ledger.breakdowns(read, ["model", "project"]).filter("dimension = 'model'").collect()}
    assert models == {"m1": 20, "m2": 2, "m9": 10, "unknown": 5}


def test_daily_and_sessions(read):
    days = {str(r["date"]): r["output"] for r in ledger.daily(read, "America/Los_Angeles").collect()}
    assert days == {"2026-09-15": 37}
    rows = {(r["agent"], r["id"]): (r["requests"], r["output"], r["project"]) for r in ledger.sessions(read).collect()}
    assert rows == {
        ("claude", "one"): (2, 12, "proj"), ("claude", "one/x"): (1, 7, "proj"), ("claude", "two"): (1, 2, "proj"), ("claude", "three"): (1, 1, "proj"),
        ("codex", name(50)): (1, 10, "proj"), ("codex", name(51)): (1, 3, None), ("codex", name(60)): (1, 2, None),
    }
    edges = {(r["kind"], r["source"], r["target"], r["found"]) for r in read.edges.collect()}
    assert edges == {("spawn", "one", "one/x", True), ("fork", "one", "two", True), ("spawn", name(50), name(51), True)}


def test_a_choice_of_threads(read):
    chosen = ledger.covered(read, [name(50)])
    assert sorted(r["id"] for r in chosen.collect()) == [name(50), name(51)]
    assert ledger.report(read, chosen).select("output", "gaps").first() == (13, 0)
    alone = ledger.covered(read, ["one"], scope="self")
    assert ledger.daily(read, "UTC", alone).select("output").first()[0] == 12
    assert ledger.report(read, ledger.covered(read, [], agents=("codex",))).first()["output"] == 15


def test_families_are_all_that_is_read(spark, root, read):
    roots = ledger.sources(spark, [f"{root}/m", f"{root}/r"])
    few = ledger.narrowed(spark, roots, [name(51)])
    assert {d: sorted(p.rsplit("-", 1)[1] if "rollout" in p else p for p in v) for d, v in few.items()} == {"messages": [], "rollouts": [f"{name(i)}.jsonl" for i in (50, 51)]}
    one = ledger.narrowed(spark, roots, [f"{root}/m/p/one.jsonl"])
    assert sorted(p.rsplit("/", 1)[1] for p in one["messages"]) == ["agent-x.jsonl", "one.jsonl"]
    assert ledger.narrowed(spark, roots, ["nowhere"]) is None
    narrow = ledger.read(spark, roots, [name(51)])
    lines = {r["locator"] for r in narrow.logs.collect()}
    assert len(lines) == 2 < read.logs.count()
    whole = ledger.report(read, ledger.covered(read, [name(51)])).select(*SUMS, "owned", "gaps").first()
    assert ledger.report(narrow, ledger.covered(narrow, [name(51)])).select(*SUMS, "owned", "gaps").first() == whole


def test_sources_and_default_roots(spark, root, tmp_path):
    file = f"{root}/m/q/three.jsonl"
    assert ledger.sources(spark, [file, f"{root}/r"]) == {"messages": [file], "rollouts": [f"{root}/r"]}
    assert ledger.report(ledger.read(spark, ledger.sources(spark, [file]))).first()["output"] == 1
    with pytest.raises(dialects.MixedDialects):
        ledger.sources(spark, [str(root)])
    with pytest.raises(dialects.UnknownDialect):
        ledger.sources(spark, [str(tmp_path)])
    assert ledger.default_roots({"CODEX_HOME": "/c"}, "/h") == {"messages": ["/h/.claude/projects", "/h/.config/claude/projects"], "rollouts": ["/c/sessions", "/c/archived_sessions"]}
    assert [p for p in logs.listed(file)] == [logs.Listed(file, p.length) for p in logs.listed(file)]


def test_stats_are_taken_along(read):
    lines = [x for x in read.stats if "part=" in x]
    assert "stats: part=message-lines rows=8 record=8 malformed=0 oversized=0 pending=0 failed=0" in lines
    assert "stats: part=message-observations rows=7 undated=0" in lines and "stats: part=message-owners rows=7 copies=1" in lines
    assert any(x.startswith("stats: part=rollout-usage") and "originals=3" in x and "gaps=1" in x for x in lines)
    assert sum("phase=" in x for x in read.stats) == 4


def test_coverage(read):
    got = {r["agent"]: (r["observations"], r["copies"], r["requests"], r["requests_without_usage"]) for r in ledger.coverage(read).collect()}
    assert got == {"claude": (7, 1, 5, 0), "codex": (4, 1, 3, 0)}
