import json

import pytest

from tokenloom.sources import dialects, logs


def test_roots_go_by_override_then_native_then_home():
    assert dialects.message_roots({"MINE": "/a::/b", "CLAUDE_CONFIG_DIR": "/c"}, "/h", "MINE") == ["/a/projects", "/b/projects"]
    assert dialects.message_roots({"MINE": "", "CLAUDE_CONFIG_DIR": "/c"}, "/h", "MINE") == ["/c/projects"]
    assert dialects.message_roots({}, "/h") == ["/h/.claude/projects", "/h/.config/claude/projects"]
    assert dialects.message_roots({"XDG_CONFIG_HOME": "/x"}, "/h") == ["/h/.claude/projects", "/x/claude/projects"]
    assert dialects.message_roots({}, None) == [] == dialects.rollout_homes({}, None)
    assert dialects.rollout_homes({"CODEX_HOME": "/c"}, "/h") == ["/c"] and dialects.rollout_homes({}, "/h") == ["/h/.codex"]


def test_the_first_known_type_tells_the_dialect(spark, tmp_path):
    def write(place, *types):
        (tmp_path / place).parent.mkdir(exist_ok=True)
        (tmp_path / place).write_text("".join(json.dumps({"type": t}) + "\n" for t in types))

    write("m/a.jsonl", "ai-title", "user", "event_msg")
    write("m/b.jsonl", "ai-title")
    write("m/c.jsonl", *["ai-title"] * 100, "event_msg")
    write("r/d.jsonl", "event_msg")
    lines = {k: logs.read_heads(spark, str(tmp_path / k), dialects.PEEK) for k in "mr"}
    told = {r["locator"].rsplit("/", 1)[1]: r["dialect"] for r in dialects.sniffed(lines["m"]).collect()}
    assert told == {"a.jsonl": "messages", "b.jsonl": None, "c.jsonl": None}
    assert [dialects.dialect_of(lines[k]) for k in "mr"] == ["messages", "rollouts"]
    with pytest.raises(dialects.MixedDialects):
        dialects.dialect_of(logs.read_heads(spark, str(tmp_path), dialects.PEEK))
    with pytest.raises(dialects.UnknownDialect):
        dialects.dialect_of(lines["m"].filter("state = 'none'"))
