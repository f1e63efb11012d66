"""Roots of logs: links, repeated and missing paths, names; twins by their first records; changes while logs are read; sizes by kind."""

import gzip
import json
import os

import pytest
import zstandard

from tokenloom.sources import changes, logs, roots


def put(path, *records):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps(r) + "\n" for r in records))
    return str(path)


def test_links_stay_within_and_end(tmp_path):
    one, two, out = tmp_path / "one", tmp_path / "two", tmp_path / "out"
    put(one / "z/real.jsonl", 1)
    put(two / "b.jsonl", 2)
    put(out / "far.jsonl", 3)
    put(one / "note.txt", 4)
    os.symlink(one / "z/real.jsonl", one / "a.jsonl")  # sorts before the file it leads to
    os.symlink(one, one / "z/circle")
    os.symlink(out, one / "leaves")
    os.symlink(tmp_path / "nothing", one / "broken")
    os.symlink(two, one / "other")
    found = roots.discover([str(one), str(two), str(tmp_path / "gone"), str(one / "note.txt"), f"file:{one}/"])
    assert [(os.path.relpath(f.path, tmp_path), f.locator) for f in found.files] == [("one/z/real.jsonl", "z/real.jsonl"), ("one/other/b.jsonl", "other/b.jsonl")]
    first = {os.path.relpath(p, tmp_path): why for p, why in reversed(found.problems)}
    assert first == {
        "one/broken": "broken link", "one/leaves": "link outside the roots", "one/a.jsonl": "duplicate", "one/z/circle": "folder seen before", "two/b.jsonl": "duplicate", "gone": "missing root",
        "one/note.txt": "not a log", "one/other": "folder seen before",
    }
    assert {why for _, why in found.problems} <= set(roots.PROBLEMS)


def test_locators(tmp_path):
    assert roots.relative_locator("/r", "/r/a%b/c.jsonl.zst") == "a%25b/c.jsonl"
    assert roots.relative_locator("/r", "/r/x.zst") == "x.zst" and roots.relative_locator("/r", "/r/x.jsonl.gz") == "x.jsonl"
    odd = os.fsdecode(b"/r/\xff\xc3\xa9.jsonl")
    assert roots.relative_locator("/r", odd) == "%FFé.jsonl"
    (tmp_path / "fine.jsonl").write_text("{}\n")
    with open(os.fsencode(tmp_path) + b"/\xff.jsonl", "wb") as f:
        f.write(b"{}\n")
    found = roots.discover([str(tmp_path)])
    assert [f.locator for f in found.files] == ["fine.jsonl"] and found.problems == [("%FF.jsonl", "name is not UTF-8")]


def test_reading_follows_links_once(spark, tmp_path):
    put(tmp_path / "a/x.jsonl", {"n": 1}, {"n": 2})
    os.symlink(tmp_path / "a", tmp_path / "a/again")
    os.symlink(tmp_path / "a/x.jsonl", tmp_path / "a/0.jsonl")
    assert logs.read_lines(spark, [str(tmp_path / "a"), str(tmp_path)]).count() == 2


def test_twins_by_first_record(spark, tmp_path):
    line = b'{"n": 1}\n'
    for name, raw in (("same", line), ("else", b'{"n": 9}\n'), ("bad", b"{n\n"), ("open", b'{"n"')):
        (tmp_path / f"{name}.jsonl").write_bytes(line + b'{"n": 2}\n')
        (tmp_path / f"{name}.jsonl.gz").write_bytes(gzip.compress(raw))
    (tmp_path / "same.jsonl.zst").write_bytes(zstandard.compress(line))
    (tmp_path / "alone.jsonl").write_bytes(line)
    found = roots.discover([str(tmp_path)])
    got = {os.path.basename(r["path"]): r["state"] for r in changes.twins(spark, found).collect()}
    assert got == {"same.jsonl.gz": "verified", "same.jsonl.zst": "verified", "else.jsonl.gz": "different", "bad.jsonl.gz": "unreadable", "open.jsonl.gz": "not yet"}
    assert changes.twins(spark, roots.Discovery()).count() == 0


def test_changes_while_reading(spark, tmp_path):
    for name in ("stays", "grows", "goes", "other"):
        put(tmp_path / f"{name}.jsonl", {"n": 1})
    with changes.watched(spark, [str(tmp_path)]) as watch:
        put(tmp_path / "grows.jsonl", {"n": 1}, {"n": 2})
        os.remove(tmp_path / "goes.jsonl")
        put(tmp_path / "other.jsonl", {"n": 7})
        put(tmp_path / "comes.jsonl", {"n": 1})
    got = {(os.path.basename(r["path"]), r["change"]) for r in watch.changes.collect()} - {("other.jsonl", "modified")}
    assert got == {("grows.jsonl", "grew"), ("goes.jsonl", "vanished"), ("comes.jsonl", "new"), ("other.jsonl", "first record changed")}


@pytest.mark.parametrize("n", [1, 9, 10, 25])
def test_volume(spark, n):
    sizes = [(i * 7) % 13 for i in range(n)]
    rows = spark.createDataFrame([("a", s) for s in sizes] + [("empty", 0)], "kind string, length long")
    got = {r["kind"]: r.asDict() for r in roots.volume(rows).collect()}
    order = sorted(sizes)
    at = lambda p: order[max(0, -(-n * p // 100) - 1)]
    want = {"files": n, "bytes": sum(sizes), "p50": at(50), "p90": at(90), "p99": at(99), "max": order[-1], "top10_share": sum(order[-10:]) / sum(sizes) if sum(sizes) else 0.0}
    assert {k: got["a"][k] for k in want} == pytest.approx(want)
    assert got["empty"]["top10_share"] == 0
