"""The data source of logs: ranges, twins, damage, long lines, and streams that go on."""

import gzip
import json
import os
import random

import pytest
import zstandard
from pyspark.sql import functions as F

from tokenloom.sources import logs


def body(n, seed=1, end=b"\n"):
    rng = random.Random(seed)
    kinds = (lambda: json.dumps({"v": rng.randint(0, 9), "t": "é" * rng.randint(0, 60)}).encode(), lambda: b"", lambda: b"{broken", lambda: b"\xff\xfe", lambda: b"  ")
    return b"\n".join(rng.choices(kinds, (12, 1, 1, 1, 1))[0]() for _ in range(n)) + end


def plainly(raw, most=1 << 30):
    out, at = [], 0
    lines = raw.split(b"\n")
    for i, line in enumerate(lines):
        if i + 1 == len(lines):
            out += [(at, len(line), "pending", None)] if line else []
            break
        try:
            state = "oversized" if len(line) > most else "blank" if not line.strip() else "record" if json.loads(line.decode()) is not None else ""
        except ValueError:
            state = "malformed"
        out.append((at, len(line), state, line.decode() if state == "record" else None))
        at += len(line) + 1
    return out


def read_all(raw, path, split, most=logs.MAX_LINE):
    parts = [r for f in logs.listed(str(path)) for r in logs.ranges(f, split)]
    return sorted(tuple(r[c] for c in ("offset", "length", "state", "line")) for b in logs._batches(parts, most) for r in b.to_pylist())


@pytest.mark.parametrize("end", [b"\n", b"", b'\n{"open'])
def test_rows_dont_depend_on_the_split(tmp_path, end):
    raw = body(300, 3, end)
    (tmp_path / "a.jsonl").write_bytes(raw)
    for split in (1, 2, 7, 50, 1000, 1 << 30):
        assert read_all(raw, tmp_path, split) == sorted(plainly(raw))
    long = b'{"a": "' + b"x" * 500 + b'"}\n' + body(20, 4)
    (tmp_path / "a.jsonl").write_bytes(long)
    for split in (3, 100, 1 << 20):
        assert read_all(long, tmp_path, split, 400) == sorted(plainly(long, 400))


def test_a_partition_holds_one_line_at_most(tmp_path):
    """Lines above the limit are passed over block by block."""
    with open(tmp_path / "big.jsonl", "wb") as f:
        for _ in range(64):
            f.write(b"x" * (1 << 20))
        f.write(b'\n{"a": 1}\n')
    import tracemalloc

    tracemalloc.start()
    rows = read_all(None, tmp_path, 1 << 30, 1 << 20)
    assert tracemalloc.get_traced_memory()[1] < 8 << 20
    tracemalloc.stop()
    assert [r[2] for r in rows] == ["oversized", "record"] and rows[0][1] == 64 << 20


@pytest.mark.parametrize("pack", [gzip.compress, zstandard.compress])
def test_packed_files(tmp_path, pack):
    raw = body(200, 5)
    name = "a.jsonl.gz" if pack is gzip.compress else "a.jsonl.zst"
    (tmp_path / name).write_bytes(pack(raw[:700]) + pack(raw[700:]))
    assert read_all(raw, tmp_path, 10) == sorted(plainly(raw))
    whole = pack(raw)
    (tmp_path / name).write_bytes(whole[:-9])
    got = read_all(raw, tmp_path, 10)
    assert got[-1][2] == "failed" and [r for r in got if r[2] != "failed"] == [r for r in sorted(plainly(raw)) if r[0] < got[-1][0]]


def test_a_file_that_vanishes_gives_way_to_its_twin(tmp_path):
    raw = body(100, 6)
    (tmp_path / "a.jsonl").write_bytes(raw)
    parts = [r for f in logs.listed(str(tmp_path)) for r in logs.ranges(f, 200)]
    (tmp_path / "a.jsonl.zst").write_bytes(zstandard.compress(raw + b'{"later": 1}\n'))
    os.remove(tmp_path / "a.jsonl")
    got = sorted((r["offset"], r["length"], r["state"], r["line"]) for b in logs._batches(parts, logs.MAX_LINE) for r in b.to_pylist())
    assert got == sorted(plainly(raw))
    os.remove(tmp_path / "a.jsonl.zst")
    assert {r["state"] for b in logs._batches(parts[:1], logs.MAX_LINE) for r in b.to_pylist()} == {"failed"}


def test_growth_and_loss_after_listing(tmp_path):
    raw = body(50, 7)
    (tmp_path / "a.jsonl").write_bytes(raw + b'{"op')
    parts = [r for f in logs.listed(str(tmp_path)) for r in logs.ranges(f, 100)]
    with open(tmp_path / "a.jsonl", "ab") as f:
        f.write(b'en": 1}\n{"later": 2}\n')
    got = sorted((r["offset"], r["length"], r["state"], r["line"]) for b in logs._batches(parts, logs.MAX_LINE) for r in b.to_pylist())
    assert got == sorted(plainly(raw + b'{"op'))
    (tmp_path / "a.jsonl").write_bytes(raw[:20])
    assert "failed" in {r["state"] for b in logs._batches(parts, logs.MAX_LINE) for r in b.to_pylist()}


def test_as_a_table(spark, tmp_path):
    raw = body(2000, 8)
    (tmp_path / "x" / "y").mkdir(parents=True)
    (tmp_path / "x" / "y" / "a.jsonl").write_bytes(raw)
    (tmp_path / "x" / "b.jsonl").write_bytes(raw)
    lines = logs.read_lines(spark, [str(tmp_path / "x" / "y"), f"file:{tmp_path}/x/b.jsonl"], split=4096)
    assert lines.rdd.getNumPartitions() > 5
    got = sorted((r["offset"], r["length"], r["state"], r["line"]) for r in lines.filter(F.col("locator").endswith("a.jsonl")).collect())
    assert got == sorted(plainly(raw)) and lines.count() == 2 * len(got)
    only = logs.read_lines(spark, str(tmp_path), only=[str(tmp_path / "x" / "b.jsonl")])
    assert {r["locator"] for r in only.select("locator").distinct().collect()} == {str(tmp_path / "x" / "b.jsonl")}
    heads = logs.read_heads(spark, str(tmp_path), 3)
    assert sorted(r["offset"] for r in heads.collect()) == sorted(2 * [r[0] for r in sorted(plainly(raw))[:3]])
    assert logs.read_lines(spark, str(tmp_path / "none")).count() == 0


def test_a_stream_goes_on(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    stream = logs.stream_lines(spark, str(root), split=64)

    def run():
        """What a new run over the same checkpoint brings."""
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        rows = spark.read.schema(logs.SCHEMA).parquet(str(tmp_path / "out")).collect()
        new = [r for r in rows if (r["path"], r["offset"], r["state"], r["line"]) not in seen]
        seen.update((r["path"], r["offset"], r["state"], r["line"]) for r in rows)
        assert len(rows) == len(seen)  # nothing twice
        return sorted((r["path"].rsplit("/", 1)[1], r["state"], r["line"]) for r in new)

    seen = set()
    a = root / "a.jsonl"
    a.write_bytes(b'{"n": 1}\n{"n": 2}\n{"n": ')
    (root / "z.jsonl.gz").write_bytes(gzip.compress(b'{"z": 1}\n'))
    assert run() == [("a.jsonl", "record", '{"n": 1}'), ("a.jsonl", "record", '{"n": 2}'), ("z.jsonl.gz", "record", '{"z": 1}')]
    with open(a, "ab") as f:
        f.write(b'3}\n{"n": 4')
    (root / "b.jsonl").write_bytes(b'{"b": 1}\n' * 1 + b'{"b": 2}\n' * 1)
    assert run() == [("a.jsonl", "record", '{"n": 3}'), ("b.jsonl", "record", '{"b": 1}'), ("b.jsonl", "record", '{"b": 2}')]
    assert run() == []
    a.write_bytes(b'{"m": 1}\n')  # shorter, and begins otherwise
    assert run() == [("a.jsonl", "record", '{"m": 1}'), ("a.jsonl", "replaced", None)]
