"""JSON-lines logs, plain or compressed, as a table of complete lines: a Spark data source.

A partition is some byte ranges of plain files, whole compressed files, or both: small ones are read together, large plain ones by many tasks.
A line belongs to the range it begins in. No task holds more than MAX_LINE of a line, or more of a file than a buffer; what is read doesn't depend on how
it is split. Reading stops where a file ended when it was listed, so files may grow meanwhile.

One row for each line with its place in the decompressed stream. A last line without its end is `pending`, blank lines, lines that
aren't JSON and lines above MAX_LINE are told apart, and a damaged or shortened stream gives what could be read and a `failed` row. Of twins
(x.jsonl, x.jsonl.zst, x.jsonl.gz) the plain file is read, else zstd, else gzip; one that vanishes before it is read gives way to its twin.

The paths and lengths of a root's files are listed where the plan is made, as by any file source of Spark's; contents are only read by tasks. Files are reached
through Arrow's file systems (local, hdfs, s3, gs, abfs).
"""

from __future__ import annotations

import hashlib
import json
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tokenloom.sources.roots import SUFFIXES, discover, form, path_locator

MAX_LINE = 64 << 20
#: Bytes of plain files that one partition reads, unless the option `split` says otherwise, and files that it opens at most.
SPLIT, FILES = 128 << 20, 1000
#: What is read from a file at once, and handed on at once.
_BLOCK, _BATCH = 1 << 20, 8 << 20
#: What is decompressed at once.
_PACKED = 1 << 14
#: The beginning of a file that tells it from another one of the same name.
_HEAD = 4096
_COLUMNS = (("path", pa.string(), "string"), ("locator", pa.string(), "string"), ("offset", pa.int64(), "long"), ("length", pa.int64(), "long"), ("state", pa.string(), "string"), ("line", pa.string(), "string"))
SCHEMA = ", ".join(f"{c} {t}" for c, _, t in _COLUMNS)


def locator(path: Column) -> Column:
    return F.regexp_replace(path, r"(\.jsonl)\.(zst|gz)$", "$1")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path within it."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


@dataclass(frozen=True)
class Listed:
    """A file as it was listed."""

    path: str
    length: int

    @property
    def plain(self) -> bool:
        return self.path.endswith(".jsonl")


def listed(roots: str | list[str], every: bool = False) -> list[Listed]:
    """The preferred file of each log under roots (folders or files), or every one; no file twice."""
    roots = [roots] if isinstance(roots, str) else roots
    found = [Listed(f.path, f.length) for f in discover([r for r in roots if "://" not in r]).files]
    for root in (r for r in roots if "://" in r):
        system, inside = opened(root := root.rstrip("/"))
        start = root[: len(root) - len(inside)] if root.endswith(inside) else ""
        own = system.get_file_info(inside)
        below = [own] if own.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inside, recursive=True)) if own.type == fs.FileType.Directory else []
        found += [Listed(start + f.path, f.size) for f in below if f.type == fs.FileType.File and form(f.path) is not None]
    if every:
        return sorted({f.path: f for f in found}.values(), key=lambda f: f.path)
    best: dict[str, Listed] = {}
    for file in sorted(found, key=lambda f: form(f.path)):
        best.setdefault(path_locator(file.path), file)
    return [best[name] for name in sorted(best)]


class Missing(OSError):
    """Neither a file nor a twin of it is there any more."""


class Stream:
    """The decompressed bytes of a file, from a place on, block by block."""

    def __init__(self, path: str, start: int, upto: int):
        self.path, self.upto = path, upto
        system, inside = opened(path)
        try:
            self.file = system.open_input_file(inside)
        except FileNotFoundError:
            twins = [path.removesuffix(".gz").removesuffix(".zst").removesuffix(".jsonl") + s for s in SUFFIXES]
            for twin in twins:
                try:
                    self.file = system.open_input_file(opened(twin)[1])
                except FileNotFoundError:
                    continue
                self.path, self.upto = twin, upto if path.endswith(".jsonl") else 1 << 62
                break
            else:
                raise Missing(path) from None
        self.start = start

    def blocks(self) -> Iterator[bytes]:
        """Blocks up to the place where reading is to stop; raises where the stream is damaged."""
        if self.path.endswith(".jsonl"):
            self.file.seek(self.start)
            left = self.upto - self.start
            while left > 0 and (block := self.file.read(min(_BLOCK, left))):
                yield block
                left -= len(block)
            if 0 < left < 1 << 60:
                raise EOFError("shorter than listed")
            return
        at = 0
        for block in self._decompressed():
            if at + len(block) > self.start:
                block = block[max(0, self.start - at) :]
                at = max(at, self.start)
                yield block[: self.upto - at]
            at += len(block)
            if at >= self.upto:
                return

    def _decompressed(self) -> Iterator[bytes]:
        """The output of each small piece of input; raises if the last frame or member isn't whole."""
        make = (lambda: zlib.decompressobj(31)) if self.path.endswith(".gz") else (lambda: zstandard.ZstdDecompressor().decompressobj())
        part, fed = make(), False
        while raw := self.file.read(_PACKED):
            while raw:
                yield part.decompress(raw)
                fed, raw = True, b""
                if part.eof:  # another one may follow
                    raw, part, fed = part.unused_data, make(), False
        if fed:
            raise EOFError("truncated")


Line = tuple[int, int, str, str | None]


def split_lines(stream: Stream, begin: int, end: int, most: int = MAX_LINE) -> Iterator[Line]:
    """(offset, length, state, text) of each line that begins from `begin` on and before `end`.

    The stream starts one byte before `begin` unless that is 0: the line that this byte is in is another range's.
    """
    at = stream.start  # of the next byte of a block
    start: int | None = begin if begin == 0 else None  # of the line that is open; none while another range's line goes on
    held: list[bytes] = []
    size = 0
    try:
        for block in stream.blocks():
            place = 0
            while (found := block.find(b"\n", place)) >= 0:
                if start is not None:
                    size += found - place
                    held.append(block[place:found] if size <= most else b"")
                    yield _line(start, size, b"".join(held) if size <= most else None)
                held, size, place = [], 0, found + 1
                start = at + place
                if start >= end:
                    return
            if start is not None and place < len(block):
                size += len(block) - place
                if size <= most:
                    held.append(block[place:])
                else:
                    held = []
            at += len(block)
    except (EOFError, OSError, zlib.error, zstandard.ZstdError) as e:
        if isinstance(e, Missing):
            raise
        yield (start if start is not None else at), size, "failed", None
        return
    if start is not None and size:
        yield start, size, "pending", None


def _line(offset: int, size: int, raw: bytes | None) -> Line:
    if raw is None:
        return offset, size, "oversized", None
    if not raw.strip():
        return offset, size, "blank", None
    try:
        text = raw.decode()
        json.loads(text, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return offset, size, "malformed", None
    return offset, size, "record", text


def _refuse(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


@dataclass(frozen=True)
class Range:
    """A part of a file: lines that begin in it. The file's bytes are read up to `upto`."""

    path: str
    begin: int
    end: int
    upto: int
    #: Only so many lines, if any number is given.
    lines: int = 0
    #: A row to report before the lines: the state of a file that isn't what it was.
    report: str = ""


class Ranges(InputPartition):
    def __init__(self, parts: list[Range]):
        self.parts = parts


def _batches(parts: list[Range], most: int) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t, _) in enumerate(_COLUMNS)], names=[c for c, *_ in _COLUMNS])

    for part in parts:
        own = (part.path, path_locator(part.path))
        if part.report:
            rows.append((*own, 0, 0, part.report, None))
        try:
            stream = Stream(part.path, max(part.begin - 1, 0), part.upto)
            for n, line in enumerate(split_lines(stream, part.begin, part.end, most)):
                rows.append((*own, *line))
                size += line[1] + 64 if line[3] is not None else 64
                if size > _BATCH:
                    yield batch()
                    rows, size = [], 0
                if n + 1 == part.lines:
                    break
        except OSError:
            rows.append((*own, part.begin, 0, "failed", None))
    if rows:
        yield batch()


def packed(parts: list[Range], split: int) -> list[Ranges]:
    """Partitions of about `split` bytes."""
    out: list[list[Range]] = [[]]
    size = 0
    for p in parts:
        weight = min(p.end, p.upto) - p.begin
        if out[-1] and (size + weight > split or len(out[-1]) >= FILES):
            out.append([])
            size = 0
        out[-1].append(p)
        size += weight
    return [Ranges(p) for p in out if p]


def ranges(file: Listed, split: int, begin: int = 0, end: int | None = None) -> list[Range]:
    """The ranges of a file that are read apart: one, unless it is plain and large."""
    if not file.plain:
        return [Range(file.path, 0, 1 << 62, 1 << 62)]
    end = file.length if end is None else end
    return [Range(file.path, b, min(b + split, end), end) for b in range(begin, end, split)]


class LogReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.roots, self.only = json.loads(options["roots"]), json.loads(options.get("only", "null"))
        self.every = options.get("every") == "true"
        self.split, self.most, self.lines = int(options.get("split", SPLIT)), int(options.get("maxline", MAX_LINE)), int(options.get("lines", 0))

    def partitions(self) -> list[Ranges]:
        only = None if self.only is None else set(self.only)
        chosen = [f for f in listed(self.roots, self.every) if only is None or path_locator(f.path) in only]
        if self.lines:
            heads = [Range(f.path, 0, 1 << 62, f.length if f.plain else 1 << 62, self.lines) for f in chosen]
            size = min(FILES, len(heads) // 200 + 1)
            return [Ranges(heads[i : i + size]) for i in range(0, len(heads), size)] or [Ranges([])]
        return packed([r for f in chosen for r in ranges(f, self.split)], self.split) or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        yield from _batches(partition.parts, self.most)


def _last_end(path: str, begin: int, length: int, most: int) -> int:
    """Where the last complete line before `length` ends; `begin` if none does."""
    system, inside = opened(path)
    with system.open_input_file(inside) as file:
        at = length
        while at > begin and length - at < most + _BLOCK:
            size = min(_BLOCK, at - begin)
            file.seek(at - size)
            if (found := file.read(size).rfind(b"\n")) >= 0:
                return at - size + found + 1
            at -= size
    return begin


def _head(path: str, size: int) -> str:
    """The digest of a file's first bytes, of which it had so many."""
    system, inside = opened(path)
    with system.open_input_file(inside) as file:
        return hashlib.sha256(file.read(min(size, _HEAD))).hexdigest()[:16]


class LogStream(DataSourceStreamReader):
    """Complete lines as they come. The offset in the checkpoint has for each file how far it was read (the end of a complete line; compressed files: their length), and the
    digest of its beginning. A file that is shorter than it was read, begins otherwise, or (compressed) has another length is `replaced`: a row says so and it is read anew."""

    def __init__(self, options: dict[str, str]):
        self.roots = json.loads(options["roots"])
        self.split, self.most = int(options.get("split", SPLIT)), int(options.get("maxline", MAX_LINE))
        self.seen: dict[str, list] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        found = {}
        for f in listed(self.roots):
            try:
                found[f.path] = self._reached(f)
            except OSError:  # gone since it was listed
                continue
        self.seen = found
        return {path: reached[:3] for path, reached in found.items() if reached[0]}

    def _reached(self, f: Listed) -> list:
        """[read up to, bytes in the digest, digest, length] of a file."""
        before = self.seen.get(f.path)
        if before and before[3] == f.length and f.plain and _head(f.path, before[1]) == before[2]:
            return before
        same = before is not None and f.plain and f.length >= before[0] and _head(f.path, before[1]) == before[2]
        end = _last_end(f.path, before[0] if same else 0, f.length, self.most) if f.plain else f.length
        size = before[1] if same and before[1] == _HEAD else min(end, _HEAD)
        return [end, size, _head(f.path, size), f.length]

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        parts = []
        for path, (upto, _, head) in sorted(end.items()):
            before = start.get(path)
            if before == [upto, *end[path][1:]]:
                continue
            file = Listed(path, upto)
            replaced = False
            if before is not None:
                try:
                    replaced = not file.plain or upto < before[0] or _head(path, before[1]) != before[2]
                except OSError:
                    replaced = head != before[2]
            begin = 0 if before is None or replaced else before[0]
            own = ranges(file, self.split, begin, upto)
            parts += [replace(own[0], report="replaced"), *own[1:]] if replaced and own else own
        return packed(parts, self.split)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        yield from _batches(partition.parts, self.most)


class LogLines(DataSource):
    """Options: roots (JSON list), split, maxline, lines (so many of each file's first), every (form of each log), only (JSON list of locators)."""

    @classmethod
    def name(cls) -> str:
        return "log_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LogReader:
        return LogReader(dict(self.options))

    def streamReader(self, schema) -> LogStream:
        return LogStream(dict(self.options))


def _roots(root: str | list[str]) -> str:
    return json.dumps([root] if isinstance(root, str) else list(root))


def read_lines(spark: SparkSession, root: str | list[str], split: int = SPLIT, max_line: int = MAX_LINE, only: list[str] | None = None) -> DataFrame:
    """All lines of the preferred logs under roots (folders or files); with `only`, of the logs with these locators."""
    spark.dataSource.register(LogLines)
    reader = spark.read.format("log_lines").option("roots", _roots(root)).option("split", split).option("maxline", max_line)
    return (reader if only is None else reader.option("only", json.dumps(only))).load()


def read_heads(spark: SparkSession, root: str | list[str], lines: int, every: bool = False) -> DataFrame:
    """The first lines of each log, or of every form of each: no more of a file is read than they take (and a block)."""
    spark.dataSource.register(LogLines)
    return spark.read.format("log_lines").option("roots", _roots(root)).option("lines", lines).option("every", str(every).lower()).load()


def stream_lines(spark: SparkSession, root: str | list[str], split: int = SPLIT, max_line: int = MAX_LINE) -> DataFrame:
    """Complete lines of logs as they grow; see LogStream."""
    spark.dataSource.register(LogLines)
    return spark.readStream.format("log_lines").option("roots", _roots(root)).option("split", split).option("maxline", max_line).load()


def manifest(lines: DataFrame) -> DataFrame:
    """How many lines of each state every log has."""
    states = ("record", "blank", "oversized", "malformed", "pending", "failed")
    return lines.groupBy("locator").agg(F.count_if(F.col("state") != "pending").alias("lines"), *(F.count_if(F.col("state") == s).alias(s) for s in states))


def losses(manifests: DataFrame, kinds: tuple[str, ...] = ("oversized", "malformed", "failed")) -> DataFrame:
    """(loss, logs, lines): how many logs have lost lines in each way, and how many lines; a way no log has is left out."""
    each = manifests.select(F.explode(F.array(*(F.struct(F.lit(k).alias("loss"), F.col(k).alias("n")) for k in kinds))).alias("l"))
    return each.filter("l.n > 0").groupBy(F.col("l.loss").alias("loss")).agg(F.count("*").alias("logs"), F.sum("l.n").alias("lines"))
