"""What lies under the roots of logs: each file once, within the roots, with its locator; and what was passed over, and why.

Names are listed where the plan is made, as by any file source of Spark; contents are only read by tasks. What really lies in a folder goes before what links reach, and an
earlier root before a later one, so a file that several paths lead to is read by the same one whatever the order of names. Links are followed within the roots only, and no
folder twice, so links in a circle end.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.operators.rollups import ranked_values

#: In the order in which forms of a log are preferred.
SUFFIXES = (".jsonl", ".jsonl.zst", ".jsonl.gz")
#: Why a path was passed over.
PROBLEMS = ("missing root", "unreadable", "not a log", "name is not UTF-8", "duplicate", "link outside the roots", "broken link", "folder seen before")


def form(path: str) -> int | None:
    """The place of a path's form among SUFFIXES; none where it isn't a log."""
    return next((i for i in reversed(range(len(SUFFIXES))) if path.endswith(SUFFIXES[i])), None)


def path_locator(path: str) -> str:
    """The path of a log, however it is packed."""
    return next((path[: -len(s)] + SUFFIXES[0] for s in SUFFIXES[1:] if path.endswith(s)), path)


def relative_locator(root: str, path: str) -> str:
    """A log's name below its root: parts by `/`, percent signs and bytes that aren't UTF-8 escaped so that two names never meet, without its packing."""
    inside = os.fsencode(os.path.relpath(path, root)).replace(b"%", b"%25")
    text = inside.decode("utf-8", "surrogateescape")
    return path_locator("".join(f"%{ord(c) - 0xDC00:02X}" if 0xDC80 <= ord(c) <= 0xDCFF else c for c in text))


@dataclass(frozen=True)
class Found:
    """A file of a log; `form` is the place of its form among SUFFIXES."""

    root: str
    locator: str
    path: str
    form: int
    length: int
    modified: float


@dataclass
class Discovery:
    files: list[Found] = field(default_factory=list)
    #: (path, one of PROBLEMS)
    problems: list[tuple[str, str]] = field(default_factory=list)


def _within(path: str, folders: list[str]) -> bool:
    return any(path == f or path.startswith(f.rstrip("/") + "/") for f in folders)


class _Walk:
    def __init__(self, real_roots: list[str]):
        self.real_roots, self.out = real_roots, Discovery()
        self.files: set[str] = set()
        self.folders: set[str] = set()

    def root(self, root: str) -> None:
        real = os.path.realpath(root)
        if not os.path.exists(real):
            self.out.problems.append((root, "missing root"))
        elif not os.path.isdir(real):
            if form(root) is None:
                self.out.problems.append((root, "not a log"))
            else:
                self.file(os.path.dirname(root), root)
        else:
            self.folders.add(real)
            pending = [root]
            while pending:  # what links of the last round lead to
                links = sorted(link for folder in pending for link in self.below(root, folder))
                pending = [link for link in links if self.link(root, link)]

    def below(self, root: str, folder: str) -> Iterator[str]:
        """Takes the files below a folder; gives the links there."""
        stack = [folder]
        while stack:
            try:
                with os.scandir(stack.pop()) as entries:
                    listed = sorted(entries, key=lambda e: e.name)
            except OSError as e:
                self.out.problems.append((e.filename, "unreadable"))
                continue
            for e in listed:
                if e.is_symlink():
                    yield e.path
                elif e.is_dir(follow_symlinks=False):
                    if (real := os.path.realpath(e.path)) not in self.folders:
                        self.folders.add(real)
                        stack.append(e.path)
                elif e.is_file(follow_symlinks=False):
                    self.file(root, e.path)

    def link(self, root: str, path: str) -> bool:
        """Whether a link leads to a folder that is to be read; takes the file it leads to."""
        real = os.path.realpath(path)
        if not os.path.exists(real):
            problem = "broken link"
        elif not _within(real, self.real_roots):
            problem = "link outside the roots"
        elif not os.path.isdir(real):
            self.file(root, path)
            return False
        elif real in self.folders:
            problem = "folder seen before"
        else:
            self.folders.add(real)
            return True
        self.out.problems.append((path, problem))
        return False

    def file(self, root: str, path: str) -> None:
        if (kind := form(path)) is None:
            return
        real = os.path.realpath(path)
        if real in self.files:
            self.out.problems.append((path, "duplicate"))
            return
        self.files.add(real)
        locator = relative_locator(root, path)
        try:
            path.encode()
            stat = os.stat(path)
        except UnicodeEncodeError:  # no column can hold the path
            self.out.problems.append((locator, "name is not UTF-8"))
        except OSError:
            self.out.problems.append((path, "unreadable"))
        else:
            self.out.files.append(Found(root, locator, path, kind, stat.st_size, stat.st_mtime))


def discover(roots: list[str]) -> Discovery:
    """The files of logs under local roots (folders or files), and what was passed over."""
    declared = [os.path.normpath(r.removeprefix("file:")) for r in roots]
    walk = _Walk([os.path.realpath(r) for r in declared])
    for root in declared:
        walk.root(root)
    return walk.out


def files(spark: SparkSession, found: Discovery) -> DataFrame:
    """(root, locator, path, form, length, modified) of each file; `form` is the place of its form among SUFFIXES."""
    rows = [(f.root, f.locator, f.path, f.form, f.length, f.modified) for f in found.files]
    return spark.createDataFrame(rows, "root string, locator string, path string, form int, length long, modified double").withColumn("modified", F.timestamp_micros((F.col("modified") * 1000000).cast("long")))


def problems(spark: SparkSession, found: Discovery) -> DataFrame:
    """(path, problem) of what was passed over."""
    return spark.createDataFrame(found.problems, "path string, problem string")


def volume(listed: DataFrame, kind: str = "kind", size: str = "length") -> DataFrame:
    """(kind, files, bytes, p50, p90, p99, max, top10_share): how many files each kind has, nearest-rank percentiles of their sizes, and what part of its bytes its ten largest hold.

    Sizes are counted before they are ranked, so no task holds a kind's files. A kind without bytes has a share of 0."""
    ranked = ranked_values(listed, [kind], F.col(size).cast("long"))
    at = [F.min(F.when(F.col("_upto") * 100 >= F.col("_of") * p, F.col("_v"))).cast("long").alias(f"p{p}") for p in (50, 90, 99)]
    above = F.col("_of") - F.col("_upto")  # files that are larger
    of_ten = F.greatest(F.lit(0), F.least(F.col("_n"), F.lit(10) - above)) * F.col("_v")
    sums = ranked.groupBy(kind).agg(F.sum("_n").alias("files"), F.sum(F.col("_n") * F.col("_v")).cast("long").alias("bytes"), *at, F.max("_v").alias("max"), F.sum(of_ten).alias("_ten"))
    return sums.withColumn("top10_share", F.when(F.col("bytes") > 0, F.col("_ten") / F.col("bytes")).otherwise(F.lit(0.0))).drop("_ten")
