"""What happened to sources between two listings, or while they were read; and whether the forms of a log are the same log."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.operators.graph import stored
from tokenloom.sources.dialects import PEEK
from tokenloom.sources.logs import locator, read_heads
from tokenloom.sources.roots import Discovery, discover, files

#: What a change is called, as in the column `change`.
CHANGES = ("new", "vanished", "truncated", "grew", "modified", "first record changed")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, locator, length, modified) of the logs under a root; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    logs = files.filter(F.col("path").rlike(r"\.jsonl(\.zst|\.gz)?$"))
    logs = logs.withColumn("path", F.regexp_replace("path", "^file:(//)?(?=/)", ""))  # as logs are read
    return logs.select("path", locator(F.col("path")).alias("locator"), "length", F.col("modificationTime").alias("modified"))


def first_records(lines: DataFrame) -> DataFrame:
    """(path, first): the digest of each log's first record, of the rows of `read_lines` or `read_heads`."""
    records = lines.filter("state = 'record'").groupBy("path").agg(F.min_by("line", "offset").alias("line"))
    return records.select("path", F.sha2(F.col("line").cast("binary"), 256).alias("first"))


def changes(before: DataFrame, after: DataFrame, key: str = "path") -> DataFrame:
    """(key, change) of every source that isn't as it was; one with several changes has several rows.

    A changed length tells more than a changed time, so the time only counts where the length is the same. Where both
    listings have a column `first`, the digest of the first record, it is compared if there was one before.
    """
    first = "first" in before.columns and "first" in after.columns
    names = ["length", "modified", *(["first"] if first else [])]
    old = before.select(F.col(key).alias("_key"), F.struct(*names).alias("_old"))
    both = old.join(after.select(key, F.struct(*names).alias("_new")), F.col("_key") == F.col(key), "full")
    was, now = F.col("_old.length"), F.col("_new.length")
    extent = F.when(now < was, "truncated").when(now > was, "grew").when(~F.col("_old.modified").eqNullSafe(F.col("_new.modified")), "modified")
    extent = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "vanished").otherwise(extent)
    kinds = [extent]
    if first:
        there = F.col("_old.first").isNotNull() & F.col("_new").isNotNull()
        kinds.append(F.when(there & ~F.col("_old.first").eqNullSafe(F.col("_new.first")), "first record changed"))
    return both.select(F.coalesce("_key", key).alias(key), F.explode(F.array_compact(F.array(*kinds))).alias("change"))


def seen(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(path, length, modified, first) of every form of the logs under local roots, as they are now; first is null where there is no record yet."""
    found = files(spark, discover(roots)).select("path", "length", "modified")
    return stored(found.join(first_records(read_heads(spark, roots, PEEK, every=True)), "path", "left"))


@dataclass
class Watch:
    """What happened while logs were read: (path, change), once that is over."""

    changes: DataFrame | None = None


@contextmanager
def watched(spark: SparkSession, roots: list[str]) -> Iterator[Watch]:
    """Looks at the logs under local roots before and after what is done within. What was read stands: reading stops where a file ended when it was listed, so
    `grew` loses nothing of what was there; the other changes say that a report may not hold for the file as it is now."""
    before, watch = seen(spark, roots), Watch()
    yield watch
    watch.changes = changes(before, seen(spark, roots))


def twins(spark: SparkSession, found: Discovery) -> DataFrame:
    """(root, locator, path, state) of the forms that aren't read because their log has a preferred one: `verified` where the first records are the same,
    `different` where they aren't (another log, which nothing reads), `unreadable` where the first record can't be read, `not yet` where there is none."""
    every = files(spark, found)
    several = every.groupBy("root", "locator").agg(F.count("*").alias("n"), F.min("form").alias("read")).filter("n > 1")
    paths: dict[tuple[str, str], list[str]] = {}
    for f in found.files:
        paths.setdefault((f.root, f.locator), []).append(f.path)
    there = [p for forms in paths.values() if len(forms) > 1 for p in forms]  # names that the driver has listed
    rows = every.join(several, ["root", "locator"])
    if not there:
        return rows.select("root", "locator", "path", F.lit("").alias("state"))
    heads = read_heads(spark, there, PEEK, every=True)
    lost = heads.groupBy("path").agg(F.min_by("state", F.when(~F.col("state").isin("blank", "pending"), F.col("offset"))).alias("begins"))
    rows = rows.join(lost, "path", "left").join(first_records(heads), "path", "left")
    ours = rows.filter("form = read").select("root", "locator", F.col("first").alias("_ours"))
    bad = F.col("begins").isin("oversized", "malformed") | (F.col("begins") == "failed")
    state = F.when(F.col("first").isNotNull() & (F.col("first") == F.col("_ours")), "verified").when(F.col("first").isNotNull(), "different").when(bad, "unreadable").otherwise("not yet")
    return rows.filter("form <> read").join(ours, ["root", "locator"]).select("root", "locator", "path", state.alias("state"))
