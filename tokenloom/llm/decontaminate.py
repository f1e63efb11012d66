"""Benchmark decontamination with a stored positional inverted index over the training documents.

Index. Every task cuts its documents into segments of SEGMENT_BYTES and writes, for each segment, the postings of all
its terms: the sorted list of the positions at which a term stands, over one position axis for the segment, and where
each document starts on it. A segment is one row of a written table in the shared folder; the index knows nothing of
a benchmark and is built once for any number of them. It is spread by documents, so neither a frequent term nor
a passage that many documents share has a list that one task must hold.

Search. A phrase query is a window of item words. Within a segment its terms are ordered by the length of their lists;
the list of the rarest term, less that term's offset, gives the candidates, and the list of each next rarer term,
less its own offset, is intersected with them. What is left after all terms is an exact phrase match. With a slop,
a term may stand that many positions from its place, and what is left is a proximity match.

The benchmark is a stated query set: the driver reads it in blocks of bounded size, and for each block one job
scans the index and writes its hits, so no more than one block is on the driver or in a task. Null texts and texts
without a word have no hits; neither has anything against an item without a word. Repeated items and windows count once
for each item_id; windows of items without an id hit like any other, but name no item. Very long texts make segments of their
own size. Repeated rows each get their row; empty tables give empty results. Documents keep their own columns, whatever
their names; one called like the result column is replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm.common import boxed, discard, filled, mark_of, may_hold, read, store, unboxed

WINDOW = 10
#: Characters of benchmark text that go to the tasks at once, and bytes of documents that one index segment holds.
BLOCK_CHARS, SEGMENT_BYTES = 16_000_000, 2_000_000
#: Bytes of a row group of the index, a few segments: so much of it a task writes or decodes at once, however long its part.
GROUP_BYTES = 8_000_000

#: Bytes under 0x80 that aren't letters or digits part words; A-Z become a-z.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

POSTINGS = "terms array<binary>, at array<int>, positions array<int>, first array<int>"
HITS = "n_words long, starts array<int>, ends array<int>, items array<string>, near array<string>"


def words(text: str | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and all characters beyond ASCII."""
    return text.encode().translate(_TABLE).split() if text else []


@dataclass
class Block:
    """Windows of some items: a row of term numbers each (-1 beyond a short one's end), and whose they are."""

    terms: dict[bytes, int] = field(default_factory=dict)
    windows: dict[tuple[int, ...], list[str]] = field(default_factory=dict)
    chars: int = 0

    def add(self, item: str | None, text: str | None, width: int) -> None:
        ids = [self.terms.setdefault(w, len(self.terms)) for w in words(text)]
        self.chars += len(text or "")
        for i in range(max(1, len(ids) - width + 1) if ids else 0):
            owners = self.windows.setdefault(tuple(ids[i : i + width]), [])
            if item is not None and (not owners or owners[-1] != item):
                owners.append(item)

    def matrix(self, width: int) -> np.ndarray:
        out = np.full((len(self.windows), width), -1, dtype=np.int32)
        for i, w in enumerate(self.windows):
            out[i, : len(w)] = w
        return out


def blocks(benchmark: DataFrame, width: int = WINDOW, item: str = "item_id", text: str = "text", block_chars: int = BLOCK_CHARS) -> Iterator[Block]:
    """The query set, read item by item; the driver holds one block at a time."""
    block = Block()
    for row in benchmark.select(F.col(f"`{item}`").cast("string"), F.col(f"`{text}`")).toLocalIterator():
        block.add(row[0], row[1], width)
        if block.chars >= block_chars:
            yield block
            block = Block()
    yield block


def postings(texts: list[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """The terms of some documents, where each one's list ends, all lists, and where each document starts.

    Document i takes the positions first[i] to first[i + 1] - 2; the one after them parts it from the next.
    """
    ids: dict[bytes, int] = {}
    parts, first = [], [0]
    for t in texts:
        own = words(t)
        parts.append(np.fromiter((ids.setdefault(w, len(ids)) for w in own), dtype=np.int32, count=len(own)))
        first.append(first[-1] + len(own) + 1)
    term = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    place = np.arange(len(term)) + np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    order = np.argsort(term, kind="stable")
    ends = np.cumsum(np.bincount(term, minlength=len(ids)))
    return list(ids), ends.astype(np.int32), place[order].astype(np.int32), np.array(first, dtype=np.int32)


def _segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size, kinds = [], 0, None

    def made() -> pa.RecordBatch:
        terms, at, positions, first = postings([h[2] for h in held])
        columns = [([h[0] for h in held], pa.list_(kinds[0])), ([h[1] for h in held], pa.list_(kinds[1])), (terms, pa.list_(pa.binary())), (at, pa.list_(pa.int32())), (positions, pa.list_(pa.int32())), (first, pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in columns], names=["keys", "marks", "terms", "at", "positions", "first"])

    for batch in batches:
        kinds = [batch.column(i).type for i in range(2)]
        for key, mark, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            held.append((key, mark, text))
            size += len(text or "")
            if size >= SEGMENT_BYTES:
                yield made()
                held, size = [], 0
    if held:
        yield made()


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", mark: Column | None = None) -> DataFrame:
    """The written index: one row for each segment, with its documents (keys, marks) and the postings of its terms."""
    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(f"`{key}`"), F.lit("") if mark is None else mark, F.col(f"`{text}`"))
    return store(rows.mapInArrow(_segment_rows, f"keys array<{kind}>, marks array<string>, {POSTINGS}"), "index", GROUP_BYTES)


class Segment:
    """Posting lists of one segment for the terms of a block, all lists in one array of (term, position)."""

    def __init__(self, terms: list[bytes], at: np.ndarray, positions: np.ndarray, first: np.ndarray, wanted: dict[bytes, int]):
        self.first = first.astype(np.int64)
        self.span = int(self.first[-1]) + 1
        number = np.array([wanted.get(t, -1) for t in terms], dtype=np.int64)
        counts = np.diff(at, prepend=0)
        owner = np.repeat(number, counts)
        known = owner >= 0
        #: a term's list lies between its number times the span and the next one's
        self.lists = np.sort(owner[known] * self.span + positions[known])
        self.counts = np.zeros(len(wanted), dtype=np.int64)
        self.counts[number[number >= 0]] = counts[number >= 0]
        self.begin = np.cumsum(self.counts) - self.counts

    def search(self, windows: np.ndarray, slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) of each match; the windows are rows of term numbers, -1 beyond a short one's end."""
        none = np.zeros(0, dtype=np.int64)
        if not len(windows) or not len(self.lists):
            return none, none
        frequency = np.where(windows >= 0, self.counts[np.maximum(windows, 0)], np.iinfo(np.int64).max)
        alive = np.flatnonzero(frequency.min(axis=1) > 0)
        rarest = np.argsort(frequency[alive], axis=1, kind="stable")
        terms = np.take_along_axis(windows[alive], rarest, axis=1).astype(np.int64)
        n = self.counts[terms[:, 0]]
        row = np.repeat(np.arange(len(alive)), n)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        start = self.lists[self.begin[terms[row, 0]] + nth] - terms[row, 0] * self.span - rarest[row, 0]
        document = np.searchsorted(self.first, start + rarest[row, 0], side="right") - 1
        low, high = self.first[document], self.first[document + 1] - 2
        for k in range(1, windows.shape[1]):
            term, offset = terms[row, k], rarest[row, k]
            base, at = term * self.span, start + offset
            # the least position of the term's list that isn't below the slop; within the document and the slop, or no match
            least = base + np.maximum(at - slop, low)
            found = np.minimum(np.searchsorted(self.lists, least), len(self.lists) - 1)
            hit = (self.lists[found] >= least) & (self.lists[found] <= base + np.minimum(at + slop, high))
            keep = hit | (term < 0)
            row, start, low, high = row[keep], start[keep], low[keep], high[keep]
        return alive[row], start


def _searcher(block: Block, width: int, slop: int) -> Callable:
    matrix, owners, wanted = block.matrix(width), list(block.windows.values()), block.terms
    lengths = (matrix >= 0).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys, marks = batch.column("keys")[i].values, batch.column("marks")[i].values
                lists = [batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("at", "positions", "first")]
                segment = Segment(batch.column("terms")[i].as_py(), *lists, wanted)
                rows: dict[int, tuple[list, list, set, set]] = {}
                window, start = segment.search(matrix)
                for w, s, d in zip(window.tolist(), start.tolist(), (np.searchsorted(segment.first, start, side="right") - 1).tolist(), strict=True):
                    starts, ends, items, _ = rows.setdefault(d, ([], [], set(), set()))
                    starts.append(s - int(segment.first[d]))
                    ends.append(starts[-1] + int(lengths[w]))
                    items.update(owners[w])
                if slop:
                    window, start = segment.search(matrix, slop)
                    inside = np.clip(start, 0, None)
                    for w, d in zip(window.tolist(), (np.searchsorted(segment.first, inside, side="right") - 1).tolist(), strict=True):
                        rows.setdefault(d, ([], [], set(), set()))[3].update(owners[w])
                n = len(keys)
                out = [rows.get(d, ((), (), (), ())) for d in range(n)]
                made = [pa.array(np.diff(segment.first) - 1, pa.int64())]
                made += [pa.array([list(r[k]) for r in out], pa.list_(pa.int32())) for k in range(2)]
                made += [pa.array([sorted(r[k]) for r in out], pa.list_(pa.string())) for k in (2, 3)]
                place = pa.array([batch.column("segment")[i].as_py()] * n, pa.int64())
                yield pa.RecordBatch.from_arrays([place, pa.array(range(n), pa.int32()), keys, marks, *made], names=["segment", "nth", "_key", "_mark", "n_words", "starts", "ends", "items", "near"])

    return run


def search_index(index: DataFrame, benchmark: DataFrame, width: int = WINDOW, slop: int = 0, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Every indexed document: _key, _mark, n_words, spans (word positions, end exclusive, by start), items, near.

    `near` holds the items with a window all of whose words stand within slop positions of their places.
    """
    kind = dict(index.dtypes)["keys"][len("array<") : -1]
    placed = index.withColumn("segment", F.xxhash64(F.input_file_name(), F.monotonically_increasing_id()))
    hits = [store(placed.mapInArrow(_searcher(b, width, slop), f"segment long, nth int, _key {kind}, _mark string, {HITS}"), "hits") for b in blocks(benchmark, width, block_chars=block_chars)]
    found = hits[0]
    if len(hits) > 1:
        for more in hits[1:]:
            found = found.unionByName(more)
        joined = [F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends", "items", "near")]
        found = found.groupBy("segment", "nth").agg(F.first("_key").alias("_key"), F.first("_mark").alias("_mark"), F.first("n_words").alias("n_words"), *joined)
    spans = F.array_sort(F.array_distinct(F.arrays_zip(F.col("starts").alias("s"), F.col("ends").alias("e")))).cast("array<struct<start:int,end:int>>")
    distinct = lambda c: F.array_sort(F.array_distinct(F.col(c))).alias(c)
    return found.select("_key", "_mark", "n_words", spans.alias("spans"), distinct("items"), distinct("near"))


def find(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", width: int = WINDOW, slop: int = 0, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """_key, n_words, spans, items and near of every document, through an index of them."""
    return search_index(build_index(docs, key, text), benchmark, width, slop, block_chars).drop("_mark")


def covered(spans: Column) -> Column:
    """How many positions spans cover that are sorted by start; those of one document are about as long."""
    step = lambda a, x: F.struct(
        (a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["to"], x["start"]))).cast("long").alias("n"), F.greatest(a["to"], x["end"]).alias("to")
    )
    return F.aggregate(spans, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to")), step, lambda a: a["n"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without any benchmark window. Only rows that a filter of the others' keys may hold are shuffled."""
    mark = mark_of(docs, key, text)
    index = build_index(docs, key, text, mark)
    hit = store(search_index(index, benchmark).filter(F.size("spans") > 0).select("_key", "_mark").distinct())
    discard(index)
    rows = boxed(docs, _key=F.col(f"`{key}`"), _mark=mark).withColumn("_maybe", may_hold(filled(hit)))
    named = hit.withColumnsRenamed({"_key": "_k", "_mark": "_m"})
    clean = rows.filter("_maybe").join(named, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_mark") == F.col("_m")), "left_anti")
    return unboxed(clean.unionByName(rows.filter(~F.col("_maybe"))), docs)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    n_hit = covered(F.col("spans"))
    return found.select(
        F.col("_key").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


OP6_SQL = r"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
q AS (SELECT DISTINCT item, least(10, len(w)) AS k, list_slice(w, p, p + least(10, len(w)) - 1) AS g
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS p FROM i WHERE len(w) > 0)),
g AS (SELECT doc_id, p, k, list_slice(w, p, p + k - 1) AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM q) WHERE len(w) >= k)),
m AS (SELECT g.doc_id, p, g.k, item FROM g JOIN q ON g.k = q.k AND g.g = q.g),
h AS (SELECT doc_id, count(DISTINCT p + o) AS n FROM (SELECT DISTINCT doc_id, p, k FROM m), range(0, 10) AS r(o) WHERE o < k GROUP BY doc_id),
n AS (SELECT doc_id, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(n.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(n.s, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
