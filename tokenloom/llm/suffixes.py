"""Exact substring dedup with a logarithmic family of sparse suffix arrays.

A byte goes if a WIDTH-byte string covers it that also starts earlier (smaller id, or same document, earlier).

Sparse suffixes. Of the GRAM-byte strings inside every WIDTH-byte window one is its minimizer (least hash, the
leftmost of equals). Equal windows have equal minimizers at equal places, so suffixes need to be kept at
minimizers only, about one in thirty positions. The windows with the same minimizer are neighbours; together
they span a segment. An index entry is (hash of the minimizer, hash of the segment, key, place of the
segment, number of its windows, place of the minimizer in it, short hashes of the bytes on its two sides). A run holds a batch's entries in the order of
minimizer and segment, that is, a suffix array cut at the depth that decides about matches of WIDTH bytes, in the
order of fingerprints.

Index family. Documents come in batches of ascending ids. A level is a table bucketed by minimizer, so a scan
shuffles the new batch only and merges it with the levels where they lie: entries that follow
an equal segment are matches of all their windows; unequal segments with the same minimizer are partial matches,
to be resolved. What is new becomes a level; two levels of equal rank merge into one of the next rank, without
a shuffle, so an entry is rewritten a logarithmic number of times.

Copies and hot minimizers. A task that makes entries marks those whose segment it has seen at an earlier place in
the same CHUNK bytes of text: they are matches already, become one row for each run of them, and are dealt over all tasks. Minimizers that a sample of
documents shows to be frequent are dealt over SPREAD tasks by segment and count as shared. Neither changes a result.

Partial matches. A window reaches half its length beyond the minimizer on one side at least, so only segments that
share the bytes of a side with another are looked at. Every window has an offset to its minimizer; the windows
of a segment whose offsets lie in the same block of BLOCK share a core of WIDTH - BLOCK + 1 bytes. Blocks whose bytes occur
earlier are matches; of the others, windows whose core occurs in unlike blocks are digested one by one, and a
digest's first place stays. All steps are counts and minima, so no group is ever held by a task, whatever its size.

Null and empty texts have no bytes. Rows with the same id are ordered by hashes of their text (32, then 128 bits);
rows equal in all are one document and each gets its row. A null id comes first; ids may have any type that has
an order. Very long texts are read whole, in pieces. Empty tables give empty results. Other columns, whatever
their names, pass through; one called like the result column is replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import boxed, delete, discard, filled, mark_of, may_hold, new_folder, read, salted, slices, store, unboxed

WIDTH, GRAM = 100, 24
#: Batches a whole table is inserted in; window offsets of one core.
BATCHES, BLOCK = 2, 16
#: Text in which a task looks for copies by itself; tasks that a frequent minimizer is dealt over.
CHUNK, SPREAD = 4 << 20, 32
#: Documents in the sample that shows frequent minimizers, and in how many of them one is frequent.
SAMPLE_ROWS, FREQUENT = 4000, 12
_PIECE = 1 << 19
#: The hash of a side on which the text ends too soon.
_ENDS = 0xFFFF
_MIX, _BASE = np.uint64(0xBF58476D1CE4E5B9), 0x9E3779B97F4A7C15


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 32-bit hash of each gram, in the upper half of 64 bits: polynomials joined from powers of two."""
    power, width, factor = data.astype(np.uint64) + np.uint64(1), 1, _BASE
    total, done = None, 0
    while width <= gram:
        if gram & width:
            if total is None:
                total, done = power, width
            else:
                n = len(data) - done - width + 1
                total = total[:n] * np.uint64(factor) + power[done : done + n]
                done += width
        n = len(data) - 2 * width + 1
        if n <= 0:
            break
        power, factor, width = power[:n] * np.uint64(factor) + power[width : width + n], factor * factor % (1 << 64), 2 * width
    total = total[: len(data) - gram + 1]
    mixed = (total ^ (total >> np.uint64(29))) * _MIX
    return mixed & np.uint64(0xFFFFFFFF00000000)


def minimizers(data: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(minimizer of each window, its hash), for the windows in order."""
    spots = width - gram + 1
    x = gram_hashes(data, gram) | np.arange(len(data) - gram + 1, dtype=np.uint64)
    m, w = x, 1
    while 2 * w <= spots:
        m, w = np.minimum(m[:-w], m[w:]), 2 * w
    n = len(data) - width + 1
    m = np.minimum(m[:n], m[spots - w : spots - w + n])
    return (m & np.uint64(0xFFFFFFFF)).astype(np.int64), (m >> np.uint64(32)).astype(np.int64)


def segments(raw: bytes, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, minimizer, minimizer's hash) of each segment, in order.

    Very long texts are cut into pieces that overlap by a window; the runs at a cut are joined again.
    """
    n = len(raw) - width + 1
    if n < 1:
        return (np.zeros(0, np.int64),) * 4
    data, at, value = np.frombuffer(raw, dtype=np.uint8), [], []
    for i in range(0, n, _PIECE):
        a, v = minimizers(data[i : min(i + _PIECE, n) + width - 1], width, gram)
        at.append(a + i)
        value.append(v)
    at, value = np.concatenate(at), np.concatenate(value)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return first, np.diff(np.append(first, n)), at[first], value[first]


def _entry_rows(width: int, gram: int, hot: np.ndarray) -> Callable:
    """Entries of the documents of a partition, in chunks; the first place of a segment in a chunk is not `again`."""

    def rows(docs: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
        docs = [d for i, d in enumerate(docs) if i == 0 or d[1:3] != docs[i - 1][1:3]]  # rows that are one document
        found = [segments(raw, width, gram) for *_, raw in docs]
        size = [len(f[0]) for f in found]
        first, n, at, value = (np.concatenate([f[i] for f in found]) for i in range(4))
        seg = np.empty(len(first), dtype=np.uint64)
        owner = np.repeat(np.arange(len(docs)), size)
        for i, (d, f, k) in enumerate(zip(owner.tolist(), first.tolist(), n.tolist(), strict=True)):
            seg[i] = xxhash.xxh3_64_intdigest(docs[d][3][f : f + k + width - 1])
        again = pd.DataFrame({"v": value, "s": seg}).duplicated().to_numpy()
        half = (width - gram) // 2
        sides = []
        for before in (True, False):
            side = np.full(len(first), _ENDS, dtype=np.int32)
            for i in np.flatnonzero(~again).tolist():
                raw, p = docs[owner[i]][3], int(at[i])
                lo, hi = (p - half, p) if before else (p + gram, p + gram + half)
                if lo >= 0 and hi <= len(raw):
                    side[i] = xxhash.xxh3_64_intdigest(raw[lo:hi]) % _ENDS
            sides.append(side)
        # neighbours that are copies become one row
        tied = again[1:] & again[:-1] & (owner[1:] == owner[:-1]) & (first[1:] == first[:-1] + n[:-1])
        head = np.flatnonzero(np.concatenate([[True], ~tied])) if len(first) else np.zeros(0, np.int64)
        n = np.add.reduceat(n, head) if len(head) else n
        first, at, value, seg, owner, again = (x[head] for x in (first, at, value, seg, owner, again))
        salt = np.where(np.isin(value, hot), 1 + seg % np.uint64(SPREAD), 0).astype(np.int32)
        salt[again] = 1 + SPREAD + np.arange(int(again.sum())) % 1024
        of = pa.array(owner)
        keys, marks = (pa.array([d[i] for d in docs], kinds[i - 1]).take(of) for i in (1, 2))
        # few wide columns: rows of many narrow ones take more room in a shuffle
        info = (at - first).astype(np.int64) << 32 | sides[0][head].astype(np.int64) << 16 | sides[1][head]
        plain = [salt.astype(np.int64) << 32 | value, seg.view(np.int64), first.astype(np.int64) << 32 | n, info]
        gram_, seg_, span, info_ = map(pa.array, plain)
        return pa.RecordBatch.from_arrays([gram_, seg_, keys, marks, span, info_], names=list(_ENTRY))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, kinds = [], 0, None
        for batch in batches:
            kinds = [batch.column(i).type for i in range(2)]
            for i in range(batch.num_rows):
                raw = (batch.column(2)[i].as_py() or "").encode()
                if len(raw) >= width:
                    key = batch.column(0)[i].as_py()
                    held.append((key is not None, key, batch.column(1)[i].as_py(), raw))
                    size += len(raw)
                if size >= CHUNK:
                    yield rows(sorted(held, key=lambda d: (d[0], d[1] if d[0] else 0, d[2])), kinds)
                    held, size = [], 0
        if held:
            yield rows(sorted(held, key=lambda d: (d[0], d[1] if d[0] else 0, d[2])), kinds)

    return run


def entries(rows: DataFrame, width: int = WIDTH, gram: int = GRAM, hot: np.ndarray | None = None) -> DataFrame:
    """A batch's index entries, from _key, _mark and _text, in few wide columns.

    gram: salt and minimizer, the salt dealing frequent minimizers and marking repeats in a chunk; seg: the segment's hash;
    span: its first window and their number; info: the minimizer's offset in it and the hashes of its two sides.
    """
    kind = dict(rows.dtypes)["_key"]
    schema = f"gram long, seg long, _key {kind}, _mark string, span long, info long"
    return rows.select("_key", "_mark", "_text").mapInArrow(_entry_rows(width, gram, np.zeros(0, np.int64) if hot is None else hot), schema)


def _salt() -> Column:
    return F.shiftright("gram", 32)


def frequent_minimizers(rows: DataFrame, width: int = WIDTH, gram: int = GRAM, sample_rows: int = SAMPLE_ROWS, frequent: int = FREQUENT) -> np.ndarray:
    """Minimizers with many segments in a sample: a hint for dealing the work, bounded by the sample's entries."""
    share = min(1.0, sample_rows / max(1, rows.count()))
    seen = entries(rows.sample(fraction=share, seed=17), width, gram).filter(_salt() == 0).groupBy("gram").count().filter(F.col("count") >= frequent)
    return np.sort(np.array([r["gram"] for r in seen.select("gram").collect()], dtype=np.int64))


_OLD, _NEW = 0, 1
_PLACE = ("_key", "_mark", "lo")
_ENTRY = ("gram", "seg", "_key", "_mark", "span", "info")


def _again() -> Column:
    return _salt() > SPREAD


def _lo() -> Column:
    return F.shiftright("span", 32).cast("int").alias("lo")


def _n() -> Column:
    return F.col("span").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("n")


def merge_scan(new: DataFrame, levels: list[DataFrame], parts: int) -> DataFrame:
    """New entries and the levels in one order, each with age (_NEW or _OLD), nth (from 1) among equal segments,
    and whether its minimizer has several segments, one of them new (`shared`).

    Only the new entries are shuffled: levels lie as they are needed. Rows that are one document share their places.
    """
    both = new.repartition(parts, "gram").withColumn("age", F.lit(_NEW))
    for level in levels:
        both = both.unionByName(level.withColumn("age", F.lit(_OLD)))
    over = Window.partitionBy("gram")
    nth = F.rank().over(Window.partitionBy("gram", "seg").orderBy("age", *(F.col(c).asc_nulls_first() for c in ("_key", "_mark", "span"))))
    ranked = both.withColumn("nth", nth)
    several = (F.count(F.when(F.col("nth") == 1, 1)).over(over) > 1) & (F.max(F.when(F.col("nth") == 1, F.col("age"))).over(over) == _NEW)
    return ranked.withColumn("shared", ~_again() & ((_salt() > 0) | several))


class Family:
    """Levels of the index by rank, and what scans against them have found."""

    def __init__(self, spark: SparkSession, parts: int):
        self.spark, self.parts = spark, parts
        self.levels: dict[int, DataFrame] = {}
        self.tables: list[tuple[str, str]] = []
        self.whole: list[DataFrame] = []
        self.partial: list[DataFrame] = []

    def _bucketed(self, df: DataFrame) -> DataFrame:
        """A written table, bucketed by minimizer, in the shared folder."""
        name, path = f"level_{uuid.uuid4().hex}", new_folder(self.spark, "level")
        self.tables.append((name, path))
        df.write.bucketBy(self.parts, "gram").option("compression", "zstd").option("path", path).saveAsTable(name)
        return self.spark.table(name)

    def insert(self, new: DataFrame, last: bool = False) -> None:
        """Scan a batch against every level, then make it a level; the last batch needn't become one."""
        scanned = merge_scan(new, list(self.levels.values()), self.parts)
        fresh, first = F.col("age") == _NEW, (F.col("nth") == 1) & ~_again()
        found = fresh & ~first | first & F.col("shared")
        scanned = self._bucketed(scanned.filter(found if last else found | fresh))
        self.whole.append(scanned.filter(fresh & ~first).select("_key", "_mark", _lo(), _n()))
        self.partial.append(scanned.filter(first & F.col("shared")).select(*_ENTRY))
        if last:
            return
        rank, run = 0, scanned.filter(fresh & first).select(*_ENTRY)
        while rank in self.levels:
            run = self._bucketed(run.unionByName(self.levels.pop(rank)))
            rank += 1
        self.levels[rank] = run

    def discard(self) -> None:
        """Deletes every table of the family; what they found must be stored elsewhere by then."""
        for name, path in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            delete(self.spark, path)


def _texts_at(rows: DataFrame, places: DataFrame) -> DataFrame:
    """_key, _mark, _text and places of the documents that places name; others aren't shuffled, as a filter tells."""
    few = rows.filter(may_hold(filled(places)))
    named = places.withColumnsRenamed({"_key": "_k", "_mark": "_m"})
    return few.join(named, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_mark") == F.col("_m"))).select("_key", "_mark", "_text", "places")


def _by_text(make: Callable, columns: list[str], fields: tuple[str, ...], most: int = 50_000) -> Callable:
    """Rows made from each document's bytes and places (arrays of numbers), handed on in bounded batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            types = {"_key": batch.column(0).type, "_mark": batch.column(1).type, "core": pa.int64(), "own": pa.int64(), "high": pa.int64(), "low": pa.int64(), "lo": pa.int32(), "n": pa.int32()}
            out: list[list] = [[] for _ in columns]
            for i in range(batch.num_rows):
                key, mark, raw = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), (batch.column(2)[i].as_py() or "").encode()
                places = batch.column(3)[i].values
                for row in make(raw, *(places.field(f).to_numpy(zero_copy_only=False).tolist() for f in fields)):
                    for x, v in zip(out, (key, mark, *row), strict=True):
                        x.append(v)
                    if len(out[0]) >= most:
                        yield pa.RecordBatch.from_arrays([pa.array(x, types[c]) for c, x in zip(columns, out, strict=True)], names=columns)
                        out = [[] for _ in columns]
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, types[c]) for c, x in zip(columns, out, strict=True)], names=columns)

    return run


def _cores(width: int, block: int) -> Callable:
    """(hash of the core, hash of all bytes, first window, windows) of each block of a segment."""
    core = width - block + 1

    def make(raw: bytes, los: list[int], ns: list[int], offs: list[int]) -> Iterator[tuple]:
        for lo, n, off in zip(los, ns, offs, strict=True):
            for b in range((off - n + 1) // block, off // block + 1):
                last = lo + off - block * b
                start, end = max(lo, last - block + 1), min(lo + n - 1, last)
                own = xxhash.xxh3_64_intdigest(raw[start : end + width]) - (1 << 63)
                yield xxhash.xxh3_64_intdigest(raw[last : last + core], b) - (1 << 63), own, start, end - start + 1

    return make


def _digests(width: int) -> Callable:
    def make(raw: bytes, los: list[int], ns: list[int]) -> Iterator[tuple]:
        for lo, n in zip(los, ns, strict=True):
            for i in range(lo, lo + n):
                digest = xxhash.xxh3_128_intdigest(raw[i : i + width])
                yield (digest >> 64) - (1 << 63), (digest & 0xFFFFFFFFFFFFFFFF) - (1 << 63), i

    return make


def resolve(rows: DataFrame, partial: DataFrame, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """Byte spans (_key, _mark, start, end) of the windows in partial matches that also start earlier."""
    kind = dict(rows.dtypes)["_key"]
    spread = F.xxhash64("_key", "_mark", "lo")

    def by_document(df: DataFrame, *columns: str) -> DataFrame:
        return store(df.groupBy("_key", "_mark").agg(F.collect_set(F.struct(*columns)).alias("places")))

    side = lambda bits: F.shiftright("info", bits).bitwiseAND(F.lit(_ENDS))
    minimizer = F.col("gram").bitwiseAND(F.lit(0xFFFFFFFF))
    context = F.explode(F.array(*(F.when(side(bits) != _ENDS, F.xxhash64(minimizer, F.lit(bits), side(bits))) for bits in (16, 0))))
    sided = partial.select("seg", "_key", "_mark", _lo(), _n(), F.shiftright("info", 32).cast("int").alias("off"), context.alias("context")).filter("context IS NOT NULL")
    several = sided.groupBy("context").agg(F.min("seg").alias("a"), F.max("seg").alias("b"), F.count("*").alias("k")).filter("a <> b").select("context", "k")
    places = by_document(salted(sided, several, "context", spread), "lo", "n", "off")
    blocks = store(_texts_at(rows, places).mapInArrow(_by_text(_cores(width, block), ["_key", "_mark", "core", "own", "lo", "n"], ("lo", "n", "off")), f"_key {kind}, _mark string, core long, own long, lo int, n int"))
    place = F.struct(*_PLACE)
    # blocks of the same bytes: all but the first are matches
    unlike = store(blocks.groupBy("core", "own").agg(F.min(F.struct(*_PLACE, "n")).alias("first"), F.count("*").alias("k")))
    copies = salted(blocks, unlike.filter("k > 1"), ["core", "own"], spread).filter(~place.eqNullSafe(F.struct(*(F.col(f"first.{c}") for c in _PLACE))))
    # unlike blocks with the same core may share some windows
    shared = unlike.groupBy("core").agg(F.count("*").alias("k")).filter("k > 1")
    held = by_document(salted(unlike.select("core", "first.*"), shared, "core", spread), "lo", "n")
    windows = store(_texts_at(rows, held).mapInArrow(_by_text(_digests(width), ["_key", "_mark", "high", "low", "lo"], ("lo", "n")), f"_key {kind}, _mark string, high long, low long, lo int"))
    first = windows.groupBy("high", "low").agg(F.min(place).alias("first"), F.count("*").alias("k")).filter("k > 1")
    later = salted(windows, first, ["high", "low"], spread).filter(~place.eqNullSafe(F.col("first"))).withColumn("n", F.lit(1))
    both = copies.select(*_PLACE, "n").unionByName(later.select(*_PLACE, "n"))
    found = store(both.select("_key", "_mark", F.col("lo").alias("start"), (F.col("lo") + F.col("n") - 1 + width).alias("end")))
    discard(places, blocks, unlike, held, windows)
    return found


def _batches(rows: DataFrame, n: int) -> list[DataFrame]:
    """The rows in n parts of ascending keys, of about as many rows each; nulls come first."""
    if n == 1:
        return [rows]
    key = F.col("_key")
    dealt = rows.select("_key").filter(key.isNotNull()).repartitionByRange(n, "_key").groupBy(F.spark_partition_id().alias("p")).agg(F.max("_key").alias("top"), F.count("*").alias("rows"))
    ranges = sorted((r["top"], r["rows"]) for r in dealt.collect())  # a row for each range, of which a session may make more than n
    whole, seen, at = sum(c for _, c in ranges), 0, []
    for top, c in ranges[:-1]:
        seen += c
        if len(at) + 1 < n and seen * n >= whole * (len(at) + 1):
            at.append(top)
    edges = [None, *at, None]
    out = []
    for low, high in zip(edges, edges[1:], strict=False):
        inside = F.lit(True) if low is None else key > F.lit(low)
        inside = inside if high is None else inside & (key <= F.lit(high))
        out.append(rows.filter(inside | key.isNull() if low is None else inside))
    return out


def repeated_spans(rows: DataFrame, width: int = WIDTH, gram: int = GRAM, batches: int = BATCHES, block: int = BLOCK, parts: int | None = None) -> DataFrame:
    """Byte spans (_key, _mark, start, end) to remove from rows of _key, _mark and _text; they may overlap."""
    family = Family(rows.sparkSession, slices(rows, parts))
    hot = frequent_minimizers(rows, width, gram)
    pieces = _batches(rows, batches)
    for i, part in enumerate(pieces):
        family.insert(entries(part, width, gram, hot), last=i + 1 == len(pieces))
    union = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(union(frames[1:]))
    whole = union(family.whole).select("_key", "_mark", F.col("lo").alias("start"), (F.col("lo") + F.col("n") - 1 + width).alias("end"))
    windows = resolve(rows, union(family.partial), width, block)
    spans = store(whole.unionByName(windows).groupBy("_key", "_mark").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans")))
    family.discard()
    discard(windows)
    return spans


def _cut_out(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, spans in batches:
        out = []
        for text, found in zip(texts, spans, strict=True):
            raw, at, kept, runs = (text or "").encode(), 0, [], []
            for s in found if found is not None else ():
                if runs and s["start"] <= at:
                    runs[-1][1] = max(runs[-1][1], s["end"])
                else:
                    kept.append(raw[at : s["start"]])
                    runs.append([s["start"], s["end"]])
                at = max(at, s["end"])
            kept.append(raw[at:])
            out.append((b"".join(kept), [{"start": s, "end": e} for s, e in runs]))
        yield pd.DataFrame(out, columns=["kept", "runs"])


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM, batches: int = BATCHES, block: int = BLOCK, to: str = "_cut") -> DataFrame:
    """The documents with a column `to`: kept (the bytes left) and runs (maximal removed spans of bytes).

    Documents without a finding, as the filter tells, are not shuffled.
    """
    rows = boxed(docs, _key=F.col(f"`{key}`"), _mark=mark_of(docs, key, text), _text=F.col(f"`{text}`"))
    spans = repeated_spans(rows.select("_key", "_mark", "_text"), width, gram, batches, block)
    tested = rows.withColumn("_maybe", may_hold(filled(spans)))
    named = spans.withColumnsRenamed({"_key": "_k", "_mark": "_m"})
    found = tested.filter("_maybe").join(named, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_mark") == F.col("_m")), "left").drop("_k", "_m")
    rest = tested.filter(~F.col("_maybe")).withColumn("spans", F.lit(None).cast("array<struct<start:int,end:int>>"))
    cut_out: Column = F.pandas_udf(_cut_out, "kept binary, runs array<struct<start:int,end:int>>")(F.col("_text"), F.col("spans"))
    return unboxed(found.unionByName(rest), docs, **{to: cut_out})


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return cut.select(
        "doc_id", n_bytes.alias("n_bytes"), (n_bytes - F.octet_length("_cut.kept")).alias("n_removed"),
        F.size("_cut.runs").cast("long").alias("n_spans"), F.sha2("_cut.kept", 256).alias("kept_sha256"),
    )
