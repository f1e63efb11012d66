"""Substring dedup by content-defined chunking with a gear rolling hash.

The gear hash of a position mixes its last 16 bytes, each shifted by its distance. A chunk ends where that
hash is the largest within REACH bytes on both sides, so a cut depends on the bytes nearby and on nothing else:
an insertion moves the chunks after it, but doesn't change them, and every copy of a passage has the same cuts
inside. Chunks are longer than REACH bytes (but for those at a text's ends); their length is variable and has
no upper bound, as in a long run of one byte.

Chunks are deduplicated by a 128-bit digest of their bytes. The first occurrence (smallest id, then place) of
a chunk stays, later ones go. All chunks take part: those of a cut text have REACH bytes or more, also at its
ends, and a text of up to 2 * REACH bytes is one chunk, so an exact copy loses all its bytes. First occurrences are found by partial aggregation before the shuffle; digests that
occur once never reach the join.

Null and empty texts have no chunks; very long ones are chunked whole. Where rows share an id, they are told apart by
128 bits of their text; rows that share both are one document, and each of them gets its row. A null id comes first.
Empty tables give empty results. Other columns, whatever their names, pass through; those called like a result are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm.common import boxed, discard, filled, mark_of, may_hold, read, salted, store, unboxed

REACH, MIN_BYTES, GEAR_WINDOW = 48, 1, 16
#: The gear table: 256 fixed pseudo-random numbers.
GEAR = np.random.default_rng(20).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of GEAR[data[i-k]] << k for k under 16, built by doubling the window."""
    h, width = GEAR[data], 1
    while width < GEAR_WINDOW:
        longer = h.copy()
        longer[width:] += h[:-width] << np.uint32(width)
        h, width = longer, 2 * width
    return h


def window_max(x: np.ndarray, n: int) -> np.ndarray:
    """The largest of x[i : i + n], for each i at which n values are left."""
    m, width = x, 1
    while 2 * width <= n:
        m, width = np.maximum(m[:-width], m[width:]), 2 * width
    return np.maximum(m[: len(x) - n + 1], m[n - width : len(x) - width + 1]) if n > width else m


def cuts(data: np.ndarray, reach: int = REACH) -> np.ndarray:
    """Ends of chunks, the length of the data last; ties of the hash give no cut but at their first place."""
    if len(data) <= 2 * reach:
        return np.array([len(data)] if len(data) else [], dtype=np.int64)
    h = gear_hashes(data)
    around = window_max(h, reach)
    middle = h[reach:-reach]
    at = np.flatnonzero((middle > around[: len(middle)]) & (middle >= around[reach + 1 : reach + 1 + len(middle)])) + reach + 1
    return np.append(at[at < len(data)], len(data)).astype(np.int64)


def chunk(text: str | None) -> list[tuple[int, int, bytes]]:
    """(start, length, digest) of a text's chunks, in UTF-8 bytes."""
    raw = (text or "").encode()
    ends = cuts(np.frombuffer(raw, dtype=np.uint8)).tolist()
    return [(s, e - s, xxhash.xxh3_128_digest(raw[s:e])) for s, e in zip([0, *ends][:-1], ends, strict=True)]


def _chunk_rows(least: int):
    columns = ["_key", "_mark", "start", "length", "digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [batch.column(0).type, batch.column(1).type, pa.int32(), pa.int32(), pa.binary()]
            rows, size = [], 0

            def made(rows: list[tuple], kinds: list[pa.DataType] = kinds) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=columns)

            for key, mark, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                rows += [(key, mark, s, n, d) for s, n, d in chunk(text) if n >= least]
                size += len(text or "")
                if size > 4_000_000:
                    yield made(rows)
                    rows, size = [], 0
            yield made(rows)

    return run


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = MIN_BYTES) -> DataFrame:
    """One row for each chunk of at least `least` bytes: _key, _mark (tells rows with the same id apart), start, length, digest."""
    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(f"`{key}`").alias("_key"), mark_of(docs, key, text).alias("_mark"), F.col(f"`{text}`").alias("_text"))
    return rows.mapInArrow(_chunk_rows(least), f"_key {kind}, _mark string, start int, length int, digest binary")


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = MIN_BYTES) -> DataFrame:
    """(_key, _mark, spans) of every document with chunks that occur earlier; spans are sorted (start, length).

    The texts are chunked once; digests that occur once never reach the join, and the rows of a digest are dealt over several tasks.
    """
    all_chunks = store(chunks(docs, key, text, least), "chunks")
    place = F.struct("_key", "_mark", "start")
    first = all_chunks.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("k")).filter("k > 1")
    later = salted(all_chunks, first, "digest", F.xxhash64("_key", "_mark", "start")).filter(~place.eqNullSafe(F.col("first")))
    spans = store(later.groupBy("_key", "_mark").agg(F.sort_array(F.collect_set(F.struct("start", "length"))).alias("spans")), "spans")
    discard(all_chunks)
    return spans


def _cut_out(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, spans in batches:
        out = []
        for text, found in zip(texts, spans, strict=True):
            raw, at, kept = (text or "").encode(), 0, []
            runs = 0
            for s in found if found is not None else ():
                runs += not kept or s["start"] > at
                kept.append(raw[at : s["start"]])
                at = s["start"] + s["length"]
            kept.append(raw[at:])
            left = b"".join(kept)
            out.append((left, runs))
        yield pd.DataFrame(out, columns=["kept", "runs"])


def remove_repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = MIN_BYTES) -> DataFrame:
    """The documents with columns _spans (what was removed), _kept (the bytes left) and _runs.

    Documents without a repeated chunk, as a filter tells, are not shuffled.
    """
    spans = repeated(docs, key, text, least)
    rows = boxed(docs, _key=F.col(f"`{key}`"), _mark=mark_of(docs, key, text), _text=F.col(f"`{text}`")).withColumn("_maybe", may_hold(filled(spans)))
    named = spans.withColumnsRenamed({"_key": "_k", "_mark": "_m"})
    found = rows.filter("_maybe").join(named, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_mark") == F.col("_m")), "left").drop("_k", "_m")
    rest = rows.filter(~F.col("_maybe")).withColumn("spans", F.lit(None).cast("array<struct<start:int,length:int>>"))
    cut = found.unionByName(rest).withColumn("_cut", F.pandas_udf(_cut_out, "kept binary, runs int")(F.col("_text"), F.col("spans")))
    return unboxed(cut, docs, _spans=F.col("spans"), _kept=F.col("_cut.kept"), _runs=F.col("_cut.runs"))


def kept_digest(text: str | None, spans: list[tuple[int, int]]) -> str:
    raw, at, out = (text or "").encode(), 0, hashlib.sha256()
    for s, n in spans:
        out.update(raw[at:s])
        at = s + n
    out.update(raw[at:])
    return out.hexdigest()


def op3_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    removed = F.coalesce(F.aggregate("_spans", F.lit(0).cast("long"), lambda a, x: a + x["length"]), F.lit(0)).cast("long")
    return remove_repeated(docs).select(
        "doc_id", n_bytes.alias("n_bytes"), removed.alias("n_removed"), F.greatest(F.size("_spans"), F.lit(0)).cast("long").alias("n_chunks_removed"),
        F.sha2("_kept", 256).alias("kept_sha256"),
    )
