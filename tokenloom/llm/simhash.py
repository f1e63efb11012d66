"""SimHash near-duplicates, found by fuzzy hashing with the binary Golay code.

A document's fingerprint has a bit where over half of its shingle hashes have it. Two fingerprints link at
MAX_BITS or fewer differing bits, and a document's component is what links reach.

Keys. The 64 bits fall into segments of 23, 23 and 18 bits (the last padded with zeros). The [23,12,7] Golay
code is perfect: every 23-bit word lies within 3 bits of exactly one codeword. Take as indices of a word all
codewords within 4 bits, of which there are one or six. Two words that differ in at most two bits then share
an index: the codeword nearest to a word between them is within 4 bits of both. Of four errors over three
segments, either every segment has at most two, and the three indices together are a 36-bit key that both
fingerprints have; or one has three or four, and of the other two one is free of errors and the other has at
most one: its 23 (or 18) bits with the other's index are a key that both have. So every link shares a key,
and a key is long enough that unlike fingerprints seldom do.

Links. Fingerprints are made distinct first, so copies cost nothing. Members of a key are compared in tasks
that emit only a spanning forest of the links they find (at most one edge a member). Keys with more members
than BLOCK are cut into blocks, and each pair of blocks is one task's group. Edges become components by
repeated minima with pointer jumping, stored in the checkpoint folder after every round.

Null and empty texts have the fingerprint 0 and link like any other; very long ones are hashed whole, in steps. Rows with
a null id form components too; a component's id is its smallest id that is not null. `group` gives every row, repeated ones
among them, its row, with the three columns of its result only; `drop_near_copies` keeps all columns, whatever their names.
Empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import boxed, cut, read, salted, unboxed

SHINGLE, MAX_BITS = 4, 4
#: Members of one key that a task compares at once.
BLOCK = 2048

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Generator polynomial of the Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
_GENERATOR = 0b101011100011
_SHIFTS = ((0, 23), (23, 23), (46, 18))


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    words = _WORD.findall(text.translate(_LOWER)) if text else []
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    hashes = np.fromiter((xxhash.xxh64_intdigest(" ".join(words[i : i + width]), 42) for i in range(n)), dtype=np.uint64, count=n)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes, counted in steps that bound the memory for very long texts."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[i : i + 65536, None].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield pd.Series(np.array([fingerprint(t) for t in batch], dtype=np.uint64).view(np.int64))


def fingerprints(text: Column) -> Column:
    return F.pandas_udf(_fingerprints, "long")(text)


def syndrome(words: np.ndarray) -> np.ndarray:
    """The remainder of 23-bit words by the generator: 0 for codewords, and the same for a whole coset."""
    rest = words.astype(np.int64)
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (_GENERATOR << (bit - 11)), rest)
    return rest


def coset_patterns() -> np.ndarray:
    """For each of the 2048 syndromes the error patterns of weight 4 or less: one or six, the rest repeats the first."""
    bits = 1 << np.arange(23, dtype=np.int64)
    patterns = np.zeros(1, dtype=np.int64)
    by_weight = [patterns]
    for _ in range(4):
        grown = (by_weight[-1][:, None] | bits[None, :]).ravel()
        grown = np.unique(grown[grown != np.repeat(by_weight[-1], 23)])
        by_weight.append(grown)
    out = np.full((2048, 6), -1, dtype=np.int64)
    filled = np.zeros(2048, dtype=np.int64)
    for errors in by_weight:
        at = syndrome(errors)
        order = np.argsort(at, kind="stable")
        at, errors = at[order], errors[order]
        nth = np.arange(len(at)) - np.searchsorted(at, at)
        out[at, filled[at] + nth] = errors
        filled += np.bincount(at, minlength=2048)
    return np.where(out < 0, out[:, :1], out)


def indices(words: np.ndarray, patterns: np.ndarray) -> np.ndarray:
    """The information bits of the codewords within 4 bits of each word, six to a row."""
    return (words[:, None] ^ patterns[syndrome(words)]) >> 11


def keys(prints: np.ndarray, patterns: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(fingerprint, key) arrays in which each fingerprint has each of its keys once."""
    segment = [(prints >> np.uint64(s)).astype(np.int64) & ((1 << n) - 1) for s, n in _SHIFTS]
    index = [indices(s, patterns) for s in segment]
    own = [np.concatenate([np.ones((len(prints), 1), bool), i[:, 1:] != i[:, :1]], axis=1) for i in index]
    a, b, c = (np.broadcast_to(x, (len(prints), 6, 6, 6)) for x in (index[0][:, :, None, None], index[1][:, None, :, None], index[2][:, None, None, :]))
    keep = own[0][:, :, None, None] & own[1][:, None, :, None] & own[2][:, None, None, :]
    row = np.nonzero(keep)[0]
    yield prints[row], (a << 24 | b << 12 | c)[keep]
    kind = 0
    for exact in range(3):
        for near in range(3):
            if exact != near:
                kind += 1
                key = kind << 40 | segment[exact][:, None] << 12 | index[near]
                yield prints[np.nonzero(own[near])[0]], key[own[near]]


def _key_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    patterns = coset_patterns()
    for batch in batches:
        all_prints = batch["fp"].to_numpy().view(np.uint64)
        for i in range(0, len(all_prints), 1024):
            for fp, key in keys(all_prints[i : i + 1024], patterns):
                yield pd.DataFrame({"key": key, "fp": fp.view(np.int64)})


def spanning_edges(members: np.ndarray, others: np.ndarray | None = None, most: int = MAX_BITS) -> list[tuple[int, int]]:
    """A spanning forest of the links among members, or of those between members and others.

    Each search takes what it reaches out of the open ones, so a dense group is done in a few searches.
    """
    nodes = members if others is None else np.concatenate([members, others])
    side = np.zeros(len(nodes), bool)
    if others is not None:
        side[len(members) :] = True
    edges, left = [], np.arange(len(nodes))
    while len(left) > 1:
        root, left = left[0], left[1:]
        front = [root]
        while front and len(left):
            at = front.pop()
            near = np.bitwise_count(nodes[left] ^ nodes[at]) <= most
            if others is not None:
                near &= side[left] != side[at]
            if near.any():
                reached = left[near]
                edges += [(int(nodes[r]), int(nodes[at])) for r in reached]
                front += reached.tolist()
                left = left[~near]
    return edges


def _edge_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = set()
        for left, right in zip(batch["left"], batch["right"], strict=True):
            a = np.asarray(left, dtype=np.int64).view(np.uint64)
            b = None if right is None or not len(right) else np.asarray(right, dtype=np.int64).view(np.uint64)
            found.update((min(x, y), max(x, y)) for x, y in spanning_edges(a, b))
        out = np.array(sorted(found), dtype=np.uint64).reshape(-1, 2).view(np.int64)
        yield pd.DataFrame({"a": out[:, 0], "b": out[:, 1]})


def links(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that join what their links join."""
    spread = prints.mapInPandas(_key_rows, "key long, fp long")
    # most keys have one member and end here, in the shuffle that counts them
    shared = spread.withColumn("n", F.count("*").over(Window.partitionBy("key"))).filter("n > 1")
    sized = cut(shared.select("key", "fp", F.when(F.col("n") > block, F.ceil(F.col("n") / (block // 2))).otherwise(1).cast("int").alias("cells")))
    small = sized.filter("cells = 1").groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("left")).select("left").distinct()
    # a large key's members go to cells by a hash; each cell, and each pair of cells, is compared by itself
    hot = sized.filter("cells > 1").withColumn("cell", F.pmod(F.xxhash64("fp"), F.col("cells")))
    cells = hot.groupBy("key", "cells", "cell").agg(F.collect_list("fp").alias("left"))
    right = cells.select("key", F.col("cell").alias("cell2"), F.col("left").alias("right"))
    crossed = cells.join(right, "key").filter(F.col("cell") < F.col("cell2")).select("left", "right")
    nothing = F.lit(None).cast("array<bigint>").alias("right")
    groups = small.select("left", nothing).unionByName(cells.select("left", nothing)).unionByName(crossed)
    return groups.mapInPandas(_edge_rows, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges; root is the smallest node of its component.

    In each round all neighbours of a node move to the smallest of them and the node itself (larger ones in
    one half, smaller ones in the other), which at least halves the length of every chain.
    """
    edges = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        larger = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        smallest = larger.groupBy("a").agg(F.min("b").alias("m"))
        moved = larger.join(smallest, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = cut(moved.unionByName(smallest.select("a", F.col("m").alias("b"))).distinct())
        same = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() == edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        edges = after
        if same:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def rooted(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """Distinct fingerprints with their columns and root, which is the smallest fingerprint of the component."""
    root = components(links(prints.select("fp"), block))
    own = [c for c in prints.columns if c != "fp"]
    return prints.join(root, prints["fp"] == root["node"], "left").select("fp", *own, F.coalesce("root", "fp").alias("root"))


def group(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """Every row's key, fingerprint (16 hex digits) and component_id. The rows of a hot fingerprint or component are dealt over several tasks."""
    rows = cut(docs.select(F.col(f"`{key}`").alias("_key"), fingerprints(F.col(f"`{text}`")).alias("fp"), F.monotonically_increasing_id().alias("nth")))
    prints = cut(rows.groupBy("fp").agg(F.min("_key").alias("least"), F.count("*").alias("n")))
    found = cut(rooted(prints, block))
    named = salted(found, found.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("k")), "root", F.xxhash64("fp"))
    named = named.select("fp", "component_id", F.col("n").alias("k"))
    return salted(rows, named, "fp", F.col("nth")).select(F.col("_key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component: that with the smallest key (rows without one come last), then by hashes of text and row.

    Only rows alike in all columns are interchangeable. Rows of other components stay, whatever keys they share or lack.
    """
    own = [F.col(f"`{c}`") for c in docs.columns]
    marks = [F.xxhash64(F.lit(i), *(x for c in own for x in (c.isNull(), c))) for i in range(2)]
    marked = boxed(docs, _key=F.col(f"`{key}`"), _one=marks[0], _two=marks[1])
    place = F.struct(F.col("_key").isNull().alias("unnamed"), F.col("_key").alias("key"), F.xxhash64(F.col("_row").getField(text)).alias("text"), F.col("_one").alias("one"), F.col("_two").alias("two"))
    rows = cut(marked.select(fingerprints(F.col("_row").getField(text)).alias("fp"), place.alias("place")))
    prints = cut(rows.groupBy("fp").agg(F.min("place").alias("least")))
    chosen = rooted(prints).groupBy("root").agg(F.min("least").alias("least"))
    chosen = cut(chosen.select(F.col("least.one").alias("_one"), F.col("least.two").alias("_kept_two")).distinct())
    chosen = chosen.join(rows.groupBy(F.col("place.one").alias("_one")).agg(F.count("*").alias("k")), "_one")
    kept = salted(marked, chosen, "_one", F.col("_two")).filter(F.col("_two") == F.col("_kept_two"))
    # rows alike in all columns have equal marks: one of them stays
    return unboxed(kept.dropDuplicates(["_one", "_two"]), docs)


def op7_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group(read(spark, sf_dir, "documents").select("doc_id", "text"))
