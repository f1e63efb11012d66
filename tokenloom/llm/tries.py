"""Prefix tries of conversations by partition refinement.

All conversations start as one class. A round splits the active classes turn by turn over a stride of turns: a member's class
after a turn is its class before with the turn's digest, and members that agree are one node. A class that has become a
single conversation is retired after the round; the rest of it is a chain without branches, which needs no grouping and is emitted
from its length alone. Classes that are still shared go on with a stride twice as long, so long shared histories need few
rounds. Then results fold back, last round first: each shared node gives its sums to its forerunners in the stride and to the class
that the stride began with, which takes them along into the round before.

Turns are dealt by range and counted range by range, so one conversation may hold most of all turns, and all of them may be the
same: the rows of hot conversations, classes and parents are dealt over tasks (`salted`), counts are summed in part first.
SHA-256 of a node's members is one sequential stream: its ids are joined in many tasks, and one task hashes the joined pieces.

Turns and classes go by 128 bits of SHA-256. Turns are in the order of `turn` (nulls first), equal ones in that of role, then
of the digest. A null role or text counts as empty; rows without a conversation are left out. Texts of any length, repeated rows (each is a
turn), other columns of any name and empty tables (no node, not even the root) are fine.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import cut, read, salted, slices, store

#: Turns of the first round's stride, and of the longest.
FIRST_STRIDE, LONGEST_STRIDE = 4, 64
#: The query's rebuild: conversations of a block of so many ids begin with turns of the first, fewer than so many.
BLOCK, PREFIXES = 20, 4
#: Ids that are joined into one piece, and nodes of a chain that one row unfolds to.
PIECE, CHAIN = 1 << 16, 1 << 12
_WORD = r"[^\x20\x09-\x0D]+"
_ROOT = b""


def _digest(data: Column) -> Column:
    return F.substring(F.unhex(F.sha2(data, 256)), 1, 16)


def placed(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The turns (conv, at, digest, tokens), where `at` numbers them over the whole table, and the conversations (conv, start, length)."""
    said, body = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role, text))
    digest = _digest(F.concat(F.length(said).cast("string"), F.lit(":"), said, body).cast("binary"))
    rows = turns.filter(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), said.alias("role"), digest.alias("digest"), F.regexp_count(body, F.lit(_WORD)).cast("long").alias("tokens")
    )
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    dealt = rows.repartitionByRange(slices(turns), *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    dealt = cut(dealt.select("conv", "digest", "tokens", F.call_function("shiftright", F.col("_at"), F.lit(33)).alias("_part"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_nth")))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each partition: bounded by their number
    offsets = dealt.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = dealt.join(F.broadcast(offsets), "_part").select("conv", (F.col("_before") + F.col("_nth")).alias("at"), "digest", "tokens")
    return numbered, cut(numbered.groupBy("conv").agg(F.min("at").alias("start"), F.count("*").alias("length")))


def in_order(turns: DataFrame, **names: str) -> tuple[DataFrame, DataFrame]:
    """The turns (conv, d from 1, digest, tokens) and the conversations (conv, length), as they are."""
    rows, convs = placed(turns, **names)
    own = salted(rows, convs.select("conv", "start", F.col("length").alias("k")), "conv", F.col("at"))
    return own.select("conv", (F.col("at") - F.col("start") + 1).alias("d"), "digest", "tokens"), convs.select("conv", "length")


def rebuilt(turns: DataFrame, block: int = BLOCK, prefixes: int = PREFIXES, **names: str) -> tuple[DataFrame, DataFrame]:
    """As `in_order`, after each conversation's first h turns have given way to the first h of its block's first conversation; h is its id's checksum modulo `prefixes`."""
    rows, convs = placed(turns, **names)
    convs = convs.withColumns({"h": F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(prefixes)), "base": F.col("conv") - F.col("conv") % block})
    bases = convs.select(F.col("conv").alias("base"), F.col("length").alias("_has"))
    # no more than 2 * block - 1 conversations have the same base
    convs = cut(convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("_has", F.lit(0)))))
    own = salted(rows, convs.select("conv", "start", "h", "taken", F.col("length").alias("k")), "conv", F.col("at")).withColumn("pos", F.col("at") - F.col("start") + 1)
    first = own.filter((F.col("conv") % block == 0) & (F.col("pos") < prefixes)).select(F.col("conv").alias("base"), "pos", "digest", "tokens")
    lent = convs.select("conv", "base", "h").join(first, "base").filter(F.col("pos") <= F.col("h")).select("conv", F.col("pos").alias("d"), "digest", "tokens")
    kept = own.filter(F.col("pos") > F.col("h")).select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("d"), "digest", "tokens")
    return kept.unionByName(lent), convs.select("conv", (F.col("taken") + F.greatest(F.col("length") - F.col("h"), F.lit(0))).alias("length"))


def _stride(turns: DataFrame, active: DataFrame, after: int, stride: int) -> DataFrame:
    """A row for each active conversation and turn of the stride: the node it reaches, the path there from the class `top`, whether it ends there."""
    window = turns.filter((F.col("d") > after) & (F.col("d") <= after + stride)).join(active, "conv")
    whole = window.groupBy("conv", "top", "length").agg(F.sort_array(F.collect_list(F.struct("d", "digest", "tokens"))).alias("turns"))  # no more than a stride
    start = F.struct(F.col("top").alias("node"), F.array().cast("array<binary>").alias("path"))

    def split(at: Column, turn: Column) -> Column:
        node = _digest(F.concat(at["node"], turn["digest"]))
        return F.struct(node.alias("node"), F.concat(at["path"], F.array(node)).alias("path"))

    paths = whole.withColumn("path", F.aggregate("turns", start, split, lambda at: at["path"]))
    each = paths.select("conv", "top", "length", "path", F.posexplode("turns").alias("i", "turn"))
    parent = F.when(F.col("i") == 0, F.col("top")).otherwise(F.try_element_at("path", F.col("i")))
    return each.select("conv", "top", F.col("turn.d").alias("d"), F.col("turn.tokens").alias("tokens"), F.slice("path", F.lit(1), F.col("i") + 1).alias("path"), F.element_at("path", F.col("i") + 1).alias("node"), parent.alias("parent"), "length", (F.col("turn.d") == F.col("length")).alias("last"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of sorted rows (node, conv), joined node by node."""

    def rows(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.string()))], names=["node", "first", "ids"])

    node, ids = None, []
    for batch in batches:
        out = []
        for at, conv in zip(batch["node"].to_pylist(), batch["conv"].to_pylist(), strict=True):
            if ids and (at != node or len(ids) >= PIECE):
                out.append((node, ids[0], ",".join(map(str, ids))))
                ids = []
            node = at
            ids.append(conv)
        yield rows(out)
    if ids:
        yield rows([(node, ids[0], ",".join(map(str, ids)))])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's pieces in their order, one piece in memory at a time."""

    def rows(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.string())], names=["node", "ends_sha256"])

    node, state = None, None
    for batch in batches:
        out = []
        for at, ids in zip(batch["node"], batch["ids"], strict=True):
            at = at.as_py()
            if state is not None and at == node:
                state.update(b",")
            else:
                if state is not None:
                    out.append((node, state.hexdigest()))
                node, state = at, hashlib.sha256()
            state.update(ids.as_py().encode())
        yield rows(out)
    if state is not None:
        yield rows([(node, state.hexdigest())])


def ends_of(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of rows (node, conv): the ids in ascending order."""
    runs = ends.repartitionByRange(slices(ends), "node", "conv").sortWithinPartitions("node", "conv").mapInArrow(_pieces, "node binary, first long, ids string")
    return runs.repartition(slices(ends), "node").sortWithinPartitions("node", "first").mapInArrow(_hashed, "node binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame, first_stride: int = FIRST_STRIDE, longest_stride: int = LONGEST_STRIDE) -> DataFrame:
    """One row for each node of the trie of `turns` (conv, d from 1, digest, tokens) and `convs` (conv, length; turnless ones too).

    conv_id is the smallest member, and with depth names the node; see the columns at the end.
    """
    turns = store(turns.repartitionByRange(slices(turns), "d", "conv"), "turns")  # a round reads its stride only
    convs = cut(convs)
    active, after, stride = convs.filter("length > 0").withColumn("top", F.lit(_ROOT)), 0, first_stride
    rounds: list[tuple[DataFrame, DataFrame]] = []
    tails = []
    while True:
        rows = store(_stride(turns, active, after, stride), "splits")
        same = (F.first(c).alias(c) for c in ("d", "top", "parent", "path", "tokens"))
        nodes = store(rows.groupBy("node").agg(*same, F.min("conv").alias("conv_id"), F.count("*").alias("n"), F.max("last").alias("ended")), "nodes")
        rounds.append((rows, nodes))
        after += stride
        on = rows.filter((F.col("d") == after) & ~F.col("last")).select("conv", "length", "node")
        shared = nodes.filter((F.col("d") == after) & (F.col("n") > 1)).select("node", F.col("n").alias("k"), F.lit(True).alias("shared"))
        on = cut(salted(on, shared, "node", F.xxhash64("conv"), how="left"))
        tails.append(on.filter("shared IS NULL").select("conv", F.lit(after).cast("long").alias("after"), "length"))
        active = on.filter("shared").select("conv", "length", F.col("node").alias("top"))
        if active.isEmpty():
            break
        stride = min(2 * stride, longest_stride)

    def union(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    every = union([n for _, n in rounds])
    root = convs.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n"), F.max(F.col("length") == 0).alias("ended")).filter("n > 0")
    root = root.select(F.lit(_ROOT).alias("node"), F.lit(0).cast("long").alias("d"), "conv_id", "n", F.lit(0).cast("long").alias("tokens"))
    inner = every.filter("n > 1").select("node", "d", "conv_id", "n", "tokens").unionByName(root)
    kids = every.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("kids"), F.count_if(F.col("n") == 1).alias("lone"))
    own = inner.join(kids, "node", "left").select(
        "node", "d", "conv_id", "n", F.coalesce("kids", F.lit(0)).alias("kids"), F.when(F.col("kids").isNull(), 1).otherwise(F.col("lone")).cast("long").alias("leaves"), ((F.col("n") - 1) * F.col("tokens")).alias("saved")
    )
    own = store(own, "inner")
    # back from the last round: what a class collects below it goes into the stride that it ends
    carried, totals = None, []
    for _, nodes in reversed(rounds):
        paths = nodes.filter("n > 1").select("node", F.concat(F.array("top"), "path").alias("above"))
        given = paths.join(own.select("node", "leaves", "saved"), "node").select("above", "leaves", "saved")
        if carried is not None:
            given = given.unionByName(paths.join(carried, "node").select("above", "leaves", "saved"))
        sums = cut(given.select(F.explode("above").alias("node"), "leaves", "saved").groupBy("node").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")))
        carried = sums.join(nodes.select("top").distinct(), F.col("node") == F.col("top"), "left_semi")
        totals.append(sums.join(nodes.select("node"), "node", "left_semi"))
    totals.append(carried.unionByName(own.filter("d = 0").select("node", "leaves", "saved")).groupBy("node").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")))
    totals = union(totals)
    ends = union([r.filter("last").select("node", "conv") for r, _ in rounds]).unionByName(convs.filter("length = 0").select(F.lit(_ROOT).alias("node"), "conv"))
    none, of_one = F.sha2(F.lit("").cast("binary"), 256), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)

    parents = own.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("kids").alias("k"))
    children = salted(every.select("node", "parent", "d", "conv_id", "n", "ended"), parents, "parent", F.xxhash64("node"), how="left")
    children = children.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "conv_id"))  # a lone node's child is the same conversation's
    wide = own.filter("n > 1 OR d = 0").join(totals.withColumnsRenamed({"leaves": "n_leaves", "saved": "saved_tokens"}), "node").join(ends_of(ends), "node", "left")
    wide = wide.join(children.filter("n > 1").select("node", "parent_conv_id"), "node", "left")
    out = [F.col("conv_id").cast("long"), F.col("d").cast("long").alias("depth"), F.col("parent_conv_id").cast("long"), F.col("n").alias("n_convs")]
    many = wide.select(*out, F.col("kids").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))
    single = children.filter("n = 1").select(*out, F.when(F.col("ended"), 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(F.col("ended"), of_one).otherwise(none).alias("ends_sha256"))
    starts = union(tails).select("conv", "length", F.explode(F.sequence(F.col("after") + 1, F.col("length"), F.lit(CHAIN).cast("long"))).alias("from"))
    chain = starts.select(F.col("conv").alias("conv_id"), "length", F.explode(F.sequence("from", F.least(F.col("length"), F.col("from") + CHAIN - 1))).alias("d")).withColumns({"parent_conv_id": F.col("conv_id"), "n": F.lit(1).cast("long")})
    chain = chain.select(*out, (F.col("d") < F.col("length")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(F.col("d") == F.col("length"), of_one).otherwise(none).alias("ends_sha256"))
    return many.unionByName(single).unionByName(chain)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*rebuilt(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))


#: The checksum's table follows from its polynomial; bytes are folded in one by one.
OP13_SQL = r"""
WITH step AS (SELECT i, list_reduce(list_concat([i], range(1, 9)), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(0, 256) AS t(i)),
tab AS (SELECT list(v ORDER BY i) AS x FROM step),
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
e AS (SELECT conv_id, count(*) AS len, hex(encode(CAST(conv_id AS VARCHAR))) AS hx FROM t GROUP BY conv_id),
c AS (SELECT conv_id, len, conv_id - conv_id % 20 AS base, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, len(hx) // 2), lambda i: CAST('0x' || substr(hx, 2 * i + 1, 2) AS BIGINT))),
      lambda a, y: xor(a >> 8, x[1 + (xor(a, y) & 255)])), 4294967295) % 4 AS h FROM e, tab),
r AS (SELECT c.conv_id, pos AS d, role, text FROM c JOIN t ON t.conv_id = base AND pos <= h
  UNION ALL SELECT c.conv_id, pos - c.h + least(c.h, coalesce(b.len, 0)), role, text FROM c JOIN t ON t.conv_id = c.conv_id AND pos > c.h LEFT JOIN c b ON b.conv_id = c.base),
s AS (SELECT c.conv_id, coalesce(list(sha256(length(role) || ':' || role || text) ORDER BY d) FILTER (d IS NOT NULL), []) AS seq, coalesce(list(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) ORDER BY d) FILTER (d IS NOT NULL), []) AS tok FROM c LEFT JOIN r USING (conv_id) GROUP BY c.conv_id),
m AS (SELECT conv_id, unnest(range(0, len(seq) + 1)) AS d, seq, tok FROM s),
n AS (SELECT d, array_to_string(seq[1:d], '') AS p, any_value(seq[1:d]) AS path, min(conv_id) AS conv_id, count(*) AS n, any_value(coalesce(tok[d], 0)) AS tok, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(seq) = d), '') AS ends FROM m GROUP BY 1, 2),
k AS (SELECT array_to_string(path[1:d - 1], '') AS p, count(*) AS kids FROM n WHERE d > 0 GROUP BY 1),
u AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN k USING (p)),
a AS (SELECT unnest(list_transform(range(0, d + 1), lambda i: array_to_string(path[1:i], ''))) AS p, (kids = 0)::INT AS leaf, CASE WHEN d = 0 THEN 0 ELSE (n - 1) * tok END AS saved FROM u),
f AS (SELECT p, sum(leaf) AS leaves, sum(saved) AS saved FROM a GROUP BY p)
SELECT u.conv_id, CAST(u.d AS BIGINT) AS depth, q.conv_id AS parent_conv_id, u.n AS n_convs, u.kids AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(u.ends) AS ends_sha256
FROM u JOIN f USING (p) LEFT JOIN n q ON u.d > 0 AND q.p = array_to_string(u.path[1:u.d - 1], '')
"""
