"""Importance resampling towards a target: hashed n-gram weights from bucket-partitioned inverted postings.

Every feature (a run of 1 to `width` words) falls into one of BUCKETS by its checksum. Tasks turn texts into postings
(bucket, document, count), counted for each document before anything is shuffled and packed as blocks: one row for a bucket and
a stretch of documents. The blocks of both corpora are dealt by bucket, those of one bucket over SALTS groups, so a bucket that every
document has is no task's burden. Co-grouped by bucket, the two corpora give the bucket's gain where its counts are; contributions
gain * count leave the blocks and are added up by document, at first inside each task.

A row's weight is the sum of its gains. Its score adds noise that its key and the seed decide, so the highest scores are a sample
without replacement, drawn in proportion to e^(weight / 1000). Ranks are global: rows are dealt by range of score and counted range by range.

Rows are told apart by their place, not by their key, so repeated rows and keys each get their own weight. A null or empty text has
no features and weight 0; very long texts are read in pieces. The noise of a null key is that of an empty one. Ties of score go to
the smaller key, nulls last, then to fewer features. Empty tables give empty results; an empty target gives every bucket the gain of
its own rarity. Columns other than key and text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import cut, read, slices, store

BUCKETS, WIDTH, SEED, SHARE, LEAST_WORDS = 10_000, 1, 2024, 10, 20
#: Groups that the blocks of one bucket are dealt over.
SALTS = 16
#: Features that a task packs into blocks at once, and bytes of a text that it splits at once.
AT_ONCE, PIECE = 2_000_000, 4 << 20
#: Words a task remembers the bucket of.
REMEMBERED = 1 << 20
#: Letters and digits, A-Z lower-cased, and all bytes beyond ASCII; the rest parts words.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


class _Buckets(dict):
    """The bucket of a feature, worked out once."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        bucket = self[feature] = zlib.crc32(feature) % self.buckets
        return bucket


def pieces(raw: bytes, size: int = PIECE) -> Iterator[bytes]:
    """The bytes in pieces that end before white space, so no word is cut."""
    at = 0
    while at < len(raw):
        gap = re.compile(rb"[\x20\x09-\x0D]").search(raw, at + size) if len(raw) - at > size else None
        end = gap.start() if gap else len(raw)
        yield raw[at:end]
        at = end


def features(text: str | None, width: int = WIDTH) -> Iterator[tuple[int, list[bytes]]]:
    """(words, features) of the text, piece by piece; runs reach over the pieces' ends."""
    last: list[bytes] = []
    for piece in pieces((text or "").encode().translate(_LETTERS)):
        words = piece.split()
        run = [*last, *words]
        yield len(words), words + [b" ".join(run[i : i + n]) for n in range(2, width + 1) for i in range(max(0, len(last) - n + 1), len(run) - n + 1)]
        last = run[len(run) - width + 1 :] if width > 1 else []


def _blocks(docs: list[int], found: list[np.ndarray], buckets: int) -> pa.RecordBatch | None:
    """Postings of some documents as rows, one for each bucket."""
    if not docs:
        return None
    nth, sizes = np.array(docs, np.int64), [len(x) for x in found]
    key, count = np.unique(np.concatenate(found) * len(docs) + np.repeat(np.arange(len(docs)), sizes), return_counts=True)
    bucket, doc = key // len(docs), key % len(docs)
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])[: len(key)]
    ends = pa.array(np.r_[starts, len(key)].astype(np.int32))
    lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (nth[doc], count.astype(np.int64))]
    totals = np.add.reduceat(count, starts) if len(starts) else count
    return pa.RecordBatch.from_arrays([pa.array(bucket[starts].astype(np.int32)), *lists, pa.array(totals.astype(np.int64))], names=["bucket", "docs", "counts", "total"])


def postings(docs: DataFrame, key: str, text: str, width: int = WIDTH, buckets: int = BUCKETS) -> DataFrame:
    """Rows of two kinds: a document (nth, _key, words, features), and a block (bucket, docs, counts, total)."""
    kind = docs.schema[key].dataType
    schema = pa.schema([("bucket", pa.int32()), ("docs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("total", pa.int64()), ("nth", pa.int64()), ("words", pa.int64()), ("features", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _Buckets(buckets)

        def rows(block: pa.RecordBatch | None, keys: pa.Array, **own: list) -> pa.RecordBatch:
            n = block.num_rows if block else len(keys)
            columns = [block[f.name] if block and f.name in block.schema.names else pa.array(own[f.name], f.type) if f.name in own else pa.nulls(n, f.type) for f in schema]
            return pa.RecordBatch.from_arrays([pa.nulls(n, keys.type) if block else keys, *columns], names=["_key", *schema.names])

        for batch in batches:
            keys, places, open_, found, held = batch.column(0), batch.column(1).to_pylist(), [], [], 0
            words, counts = [0] * len(places), [0] * len(places)
            for i, body in enumerate(batch.column(2)):
                for n, own in features(body.as_py(), width):
                    if own:
                        open_.append(places[i])
                        found.append(np.fromiter(map(of.__getitem__, own), np.int64, len(own)))
                    words[i], counts[i], held = words[i] + n, counts[i] + len(own), held + len(own)
                    if held > AT_ONCE:
                        yield rows(_blocks(open_, found, buckets), keys)
                        open_, found, held = [], [], 0
            if open_:
                yield rows(_blocks(open_, found, buckets), keys)
            yield rows(None, keys, nth=places, words=words, features=counts)

    picked = docs.select(F.col(f"`{key}`").alias("_key"), F.monotonically_increasing_id().alias("nth"), F.col(f"`{text}`").alias("_text"))
    return picked.mapInArrow(run, f"_key {kind.simpleString()}, bucket int, docs array<bigint>, counts array<bigint>, total bigint, nth bigint, words bigint, features bigint")


def gains(blocks: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of co-grouped blocks of both corpora (column target tells them apart); no more rows than there are buckets."""
    by = blocks.groupBy("bucket").agg(*(F.coalesce(F.sum(F.when(F.col("target") == side, F.col("total"))), F.lit(0)).cast("double").alias(n) for side, n in ((False, "s"), (True, "t"))))
    whole = by.agg(F.coalesce(F.sum("s"), F.lit(0.0)), F.coalesce(F.sum("t"), F.lit(0.0))).first()
    ratio = (F.col("t") + 1) * F.lit(whole[0] + buckets) / ((F.col("s") + 1) * F.lit(whole[1] + buckets))
    return by.select("bucket", F.floor(1000 * F.ln(ratio)).alias("gain"))


def noise(key: Column, seed: int = SEED) -> Column:
    """floor(1000 * Gumbel noise) of a key: the same wherever and whenever it is asked for."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))


def ranked(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first `most` rows in the order, with their rank: dealt by range, counted range by range, never in one task."""
    dealt = cut(rows.repartitionByRange(slices(rows), *order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each partition: bounded by their number
    offsets = dealt.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("_place", place).join(F.broadcast(offsets), "_part").withColumn("rank", (F.col("_before") + F.col("_place")).cast("long")).filter(F.col("rank") <= most).drop("_part", "_place", "_before")


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED, width: int = WIDTH, buckets: int = BUCKETS) -> DataFrame:
    """Every row's key, n_features, weight, score and rank: `share` percent of the rows of `least_words` words or more are drawn."""
    own = postings(docs, key, text, width, buckets).withColumn("target", F.lit(False))
    other = postings(target.select(F.lit(None).cast("string").alias("_none"), F.col(f"`{target_text}`").alias("_text")), "_none", "_text", width, buckets)
    other = other.filter("bucket IS NOT NULL").select(F.lit(None).cast(docs.schema[key].dataType).alias("_key"), "bucket", F.lit(None).cast("array<bigint>").alias("docs"), F.lit(None).cast("array<bigint>").alias("counts"), "total", "nth", "words", "features", F.lit(True).alias("target"))
    salt = F.pmod(F.xxhash64(F.coalesce(F.col("docs")[0], F.col("nth"), F.lit(0))), F.lit(SALTS))
    dealt = store(own.unionByName(other).repartition(slices(docs), "bucket", salt), "postings")
    blocks = dealt.filter("bucket IS NOT NULL")
    gained = blocks.filter("NOT target").join(F.broadcast(gains(blocks, buckets)), "bucket")
    each = gained.select("gain", F.explode(F.arrays_zip("docs", "counts")).alias("p"))
    weights = each.groupBy(F.col("p.docs").alias("nth")).agg(F.sum(F.col("gain") * F.col("p.counts")).alias("weight"))
    rows = dealt.filter("bucket IS NULL").select("nth", "_key", "words", F.col("features").alias("n_features")).join(weights, "nth", "left")
    rows = cut(rows.withColumn("weight", F.coalesce("weight", F.lit(0)).cast("long")).withColumn("score", (F.col("weight") + noise(F.col("_key"), seed)).cast("long")))
    fit = rows.filter(F.col("words") >= least_words)
    drawn = ranked(fit.select("nth", "_key", "n_features", "score"), [F.col("score").desc(), F.col("_key").asc_nulls_last(), F.col("n_features")], share * fit.count() // 100)
    return rows.join(drawn.select("nth", "rank"), "nth", "left").select(F.col("_key").alias(key), "n_features", "weight", "score", "rank")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("text"))


#: The checksum's table follows from its polynomial; bytes are folded in one by one, once for each different word.
OP12_SQL = r"""
WITH step AS (SELECT i, list_reduce(list_concat([i], range(1, 9)), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(0, 256) AS t(i)),
tab AS (SELECT list(v ORDER BY i) AS x FROM step),
d AS (SELECT row_number() OVER () AS nth, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS f FROM benchmark),
p AS (SELECT nth, f, count(*) AS c FROM (SELECT nth, unnest(w) AS f FROM d) GROUP BY nth, f),
q AS (SELECT f, count(*) AS c FROM b GROUP BY f),
h AS (SELECT f, octet_length(encode(f)) AS n, hex(encode(f)) AS h FROM (SELECT f FROM p UNION SELECT f FROM q)),
k AS (SELECT f, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, n), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
      lambda a, y: xor(a >> 8, x[1 + (xor(a, y) & 255)])), 4294967295) % 10000 AS bucket FROM h, tab),
s AS (SELECT bucket, sum(c) AS s FROM p JOIN k USING (f) GROUP BY bucket),
t AS (SELECT bucket, sum(c) AS t FROM q JOIN k USING (f) GROUP BY bucket),
n AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS s, (SELECT coalesce(sum(t), 0) FROM t) AS t),
g AS (SELECT s.bucket, CAST(floor(1000 * ln((coalesce(t.t, 0) + 1)::DOUBLE * (n.s + 10000)::DOUBLE / ((s.s + 1)::DOUBLE * (n.t + 10000)::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), n),
w AS (SELECT nth, CAST(sum(c * gain) AS BIGINT) AS weight FROM p JOIN k USING (f) JOIN g USING (bucket) GROUP BY nth),
r AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5)::DOUBLE / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN w USING (nth)),
o AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= (SELECT 10 * count(*) // 100 FROM r WHERE n_features >= 20) THEN place END AS rank FROM o
"""
