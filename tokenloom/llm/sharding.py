"""Contiguous shards of near-equal bytes: global prefix sums from per-partition totals, cut at equal targets.

DataFrame functions only. Rows are ordered by their key (nulls first), then by the checksum and size of their
text, so equal rows are the only ones whose order is open; they are interchangeable. A null text counts as no
bytes, an empty table gives an empty result. Only keys, sizes and checksums are shuffled, never texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import cut, read, slices

SHARDS = 8


def shard_by_bytes(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """Columns: the key, size, text_crc32, shard and slot (gapless from 0 within each shard).

    The rows are dealt by range into partitions and stored, so that partition numbers stay what they are.
    Each partition's total is one row; the running sum over those few rows is the only global one.
    A row goes to the shard in which the middle of its bytes falls.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    rows = docs.select(F.col(f"`{key}`").alias("_key"), (F.length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    dealt = rows.repartitionByRange(slices(docs), F.col("_key").asc_nulls_first(), "text_crc32", "size")
    dealt = cut(dealt.withColumn("_part", F.spark_partition_id()))
    totals = dealt.groupBy("_part").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each partition: bounded by the number of partitions, not by the data
    offsets = totals.select(
        "_part",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        F.sum("_bytes").over(Window.partitionBy()).alias("_all_bytes"),
    )
    within = Window.partitionBy("_part").orderBy(F.col("_key").asc_nulls_first(), "text_crc32", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumns({"_bytes_to": F.sum("size").over(within), "_rows_to": F.row_number().over(Window.partitionBy("_part").orderBy(F.col("_key").asc_nulls_first(), "text_crc32", "size"))})
    placed = placed.join(F.broadcast(offsets), "_part")
    middle = 2 * (F.col("_bytes_before") + F.col("_bytes_to")) - F.col("size")
    placed = placed.withColumns(
        {"shard": F.least(F.lit(shards - 1), (middle * shards - F.pmod(middle * shards, 2 * F.col("_all_bytes"))) / (2 * F.col("_all_bytes"))).cast("int"), "_row": F.col("_rows_before") + F.col("_rows_to") - 1}
    )
    # one row for each partition and shard that meet
    first = placed.groupBy("shard").agg(F.min("_row").alias("_first"))
    return placed.join(F.broadcast(first), "shard").select(
        F.col("_key").alias(key), "size", "text_crc32", "shard", (F.col("_row") - F.col("_first")).cast("long").alias("slot")
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_by_bytes(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The checksum's table follows from its polynomial; bytes are folded in one by one.
OP9_SQL = r"""
WITH step AS (SELECT i, list_reduce(list_concat([i], range(1, 9)), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(0, 256) AS t(i)),
tab AS (SELECT list(v ORDER BY i) AS x FROM step),
b AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, CAST(size AS BIGINT) AS size,
    CAST(xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, size - 1), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
      lambda a, k: xor(a >> 8, x[1 + (xor(a, k) & 255)])), 4294967295) AS BIGINT) AS text_crc32 FROM b, tab),
p AS (SELECT *, CAST(sum(size) OVER w AS BIGINT) AS upto, CAST(sum(size) OVER () AS BIGINT) AS total,
    row_number() OVER w AS n FROM c WINDOW w AS (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING)),
q AS (SELECT *, CAST(least(7, ((2 * upto - size) * 8) // (2 * total)) AS INTEGER) AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, CAST(n - min(n) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM q
"""
