"""Observations as a view of the columnar tables, with the SQL that makes the same view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One observation for each event: measures some of which aren't reported, an owner that may be unknown."""
    k = F.col("_k").cast("long")
    i = F.col("event_id")
    null = F.lit(None).cast("long")
    # the generator parses each object once, however many columns use it
    return read(spark, sf_dir, "events").select("*", F.json_tuple("props", "k").alias("_k")).select(
        i.alias("off"), F.col("user_id").alias("thread"), F.col("event_type").alias("model"), "ts", k.alias("k"),
        k.alias("uncached_input"), F.when(i % 5 != 0, k * 3).alias("cache_read"), F.when(i % 7 == 0, k % 11).alias("cache_write_5m"),
        F.when(i % 13 == 0, k % 5).alias("cache_write_1h"), null.alias("cache_write_unspecified"), F.floor("value").cast("long").alias("output"),
        F.when(i % 3 == 0, F.floor(F.col("value") / 2).cast("long")).alias("reasoning"), null.alias("provider_only"),
        F.when(i % 11 != 0, F.col("ts")).alias("seen_ts"), F.when(i % 17 != 0, F.concat(F.lit("p"), (F.col("user_id") % 6).cast("string"))).alias("project"),
        F.when(i % 10 == 0, "unknown").when(i % 10 == 1, "ambiguous").otherwise("owned").alias("status"),
        F.when(i % 19 == 0, "copy_only").when(i % 23 == 0, "unresolved").otherwise("counted").alias("counting"),
    )


OBS = """obs AS (SELECT event_id AS off, user_id AS thread, event_type AS model, ts, k, k AS uncached_input,
  CASE WHEN event_id % 5 <> 0 THEN k * 3 END AS cache_read, CASE WHEN event_id % 7 = 0 THEN k % 11 END AS cache_write_5m,
  CASE WHEN event_id % 13 = 0 THEN k % 5 END AS cache_write_1h, CAST(NULL AS BIGINT) AS cache_write_unspecified,
  CAST(floor(value) AS BIGINT) AS output, CASE WHEN event_id % 3 = 0 THEN CAST(floor(value / 2) AS BIGINT) END AS reasoning,
  CAST(NULL AS BIGINT) AS provider_only, CASE WHEN event_id % 11 <> 0 THEN ts END AS seen_ts,
  CASE WHEN event_id % 17 <> 0 THEN 'p' || (user_id % 6) END AS project,
  CASE WHEN event_id % 10 = 0 THEN 'unknown' WHEN event_id % 10 = 1 THEN 'ambiguous' ELSE 'owned' END AS status,
  CASE WHEN event_id % 19 = 0 THEN 'copy_only' WHEN event_id % 23 = 0 THEN 'unresolved' ELSE 'counted' END AS counting
  FROM (SELECT *, CAST(props->>'$.k' AS BIGINT) AS k FROM events))"""

MEASURES = ("uncached_input", "cache_read", "cache_write_5m", "cache_write_1h", "cache_write_unspecified", "output", "reasoning", "provider_only")
SUMS = ", ".join(f"CAST(sum({m}) AS BIGINT) AS {m}" for m in MEASURES)
COUNTS = ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in ("owned", "ambiguous", "unknown"))


def known_sum(*names: str) -> str:
    return f"CASE WHEN coalesce({', '.join(names)}) IS NOT NULL THEN {' + '.join(f'coalesce({n}, 0)' for n in names)} END"


DERIVED = f"{known_sum(*MEASURES[2:5])} AS cache_write, {known_sum(*MEASURES[:5])} AS inclusive_input, {known_sum(*(m for m in MEASURES if m != 'reasoning'))} AS total"
