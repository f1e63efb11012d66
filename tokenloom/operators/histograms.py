"""Mergeable summaries of counts: log-linear histograms with extremes, sum and the largest values.

A state is one row: sparse counts by bucket, count, min, max, sum and the N largest (value, id). States of any split of the rows merge, in any order and
any grouping, to the state of all of them; so days, shards or sources are summarized once and stored, and questions are asked of merged states.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.operators.ordered import log_linear_bucket

TOP = 5


def _largest(rows: DataFrame, by: list[str], most: int) -> DataFrame:
    """The largest pairs (_t) of each group, in order. Each task keeps no more than `most` of a group before anything is shuffled."""
    w = Window.partitionBy(*by).orderBy(F.desc("_t"))
    kept = rows.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= most)
    return kept.groupBy(*by).agg(F.sort_array(F.collect_list("_t"), asc=False).alias("top"))


def _joined(parts: list[DataFrame], by: list[str]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, by) if by else out.join(F.broadcast(p), F.lit(True))  # without groups: a row each
    return out.select(*by, "buckets", "count", "min", "max", "sum", "top")


def _buckets(counts: DataFrame, by: list[str]) -> DataFrame:
    return counts.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_bucket", "_n")))).alias("buckets"))


def histogram_state(rows: DataFrame, by: list[str], value: str, id_: str, top: int = TOP, per_octave: int = 8) -> DataFrame:
    """One state for each group's known values; a group without any has none. Values are counted by bucket before anything meets its group."""
    known = rows.filter(F.col(value).isNotNull()).withColumn("_bucket", log_linear_bucket(F.col(value), per_octave))
    counts = known.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    rest = known.groupBy(*by).agg(F.count("*").alias("count"), F.min(value).alias("min"), F.max(value).alias("max"), F.sum(value).alias("sum"))
    pairs = known.select(*by, F.struct(F.col(value).alias("value"), F.col(id_).alias("id")).alias("_t"))
    return _joined([_buckets(counts, by), rest, _largest(pairs, by, top)], by)


def merge_states(states: DataFrame, by: list[str], top: int = TOP) -> DataFrame:
    """The state of each group of states."""
    counts = states.select(*by, F.explode("buckets").alias("_bucket", "_n")).groupBy(*by, "_bucket").agg(F.sum("_n").alias("_n"))
    rest = states.groupBy(*by).agg(F.sum("count").alias("count"), F.min("min").alias("min"), F.max("max").alias("max"), F.sum("sum").alias("sum"))
    return _joined([_buckets(counts, by), rest, _largest(states.select(*by, F.explode("top").alias("_t")), by, top)], by)


def quantile_bounds(state: Column, percent: int, per_octave: int = 8) -> Column:
    """(low, high): what the nearest-rank percentile of a state (a struct) lies between, both ends included."""
    entries = F.array_sort(F.map_entries(state["buckets"]))
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("bucket"))

    def walk(at: Column, e: Column) -> Column:
        seen = at["seen"] + e["value"]
        return F.struct(seen.alias("seen"), F.when(at["bucket"].isNotNull(), at["bucket"]).when(seen * 100 >= state["count"] * percent, e["key"]).alias("bucket"))

    bucket = F.aggregate(entries, start, walk)["bucket"]
    power, part = F.floor(bucket / per_octave), F.pmod(bucket, F.lit(per_octave))
    edge = lambda k: F.ceil(F.pow(F.lit(2.0), power) * (1 + k / per_octave)).cast("long")
    low = F.when(bucket < 0, F.least(F.lit(0).cast("long"), state["min"])).otherwise(F.greatest(edge(part), state["min"]))
    high = F.when(bucket < 0, F.lit(0).cast("long")).otherwise(F.least(edge(part + 1) - 1, state["max"]))
    return F.when(bucket.isNotNull(), F.struct(low.alias("low"), high.alias("high")))
