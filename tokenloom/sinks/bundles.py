"""Bundles of observations: a folder that can be taken elsewhere and merged there any number of times.

A bundle has its observations as Parquet, the extents of each source that they were read from, and a manifest with digests. A store is a folder of
observations and extents made of imported bundles. An observation is known by its place (locator and offset): what a store has already it takes no second time, so importing
twice, overlapping or partly covered bundles gives the observations of their union, and reconciliation over the store gives the union's totals.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.operators.joins import dealt_join, extent_relation, merged

PLACE = ["locator", "offset"]
FORMAT = 1


class DamagedBundle(ValueError):
    """A bundle's rows aren't those its manifest names."""


class ConflictingBundle(ValueError):
    """A bundle has other rows at places that the store knows."""


def _content(rows: DataFrame, to: str = "_content") -> DataFrame:
    """The rows with a digest of all their columns, whatever their order and types."""
    names = sorted(rows.columns)
    return rows.withColumn(to, F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in names)), {"ignoreNullFields": "false"}).cast("binary"), 256))


def digest(rows: DataFrame) -> str:
    """One digest of a table's rows in any order: how many there are, and the sum of 128 bits of each."""
    part = lambda i: F.conv(F.substring("_content", i, 15), 16, 10).cast("decimal(38,0)")
    n, a, b = _content(rows).agg(F.count("*"), F.coalesce(F.sum(part(1)), F.lit(0)), F.coalesce(F.sum(part(16)), F.lit(0))).first()
    return f"{n}:{int(a):x}:{int(b):x}"


def write_bundle(observations: DataFrame, extents: DataFrame, path: str) -> dict:
    """Writes observations (with locator and offset, each place once) and the extents read (locator, begin, end); returns the manifest."""
    spark = observations.sparkSession
    observations.write.option("compression", "zstd").parquet(f"{path}/observations")
    merged(extents, ["locator"], "begin", "end").write.parquet(f"{path}/extents")
    made = {"format": FORMAT, "observations": digest(spark.read.parquet(f"{path}/observations")), "extents": digest(spark.read.parquet(f"{path}/extents"))}
    spark.createDataFrame([(json.dumps(made, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/manifest")
    return made


def read_bundle(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """(observations, extents, manifest) of a bundle whose digests hold."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    observations, extents = (spark.read.parquet(f"{path}/{part}") for part in ("observations", "extents"))
    if manifest["format"] != FORMAT or digest(observations) != manifest["observations"] or digest(extents) != manifest["extents"]:
        raise DamagedBundle(path)
    return observations, extents, manifest


def _there(spark: SparkSession, path: str, part: str, like: DataFrame) -> DataFrame:
    """What the store has, which may be nothing yet."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{part}")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], like.schema)
    return spark.read.option("mergeSchema", True).parquet(f"{path}/{part}")


def import_bundle(spark: SparkSession, store: str, path: str) -> dict:
    """Takes a bundle into a store; returns how many observations and sources were new, and how sources relate to what the store had.

    Each write is an append of rows that the store lacks, so one that was broken off is made good by importing again.
    """
    observations, extents, _ = read_bundle(spark, path)
    had, known = _there(spark, store, "observations", observations), _there(spark, store, "extents", extents)
    relations = {r["relation"]: r["count"] for r in extent_relation(known, extents, ["locator"]).groupBy("relation").count().collect()}  # three rows
    content = _content(had).select(*PLACE, F.col("_content").alias("_had"))
    both = dealt_join(_content(observations), content, PLACE, F.xxhash64("offset"))
    if not both.filter("_content <> _had").isEmpty():
        raise ConflictingBundle(path)
    new = dealt_join(observations, had.select(*PLACE), PLACE, F.xxhash64("offset"), "left_anti")
    count = new.count()
    if count:
        new.write.mode("append").option("compression", "zstd").parquet(f"{store}/observations")
    if any(k != "covered" for k in relations):
        extents.write.mode("append").parquet(f"{store}/extents")
    return {"observations": count, **relations}


def stored(spark: SparkSession, store: str) -> tuple[DataFrame, DataFrame]:
    """(observations, extents) of a store."""
    return spark.read.option("mergeSchema", True).parquet(f"{store}/observations"), merged(spark.read.parquet(f"{store}/extents"), ["locator"], "begin", "end")
