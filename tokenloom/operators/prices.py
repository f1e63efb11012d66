"""List prices in force: rates by model, time and size, picked in each request's row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Example rates: per million tokens, for a span of time, from a size on.
_RATES = """VALUES ('click', '2024-01-01', '2024-01-15', 0, 3.0), ('click', '2024-01-15', NULL, 0, 2.5), ('click', '2024-01-15', NULL, 200, 5.0),
  ('view', '2024-01-01', NULL, 0, 1.0), ('view', '2024-01-01', NULL, 100, 1.5), ('purchase', '2024-01-10', '2024-01-20', 0, 15.0), ('error', '2024-01-01', NULL, 0, 0.25)"""
_COLUMNS = "model, CAST(a AS {kind}) AS effective_from, CAST(b AS {kind}) AS effective_until, CAST(threshold AS BIGINT) AS threshold, CAST(rate AS DECIMAL(18, 6)) AS rate"
RATES_SQL = f"rates AS (SELECT {_COLUMNS.format(kind='TIMESTAMP')} FROM ({_RATES}) AS t(model, a, b, threshold, rate))"


def rates(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT {_COLUMNS.format(kind='TIMESTAMP_NTZ')} FROM {_RATES} AS t(model, a, b, threshold, rate)")


#: Rates that are broadcast at most.
MOST = 100_000


def with_rate(requests: DataFrame, table: DataFrame, key: str, instant: str, size: str, most: int = MOST) -> DataFrame:
    """Requests with the rate in force: of the bands that the size reaches, the highest. Null if none applies.

    A price list of up to `most` rows is broadcast as an array for each model, and requests aren't shuffled. Beyond,
    requests and rates are joined by model, and the best band is found by the request's key.
    """
    at, reached = F.col(instant), F.col(size)
    inside = lambda b: (at >= b["effective_from"]) & (b["effective_until"].isNull() | (at < b["effective_until"])) & (reached >= b["threshold"])
    band = F.struct("effective_from", "effective_until", "threshold", "rate")
    if table.limit(most + 1).count() <= most:
        bands = table.groupBy(F.col("model").alias("_model")).agg(F.collect_list(band).alias("_bands"))
        reaching = F.transform(F.filter("_bands", inside), lambda b: F.struct(b["threshold"], b["rate"]))
        found = requests.join(F.broadcast(bands), F.col("model") == F.col("_model"), "left")
        return found.withColumn("rate", F.array_max(reaching)["rate"]).drop("_model", "_bands")
    rates_ = table.select(F.col("model").alias("_model"), band.alias("_band"))
    found = requests.select(key, "model", instant, size).join(rates_, (F.col("model") == F.col("_model")) & inside(F.col("_band")))
    best = found.groupBy(key).agg(F.max(F.struct("_band.threshold", "_band.rate"))["rate"].alias("rate"))
    return requests.join(best, key, "left")
