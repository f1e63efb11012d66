"""Queries of pairs along an order, intervals and mergeable summaries, each beside the SQL it is held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenloom.operators import histograms, joins, ordered
from tokenloom.plans.queries import query
from tokenloom.plans.tables import OBS, observations, read

_W = "(PARTITION BY user_id ORDER BY ts, event_id)"


def _events(spark, d):
    return read(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))


@query(
    f"WITH e AS (SELECT event_id, user_id, event_type, ts, CAST(props->>'$.k' AS BIGINT) % 2 AS v, count(*) FILTER (WHERE event_type = 'purchase') OVER {_W} AS s FROM events),"
    f" l AS (SELECT *, CASE WHEN lag(event_type) OVER w <> event_type AND lag(v) OVER w = v AND lag(s) OVER w = s THEN 0 ELSE 1 END AS starts FROM e WINDOW w AS {_W}),"
    f" r AS (SELECT *, sum(starts) OVER {_W} AS run FROM l), n AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS place, count(*) OVER (PARTITION BY user_id, run) AS size FROM r)"
    " SELECT event_id, user_id, (place % 2 = 0 OR place < size) AS paired FROM n"
)
def counter_twins(spark, d):
    """Neighbours of different kinds with equal values, each in one pair at most, none across a section."""
    rows = _events(spark, d)
    sections = F.expr(f"count_if(event_type = 'purchase') OVER {_W}")
    return ordered.paired_neighbours(rows.withColumn("s", sections), ["user_id"], ["ts", "event_id"], F.col("event_type"), F.col("k") % 2, F.col("s")).select("event_id", "user_id", "paired")


@query(
    "WITH e AS (SELECT *, CASE event_type WHEN 'click' THEN 'covered' WHEN 'purchase' THEN 'counted' END AS x FROM events)"
    " SELECT event_id, user_id, coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),"
    " first_value(x IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) AS role FROM e"
)
def counter_roles(spark, d):
    """The role of the nearest usage event before, else of the first one."""
    known = F.when(F.col("event_type") == "click", "covered").when(F.col("event_type") == "purchase", "counted")
    return ordered.nearest_known(read(spark, d, "events"), ["user_id"], ["ts", "event_id"], known, "role").select("event_id", "user_id", "role")


@query(
    "WITH e AS (SELECT *, epoch_us(ts) // 1000000 AS s, CAST(props->>'$.k' AS BIGINT) AS k FROM events), w AS (SELECT user_id, event_id AS recorded, s - k * 1200 AS starts, s AS ends FROM e WHERE event_type = 'error' AND k > 0)"
    " SELECT e.event_id, e.user_id, w.recorded FROM e JOIN w ON e.user_id = w.user_id AND e.s >= w.starts AND e.s < w.ends"
)
def usage_windows(spark, d):
    """Each event with the recorded windows of its stream that it falls in."""
    rows = _events(spark, d).withColumn("s", F.unix_seconds(F.col("ts").cast("timestamp")))
    limits = rows.filter("event_type = 'error'").select("user_id", F.col("event_id").alias("recorded"), F.col("s").alias("resets_at"), (F.col("k") * 20).alias("window_minutes"))
    windows = joins.recorded_windows(limits).select("user_id", "recorded", "starts", "ends")
    return joins.in_windows(rows.select("event_id", "user_id", "s"), windows, ["user_id"], "s").select("event_id", "user_id", "recorded")


@query(
    f"WITH {OBS}, b AS (SELECT model, off, output AS x, floor(log2(greatest(output, 1)) + 1e-12) AS p FROM obs WHERE output IS NOT NULL), c AS (SELECT *, CASE WHEN x <= 0 THEN -1 ELSE CAST(p * 8 + floor((x / pow(2.0, p) - 1) * 8) AS BIGINT) END AS bucket FROM b),"
    " n AS (SELECT model, bucket, count(*) AS n FROM c GROUP BY ALL), s AS (SELECT model, string_agg(bucket || ':' || n, ',' ORDER BY bucket) AS buckets FROM n GROUP BY 1),"
    " t AS (SELECT model, string_agg(x || ':' || off, ',' ORDER BY x DESC, off DESC) AS top FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY x DESC, off DESC) AS i FROM c) WHERE i <= 5 GROUP BY 1)"
    " SELECT model, count(*) AS count, min(x) AS min, max(x) AS max, CAST(sum(x) AS BIGINT) AS sum, any_value(buckets) AS buckets, any_value(top) AS top FROM c JOIN s USING (model) JOIN t USING (model) GROUP BY 1"
)
def merged_histograms(spark, d):
    """States of a stream's shards, merged to one for each model."""
    shards = histograms.histogram_state(observations(spark, d), ["model", "thread"], "output", "off")
    one = histograms.merge_states(shards, ["model"])
    buckets = F.array_join(F.transform(F.array_sort(F.map_entries("buckets")), lambda e: F.concat_ws(":", e["key"], e["value"])), ",")
    top = F.array_join(F.transform("top", lambda t: F.concat_ws(":", t["value"], t["id"])), ",")
    return one.select("model", "count", "min", "max", "sum", buckets.alias("buckets"), top.alias("top"))


@query(
    "WITH e AS (SELECT user_id, event_id AS b, event_id + CAST(props->>'$.k' AS BIGINT) * 3 AS z, event_type FROM events), a AS (SELECT DISTINCT user_id, unnest(range(b, z)) AS x FROM e WHERE event_type IN ('view', 'click')),"
    " t AS (SELECT DISTINCT user_id, unnest(range(b, z)) AS x FROM e WHERE event_type = 'error'), n AS (SELECT t.user_id, count(*) AS size, count(a.x) AS shared FROM t LEFT JOIN a USING (user_id, x) GROUP BY 1)"
    " SELECT user_id, CASE WHEN shared = 0 THEN 'disjoint' WHEN shared = size THEN 'covered' ELSE 'partial' END AS relation FROM n"
)
def extent_relations(spark, d):
    """Whether one set of a stream's extents covers another's, or shares nothing with it."""
    rows = _events(spark, d).select("user_id", "event_type", F.col("event_id").alias("begin"), (F.col("event_id") + F.col("k") * 3).alias("end"))
    return joins.extent_relation(rows.filter("event_type IN ('view', 'click')"), rows.filter("event_type = 'error'"), ["user_id"], cell=64)
