"""Queries of reports as documents: order, text, hours, selections with agents, changed sources. Each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenloom.operators import rollups, selection
from tokenloom.plans.queries import _FOREST, query
from tokenloom.plans.tables import OBS, SUMS, observations, read
from tokenloom.sinks import documents
from tokenloom.sources import changes

_RANKED = "('counter-reset', 10), ('counter-gap', 11), ('malformed-line', 23), ('pending-tail', 24), ('conflicting-reread', 0)"
_KIND_OF = (("click", "counter-reset"), ("view", "counter-gap"), ("error", "malformed-line"), ("purchase", "pending-tail"), ("signup", "conflicting-reread"))


@query(f"WITH {OBS} SELECT date_trunc('hour', seen_ts) AS start, count(*) AS requests, {SUMS} FROM obs GROUP BY 1")
def hourly(spark, d):
    return observations(spark, d).groupBy(F.date_trunc("hour", "seen_ts").cast("timestamp_ntz").alias("start")).agg(F.count("*").alias("requests"), *rollups.measure_sums())


@query(
    f"WITH c(model, code) AS (VALUES {', '.join(str(p) for p in _KIND_OF)}), r(code, place) AS (VALUES {_RANKED})"
    " SELECT r.place, c.code, user_id AS subject, count(*) AS occurrences FROM events JOIN c ON model = event_type JOIN r USING (code) GROUP BY 1, 2, 3"
)
def diagnostics_places(spark, d):
    """Diagnostics with the place of their code in the order of reports."""
    code = F.lit(None).cast("string")
    for kind, name in _KIND_OF:
        code = F.when(F.col("event_type") == kind, name).otherwise(code)
    each = read(spark, d, "events").groupBy(code.alias("code"), F.col("user_id").alias("subject")).agg(F.count("*").alias("occurrences"))
    return each.select(documents.rank(F.col("code"), documents.CODES).alias("place"), "code", "subject", "occurrences").orderBy(*documents.diagnostics_order("code", "subject"))


@query(
    f"WITH {OBS}, g AS (SELECT CAST(seen_ts AS DATE) AS date, count(*) AS requests, CAST(sum(output) AS BIGINT) AS output, CAST(sum(cache_write_5m) AS BIGINT) AS w FROM obs GROUP BY 1)"
    " SELECT coalesce(strftime(date, '%Y-%m-%d'), '-') || ' | ' || format('{:,}', requests) || ' | ' || coalesce(format('{:,}', output), '-') || ' | ' || coalesce(format('{:,}', w), '-') AS line FROM g"
)
def daily_text(spark, d):
    """The daily report as lines of a text table, dates in order, requests without one last."""
    rows = rollups.daily(observations(spark, d), "seen_ts").withColumn("requests", F.col("owned") + F.col("ambiguous") + F.col("unknown"))
    return documents.text_table(rows, ["date", "requests", "output", "cache_write_5m"], documents.daily_order())


@query(
    f"WITH RECURSIVE {_FOREST}, t AS (SELECT 'n1' AS node UNION ALL SELECT 'n2' UNION ALL SELECT child FROM t JOIN e ON parent = node)"
    " SELECT DISTINCT node AS id FROM t WHERE node LIKE 'n%' OR CAST(substr(node, 2) AS BIGINT) % 3 = 1"
)
def covered_threads(spark, d):
    """Two nations by two selectors of a session, with their descendants, of the agents that a filter names."""
    nations = read(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.lit("one").alias("agent"))
    agent = F.when(F.col("c_custkey") % 3 == 0, "three").when(F.col("c_custkey") % 3 == 1, "two").otherwise("four")
    customers = read(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("parent"), agent.alias("agent"))
    threads = nations.unionByName(customers)
    asked = selection.any_of([threads.filter(F.col("id") == i).select("id") for i in ("n1", "n2")])
    return selection.covered(threads, threads.select("parent", F.col("id").alias("child")), [asked], agents=("one", "two"))


@query(
    "WITH b AS (SELECT event_id AS path, CAST(floor(value) AS BIGINT) AS length, ts AS modified, user_id AS first FROM events WHERE event_id % 10 <> 1),"
    " a AS (SELECT event_id AS path, CAST(floor(value) AS BIGINT) + CASE event_id % 10 WHEN 2 THEN -1 WHEN 3 THEN 5 ELSE 0 END AS length, ts + CASE WHEN event_id % 10 IN (3, 4) THEN INTERVAL 1 SECOND ELSE INTERVAL 0 SECOND END AS modified,"
    " user_id + CASE WHEN event_id % 10 IN (2, 5) THEN 1 ELSE 0 END AS first FROM events WHERE event_id % 10 <> 6),"
    " j AS (SELECT coalesce(b.path, a.path) AS path, CASE WHEN b.path IS NULL THEN 'new' WHEN a.path IS NULL THEN 'vanished' WHEN a.length < b.length THEN 'truncated' WHEN a.length > b.length THEN 'grew' WHEN a.modified <> b.modified THEN 'modified' END AS extent,"
    " CASE WHEN a.first <> b.first THEN 'first record changed' END AS record FROM b FULL JOIN a ON a.path = b.path)"
    " SELECT path, extent AS change FROM j WHERE extent IS NOT NULL UNION ALL SELECT path, record FROM j WHERE record IS NOT NULL"
)
def source_changes(spark, d):
    """Events as sources in two listings, of which the second differs by the id's last digit."""
    events, digit = read(spark, d, "events"), F.col("event_id") % 10
    length = F.floor("value").cast("long")
    before = events.filter(digit != 1).select(F.col("event_id").alias("path"), length.alias("length"), F.col("ts").alias("modified"), F.col("user_id").alias("first"))
    after = events.filter(digit != 6).select(
        F.col("event_id").alias("path"), (length + F.when(digit == 2, -1).when(digit == 3, 5).otherwise(0)).alias("length"),
        F.when(digit.isin(3, 4), F.col("ts") + F.expr("INTERVAL 1 SECOND")).otherwise(F.col("ts")).alias("modified"), (F.col("user_id") + F.when(digit.isin(2, 5), 1).otherwise(0)).alias("first"),
    )
    return changes.changes(before, after)
