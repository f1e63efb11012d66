"""Queries of nested records and of selection by rows and groups, each beside the SQL it is held against."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import functions as F

from tokenloom.operators import conditions, selection
from tokenloom.operators.nested import Content, stripped
from tokenloom.plans.queries import query
from tokenloom.plans.tables import OBS, observations, read
from tokenloom.sources import roots

_HTML = "coalesce(html, '')"


@query(
    f"WITH p AS (SELECT page_id, url, {_HTML} AS html, octet_length(encode({_HTML})) AS size FROM pages)"
    " SELECT page_id, '{\"url\":' || to_json(url) || ',\"body\":{\"blocks\":[{\"type\":\"html\",\"content\":' || CASE WHEN size > 16 THEN '{\"$b\":' || size || ',\"$d\":\"' || sha256(html) || '\"}' ELSE to_json(html) END || '},{\"type\":\"end\"}],\"sizes\":[' || size || ',0]}}' AS stripped,"
    " CAST(size > 16 AS BIGINT) AS stubs, CASE WHEN size > 16 THEN CAST(size AS BIGINT) ELSE 0 END AS stubbed_bytes FROM p"
)
def stripped_pages(spark, d):
    """Pages as nested records whose text, three levels down, is replaced by its size and digest."""
    html = F.coalesce("html", F.lit(""))
    blocks = F.array(F.struct(F.lit("html").alias("type"), html.alias("content")), F.struct(F.lit("end").alias("type"), F.lit(None).cast("string").alias("content")))
    body = F.struct(blocks.alias("blocks"), F.array(F.octet_length(html), F.lit(0)).alias("sizes"))
    records = read(spark, d, "pages").select("page_id", F.to_json(F.struct("url", body.alias("body"))).alias("record"))
    return stripped(records, ["page_id"], "record", Content(("content",)))


_SINCE, _UNTIL = datetime(2024, 1, 3, tzinfo=UTC), datetime(2024, 2, 1, tzinfo=UTC)
_IN = "seen_ts >= TIMESTAMP '2024-01-03' AND seen_ts < TIMESTAMP '2024-02-01'"


@query(
    f"WITH {OBS} SELECT project, model, count(*) AS requests, CAST(sum(output) AS BIGINT) AS output FROM obs WHERE {_IN} AND (cache_write_5m IS NULL OR NOT (cache_write_5m > 4)) AND NOT (project = 'p1') AND contains(model, 'ic') GROUP BY 1, 2 HAVING sum(output) > 1000"
)
def chosen_rows_and_groups(spark, d):
    """Rows of an interval by conditions that may be unknown, and groups by their sums."""
    writes = F.col("cache_write_5m")
    where = (conditions.is_missing(writes) | ~(writes > 4)) & ~(F.col("project") == "p1") & conditions.has_text(F.col("model"), "ic")
    rows = observations(spark, d).filter(conditions.during(F.col("seen_ts"), _SINCE, _UNTIL) & where)
    return rows.groupBy("project", "model").agg(F.count("*").alias("requests"), F.sum("output").alias("output")).filter("output > 1000")


@query(
    f"WITH {OBS}, a AS (SELECT DISTINCT thread FROM obs WHERE {_IN}) SELECT thread, count(*) AS requests, CAST(sum(output) AS BIGINT) AS output, min(CAST(seen_ts AS DATE) - CAST(((isodow(CAST(seen_ts AS DATE)) - 1 - 6 + 7) % 7) AS INTEGER)) AS first_week FROM obs JOIN a USING (thread) GROUP BY 1"
)
def whole_sessions(spark, d):
    """All usage of the threads that were used in an interval, with the first of their weeks, which begin on Sundays."""
    rows = observations(spark, d)
    chosen = conditions.active_threads(rows, "thread", "seen_ts", _SINCE, _UNTIL)
    week = conditions.period_of(F.col("seen_ts"), "week", "UTC", "sunday")
    return rows.join(chosen.withColumnRenamed("id", "thread"), "thread", "left_semi").groupBy("thread").agg(F.count("*").alias("requests"), F.sum("output").alias("output"), F.min(week).alias("first_week"))


@query(
    "WITH s AS (SELECT o_orderkey AS source, CASE WHEN o_orderkey % 2 = 0 THEN 'n' || o_custkey || '/x' ELSE 'n' || o_custkey END AS locator, ['f' || o_orderkey, 'g' || (o_orderkey // 4)] AS paths FROM orders), e AS (SELECT user_id AS thread, event_id AS source FROM events),"
    " u AS (SELECT thread, unnest(paths) AS path FROM e JOIN s USING (source) UNION SELECT c_custkey, unnest(paths) FROM customer JOIN s ON contains(s.locator, '/') AND split_part(s.locator, '/', 1) = 'n' || c_custkey) SELECT * FROM u"
)
def sources_of_threads(spark, d):
    """Files of threads by their evidence and by their own ids in locators."""
    key = F.col("o_orderkey").cast("string")
    native = F.concat(F.lit("n"), F.col("o_custkey").cast("string"))
    locator = F.when(F.col("o_orderkey") % 2 == 0, F.concat(native, F.lit("/x"))).otherwise(native)
    paths = F.array(F.concat(F.lit("f"), key), F.concat(F.lit("g"), F.floor(F.col("o_orderkey") / 4).cast("string")))
    sources = read(spark, d, "orders").select(F.col("o_orderkey").alias("source"), locator.alias("locator"), paths.alias("paths"))
    evidence = read(spark, d, "events").select(F.col("user_id").alias("thread"), F.col("event_id").alias("source"))
    located = read(spark, d, "customer").select(F.col("c_custkey").alias("thread"), F.concat(F.lit("n"), F.col("c_custkey").cast("string")).alias("native_id"))
    return selection.thread_sources(evidence, located, sources)


@query(
    "WITH s AS (SELECT split_part(split_part(url, '://', 2), '/', 1) AS kind, CAST(octet_length(encode(html)) AS BIGINT) AS size FROM pages WHERE html IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY size DESC) AS i FROM s)"
    " SELECT kind, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, quantile_disc(size, 0.5) AS p50, quantile_disc(size, 0.9) AS p90, quantile_disc(size, 0.99) AS p99, max(size) AS max,"
    " round(CASE WHEN sum(size) > 0 THEN CAST(sum(size) FILTER (WHERE i <= 10) AS DOUBLE) / CAST(sum(size) AS DOUBLE) ELSE 0 END, 9) AS top10_share FROM r GROUP BY 1"
)
def volume_by_kind(spark, d):
    """Sizes of pages by host as of files by kind."""
    host = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))
    sizes = read(spark, d, "pages").select(host.alias("kind"), F.octet_length("html").cast("long").alias("length"))
    return roots.volume(sizes).withColumn("top10_share", F.round("top10_share", 9))
