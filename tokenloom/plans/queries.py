"""Queries over the columnar tables, one for each operator, each beside the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenloom.functions import identity
from tokenloom.functions.measures import inclusive_input
from tokenloom.operators import graph, ordered, prices, reconcile, rollups, selection
from tokenloom.plans.tables import COUNTS, DERIVED, MEASURES, OBS, SUMS, observations, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


ZONE = "America/Los_Angeles"
_LA = f"CAST((seen_ts AT TIME ZONE 'UTC') AT TIME ZONE '{ZONE}' AS DATE)"


@query(f"WITH {OBS}, g AS (SELECT CAST(seen_ts AS DATE) AS date, {COUNTS}, {SUMS} FROM obs GROUP BY 1) SELECT *, {DERIVED} FROM g")
def daily_rollup(spark, d):
    return rollups.daily(observations(spark, d), "seen_ts")


@query(f"WITH {OBS}, g AS (SELECT {_LA} AS date, {COUNTS}, {SUMS} FROM obs GROUP BY 1) SELECT *, {DERIVED} FROM g")
def daily_rollup_tz(spark, d):
    return rollups.daily(observations(spark, d), "seen_ts", ZONE)


@query(
    f"WITH {OBS}, u AS (SELECT CASE WHEN status = 'owned' THEN thread END AS t, count(*) AS requests, {SUMS}, max(CAST(seen_ts AS DATE)) AS last_date, count(*) FILTER (WHERE seen_ts IS NULL) AS undated_requests FROM obs GROUP BY 1),"
    f" j AS (SELECT coalesce(c_custkey, t) AS thread, coalesce(requests, 0) AS requests, {', '.join(MEASURES)}, last_date, coalesce(undated_requests, 0) AS undated_requests FROM (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING') c FULL JOIN u ON t = c_custkey) SELECT *, {DERIVED} FROM j"
)
def sessions_rollup(spark, d):
    """Known threads (customers outside one segment), owners that are none of them, and requests without an owner."""
    threads = read(spark, d, "customer").filter("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("thread"))
    owned = observations(spark, d).withColumn("owner", F.when(F.col("status") == "owned", F.col("thread"))).drop("thread")
    return rollups.sessions(threads, owned, "thread", "owner", "seen_ts")


_COUNTED = "counting = 'counted'"


@query(
    f"WITH {OBS} SELECT {', '.join(f'''count(*) FILTER (WHERE {_COUNTED} AND status = '{s}') AS {s}''' for s in rollups.STATUSES)},"
    " count(*) FILTER (WHERE counting = 'unresolved') AS unresolved, count(*) FILTER (WHERE counting = 'copy_only') AS copy_only,"
    f" {', '.join(f'CAST(sum({m}) FILTER (WHERE {_COUNTED}) AS BIGINT) AS {m}' for m in MEASURES)},"
    f" count(*) FILTER (WHERE {_COUNTED} AND coalesce({', '.join(MEASURES)}) IS NULL) AS without_usage,"
    f" count(*) FILTER (WHERE counting = 'unresolved') = 0 AND count(*) FILTER (WHERE {_COUNTED} AND coalesce({', '.join(MEASURES)}) IS NULL) = 0 AS complete FROM obs"
)
def report_totals(spark, d):
    return rollups.totals(observations(spark, d))


@query(
    f"WITH {OBS}, p AS (SELECT *, CASE WHEN status = 'unknown' THEN 0 WHEN status = 'owned' THEN 1 ELSE 2 END AS n,"
    " (CASE WHEN status <> 'unknown' AND thread <= 40 THEN 1 ELSE 0 END) + (CASE WHEN status = 'ambiguous' AND thread + 10 <= 40 THEN 1 ELSE 0 END) AS i FROM obs),"
    " q AS (SELECT *, CASE WHEN n = 0 OR i = 0 THEN 'outside' WHEN i = n THEN 'inside' ELSE 'possible' END AS placement FROM p)"
    f" SELECT placement, count(*) AS requests, {SUMS} FROM q GROUP BY 1"
)
def selection_totals(spark, d):
    obs = observations(spark, d)
    none = F.array().cast("array<bigint>")
    candidates = F.when(F.col("status") == "owned", F.array("thread")).when(F.col("status") == "ambiguous", F.array(F.col("thread"), F.col("thread") + 10)).otherwise(none)
    chosen = F.sequence(F.lit(1).cast("long"), F.lit(40).cast("long"))
    placed = obs.withColumn("candidates", candidates).withColumn("placement", rollups.placement("candidates", F.concat(F.array(F.lit(0).cast("long")), chosen)))
    return placed.groupBy("placement").agg(F.count("*").alias("requests"), *rollups.measure_sums())


@query(
    f"WITH {OBS} SELECT CASE WHEN grouping(project) = 0 THEN 'project' WHEN grouping(model) = 0 THEN 'model' WHEN grouping(status) = 0 THEN 'status' END AS dimension,"
    f" CASE WHEN grouping(project) = 0 THEN project WHEN grouping(model) = 0 THEN model WHEN grouping(status) = 0 THEN status END AS value,"
    f" {COUNTS}, {SUMS} FROM (SELECT * REPLACE (CASE WHEN off % 29 = 0 THEN 'unknown' ELSE coalesce(project, 'unknown') END AS project) FROM obs) GROUP BY GROUPING SETS ((project), (model), (status))"
)
def breakdowns(spark, d):
    obs = observations(spark, d).withColumn("project", F.when(F.col("off") % 29 == 0, "unknown").otherwise(F.col("project")))
    return rollups.breakdowns(obs, ["project", "model", "status"])


@query(
    f"WITH {OBS}, c AS (SELECT model AS m, output AS o FROM obs UNION ALL SELECT 'advisor', coalesce(cache_write_5m, 0) FROM obs WHERE off % 9 = 0)"
    " SELECT m AS component, count(*) AS requests, CAST(sum(o) AS BIGINT) AS output_tokens FROM c GROUP BY 1"
)
def model_components(spark, d):
    own = F.struct(F.col("model").alias("component"), F.col("output").alias("output_tokens"))
    extra = F.struct(F.lit("advisor").alias("component"), F.coalesce("cache_write_5m", F.lit(0)).cast("long").alias("output_tokens"))
    obs = observations(spark, d).withColumn("parts", F.when(F.col("off") % 9 == 0, F.array(own, extra)))
    return rollups.components(obs, own, "parts").groupBy("component").agg(F.count("*").alias("requests"), F.sum("output_tokens").alias("output_tokens"))


_SIZE = "coalesce(uncached_input, 0) + coalesce(cache_read, 0) + coalesce(cache_write_5m, 0) + coalesce(cache_write_1h, 0)"


@query(
    f"WITH {OBS}, s AS (SELECT model, {_SIZE} AS x FROM obs WHERE {_COUNTED}) SELECT model, count(*) AS count, quantile_disc(x, 0.5) AS p50, quantile_disc(x, 0.9) AS p90, quantile_disc(x, 0.99) AS p99, max(x) AS max FROM s GROUP BY 1"
)
def request_sizes(spark, d):
    return rollups.sizes(observations(spark, d).filter(_COUNTED), ["model"], inclusive_input())


@query(
    f"WITH {OBS}, r AS (SELECT off, thread, output FROM obs UNION ALL SELECT off, thread, output FROM obs WHERE off % 4 = 0 UNION ALL SELECT off, thread, output + 1 FROM obs WHERE off % 8 = 0)"
    " SELECT off, thread, min(output) AS output, count(*) - 1 AS rereads, count(DISTINCT output) - 1 AS conflicts FROM r GROUP BY off, thread"
)
def reread_dedupe(spark, d):
    rows = observations(spark, d).select("off", "thread", "output")
    again = rows.unionByName(rows.filter("off % 4 = 0")).unionByName(rows.filter("off % 8 = 0").withColumn("output", F.col("output") + 1))
    return reconcile.dedupe_rereads(again, ["off", "thread"])


@query(
    "SELECT l_orderkey AS request, arg_max(l_linenumber, r) AS line, arg_max(l_partkey, r) AS part, arg_max(CAST(l_quantity AS BIGINT), r) AS output, count(*) AS revisions, count(DISTINCT l_tax) > 1 AS disagree"
    " FROM (SELECT *, {'a': CAST(l_quantity AS BIGINT), 'b': l_linenumber, 'c': l_partkey} AS r FROM lineitem) GROUP BY 1"
)
def revision_select(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("request"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_quantity").cast("long").alias("output"), "l_tax")
    return reconcile.select_revision(rows, ["request"], reconcile.largest_output("output", "line", ["part"]), ["line", "part", "output"], ["l_tax"])


@query("SELECT l_orderkey AS request, count(DISTINCT (l_tax, l_discount)) AS versions FROM lineitem GROUP BY 1 HAVING count(DISTINCT (l_tax, l_discount)) > 1")
def revision_conflicts(spark, d):
    rows = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("request")).agg(F.count_distinct(F.struct("l_tax", "l_discount")).alias("versions"))
    return rows.filter("versions > 1")


def linked_sets(spark, d):
    """Sets over the whole customer table. Without SQL: a recursive query over all pairs takes too long; a test holds it against union-find."""
    rows = read(spark, d, "customer").select(
        F.col("c_custkey").alias("observation"), F.when(F.col("c_custkey") % 50 != 0, F.array(F.concat(F.lit("a"), F.expr("c_custkey div 7")), F.concat(F.lit("b"), F.col("c_custkey") % 97))).otherwise(F.array().cast("array<string>")).alias("keys")
    )
    return reconcile.linked_sets(rows, "observation", "keys")


QUERIES["linked_sets"] = linked_sets


def linked_sets_events(spark, d):
    """Sets over the whole events table, by the keys (user, hour) and (user, k); an event without a key is a set by itself.

    Without SQL: a recursive query over all pairs takes too long at this size. A test holds it against union-find.
    """
    user = F.col("user_id").cast("string")
    hour = F.concat(F.lit("h"), user, F.lit("/"), F.date_trunc("hour", "ts").cast("string"))
    k = F.concat(F.lit("k"), user, F.lit("/"), F.get_json_object("props", "$.k"))
    alone = F.array(F.concat(F.lit("e"), F.col("observation").cast("string")))
    rows = read(spark, d, "events").select(F.col("event_id").alias("observation"), F.array_compact(F.array(hour, k)).alias("keys"))
    rows = rows.withColumn("keys", F.when(F.size("keys") > 0, F.col("keys")).otherwise(alone))  # the keys are made once
    return reconcile.linked_sets(rows, "observation", "keys")


QUERIES["linked_sets_events"] = linked_sets_events


_JSON = """'["req",1,"event","' || event_id || '","' || event_type || '"]'"""


@query(f"SELECT event_id, substr(sha256({_JSON}), 1, 32) AS id_hex, substr(sha256({_JSON}), 33, 16) AS check_hex FROM events")
def identity_ids(spark, d):
    parts = (F.col("event_id"), F.col("event_type"))
    return read(spark, d, "events").select("event_id", F.substring(identity.digest_hex("req", "event", *parts), 1, 32).alias("id_hex"), identity.check_bits("req", "event", *parts).alias("check_hex"))


@query(
    "WITH s AS (SELECT l_orderkey AS request, list(DISTINCT l_suppkey ORDER BY l_suppkey) FILTER (WHERE l_returnflag = 'R') AS c FROM lineitem GROUP BY 1)"
    " SELECT request, CASE WHEN coalesce(len(c), 0) = 0 THEN 'unknown' WHEN len(c) = 1 THEN 'owned' ELSE 'ambiguous' END AS status, CASE WHEN len(c) = 1 THEN c[1] END AS owner, coalesce(array_to_string(c, ','), '') AS candidates FROM s"
)
def ownership(spark, d):
    """Orders as requests whose lines are observations; returned lines prove an owner."""
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("request"), F.when(F.col("l_returnflag") == "R", F.col("l_suppkey")).alias("owner"))
    return reconcile.ownership(rows, ["request"], "owner").withColumn("candidates", F.array_join("candidates", ","))


_COUNTER = f"{OBS}, g AS (SELECT *, sum(CASE WHEN off % 13 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY thread ORDER BY ts, off) AS z FROM obs), t AS (SELECT off, thread, ts, CAST(sum(k) OVER (PARTITION BY thread, z ORDER BY ts, off ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM g)"


def _counter(spark, d):
    w = Window.partitionBy("thread").orderBy("ts", "off")
    zeroed = observations(spark, d).withColumn("z", F.sum(F.when(F.col("off") % 13 == 0, 1).otherwise(0)).over(w))
    each = Window.partitionBy("thread", "z").orderBy("ts", "off").rowsBetween(Window.unboundedPreceding, 0)
    return zeroed.withColumn("total", F.sum("k").over(each)).select("off", "thread", "ts", "total")


@query(
    f"WITH {_COUNTER}, b AS (SELECT *, lag(total) OVER (PARTITION BY thread ORDER BY ts, off) AS p FROM t)"
    " SELECT off, thread, total, CASE WHEN p IS NULL OR total < p THEN total ELSE total - p END AS delta, CASE WHEN total < p THEN 'reset' WHEN total = p THEN 'repeated' ELSE 'advanced' END AS event,"
    " CAST(sum(CASE WHEN total < p THEN 1 ELSE 0 END) OVER (PARTITION BY thread ORDER BY ts, off) AS BIGINT) AS epoch FROM b"
)
def counter_deltas(spark, d):
    return ordered.counter_deltas(_counter(spark, d), ["thread"], ["ts", "off"], "total").drop("ts")


@query(
    "SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS context FROM events"
)
def asof_context(spark, d):
    purchase = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return ordered.carry_forward(read(spark, d, "events"), ["user_id"], ["ts", "event_id"], purchase, "context").select("event_id", "user_id", "context")


@query(
    "WITH a AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events), b AS (SELECT *, sum(CASE WHEN p = event_type THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM a)"
    " SELECT user_id, CAST(run AS BIGINT) AS run, min(event_type) AS event_type, arg_min(event_id, (ts, event_id)) AS first_event, count(*) AS length FROM b GROUP BY user_id, run"
)
def sidechain_runs(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = read(spark, d, "events").withColumn("nth", F.row_number().over(w))
    found = ordered.runs(rows, ["user_id"], ["nth"], "event_type")
    named = rows.select("user_id", F.col("nth").alias("first"), F.col("event_id").alias("first_event"))
    return found.join(named, ["user_id", "first"]).select("user_id", "run", "event_type", "first_event", "length")


@query(
    "WITH a AS (SELECT event_id, user_id, event_type, lag(event_type) OVER w AS p, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id, user_id, event_type FROM a WHERE n = 1 OR p IS DISTINCT FROM event_type"
)
def limit_collapse(spark, d):
    return reconcile.collapse_consecutive(read(spark, d, "events").select("event_id", "user_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"], "event_type").drop("ts")


_FOREST = "e AS (SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer)"


@query(f"WITH RECURSIVE {_FOREST}, t AS (SELECT 'r1' AS node, 0 AS depth UNION ALL SELECT child, depth + 1 FROM t JOIN e ON parent = node) SELECT node, depth FROM t")
def descendants(spark, d):
    nations = read(spark, d, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.concat(F.lit("n"), "n_nationkey").alias("child"))
    customers = read(spark, d, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.concat(F.lit("c"), "c_custkey").alias("child"))
    return graph.descendants(nations.unionByName(customers), spark.sql("SELECT 'r1' AS node"))


@query("SELECT user_id FROM events WHERE event_type = 'purchase' INTERSECT SELECT user_id FROM events WHERE event_type = 'error'")
def selection_intersect(spark, d):
    events = read(spark, d, "events")
    return selection.select([events.filter(F.col("event_type") == kind).select("user_id") for kind in ("purchase", "error")])


@query("SELECT DISTINCT user_id FROM events WHERE event_type IN ('purchase', 'signup')")
def selection_union(spark, d):
    events = read(spark, d, "events")
    return selection.any_of([events.filter(F.col("event_type") == kind).select("user_id") for kind in ("purchase", "signup")])


@query("SELECT user_id FROM events EXCEPT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def selection_except(spark, d):
    building = read(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    return read(spark, d, "events").select("user_id").subtract(building)


@query("SELECT event_id, user_id FROM events WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = user_id AND c_mktsegment <> 'BUILDING')")
def orphans(spark, d):
    """Events whose user isn't among the known threads (customers outside one segment)."""
    known = read(spark, d, "customer").filter("c_mktsegment <> 'BUILDING'")
    return read(spark, d, "events").join(known, F.col("user_id") == F.col("c_custkey"), "left_anti").select("event_id", "user_id")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def semi_join(spark, d):
    return read(spark, d, "customer").join(read(spark, d, "orders").filter("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT l_orderkey, l_suppkey, count(*) AS locations FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dup_locations(spark, d):
    return read(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("locations")).filter("locations > 1")


@query(
    "WITH a AS (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_nationkey < 20 GROUP BY 1), b AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_nationkey > 3 GROUP BY 1)"
    " SELECT coalesce(a.k, b.k) AS nation, coalesce(a.n, 0) AS ours, coalesce(b.n, 0) AS theirs, coalesce(a.n, 0) - coalesce(b.n, 0) AS delta FROM a FULL JOIN b ON a.k = b.k"
)
def full_outer_diff(spark, d):
    ours = read(spark, d, "customer").filter("c_nationkey < 20").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("ours"))
    theirs = read(spark, d, "supplier").filter("s_nationkey > 3").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("theirs"))
    return ours.join(theirs, "nation", "full").select("nation", F.coalesce("ours", F.lit(0)).alias("ours"), F.coalesce("theirs", F.lit(0)).alias("theirs")).withColumn("delta", F.col("ours") - F.col("theirs"))


@query(
    "WITH x AS (SELECT event_type AS code, user_id AS subject, event_id AS evidence, CAST(floor(value) AS BIGINT) % 5 + 1 AS occurrences, 'd' || (event_id % 4) AS detail FROM events)"
    " SELECT code, subject, CAST(sum(occurrences) AS BIGINT) AS occurrences, arg_min(detail, evidence) AS detail, array_to_string(list_slice(list(evidence ORDER BY evidence), 1, 3), ',') AS evidence FROM x GROUP BY 1, 2"
)
def diagnostics_summary(spark, d):
    rows = read(spark, d, "events").select(F.col("event_type").alias("code"), F.col("user_id").alias("subject"), F.col("event_id").alias("evidence"), (F.floor("value").cast("long") % 5 + 1).alias("occurrences"), F.concat(F.lit("d"), (F.col("event_id") % 4).cast("string")).alias("detail"))
    return reconcile.compact_diagnostics(rows).withColumn("evidence", F.array_join("evidence", ","))


@query(
    f"WITH {OBS}, f AS (SELECT off, thread, k, first_value(thread) OVER (PARTITION BY k ORDER BY seen_ts NULLS LAST, off ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first_owner FROM obs) SELECT *, first_owner <> thread AS replayed FROM f"
)
def first_owner(spark, d):
    rows = observations(spark, d).select("off", "thread", "k", "seen_ts")
    return reconcile.first_owner(rows, "k", "thread", [F.asc_nulls_last("seen_ts"), F.col("off")]).drop("seen_ts")


@query(f"WITH {OBS} SELECT off, thread, output FROM obs ORDER BY output DESC, off LIMIT 25")
def topn_requests(spark, d):
    return observations(spark, d).select("off", "thread", "output").orderBy(F.desc("output"), "off").limit(25)


def _calendar(unit: str):
    def f(spark, d):
        return observations(spark, d).groupBy(F.to_date(F.date_trunc(unit, "seen_ts")).alias("start")).agg(F.count("*").alias("requests"), F.sum("output").alias("output"))

    return f


for _name, _unit in (("weekly", "week"), ("monthly", "month")):
    QUERIES[_name] = _calendar(_unit)
    SQL[_name] = f"WITH {OBS} SELECT CAST(date_trunc('{_unit}', seen_ts) AS DATE) AS start, count(*) AS requests, CAST(sum(output) AS BIGINT) AS output FROM obs GROUP BY 1"


@query(f"WITH {OBS} SELECT CAST(date_trunc('week', seen_ts + INTERVAL 1 DAY) - INTERVAL 1 DAY AS DATE) AS start, count(*) AS requests FROM obs GROUP BY 1")
def weekly_from_sunday(spark, d):
    shifted = F.date_trunc("week", F.col("seen_ts") + F.expr("INTERVAL 1 DAY"))
    return observations(spark, d).groupBy(F.date_sub(F.to_date(shifted), 1).alias("start")).agg(F.count("*").alias("requests"))


@query(f"WITH {OBS} SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS start, count(*) AS requests, CAST(sum(output) AS BIGINT) AS output FROM obs GROUP BY 1")
def bucket_15m(spark, d):
    return observations(spark, d).groupBy(F.window("ts", "15 minutes").alias("w")).agg(F.count("*").alias("requests"), F.sum("output").alias("output")).select(F.col("w.start").alias("start"), "requests", "output")


_KINDS = ("click", "error", "purchase", "signup", "view")


@query(f"WITH {OBS} SELECT CAST(date_trunc('day', ts) AS DATE) AS day, " + ", ".join(f"CAST(sum(output) FILTER (WHERE model = '{k}') AS BIGINT) AS \"{k}\"" for k in _KINDS) + " FROM obs GROUP BY 1")
def joint_pivot(spark, d):
    return rollups.joint(observations(spark, d), F.to_date("ts").alias("day"), "model", list(_KINDS), F.sum("output"))


@query(
    f"WITH {OBS} SELECT model, CAST(sum(cache_read) AS DOUBLE) / sum({_SIZE}) AS share, count(*) FILTER (WHERE cache_read > 0) AS hits, count(*) FILTER (WHERE cache_read = 0) AS misses, count(*) FILTER (WHERE cache_read IS NULL) AS unknown FROM obs GROUP BY 1"
)
def cache_share(spark, d):
    return observations(spark, d).groupBy("model").agg(
        (F.sum("cache_read").cast("double") / F.sum(inclusive_input())).alias("share"), F.count_if(F.col("cache_read") > 0).alias("hits"), F.count_if(F.col("cache_read") == 0).alias("misses"), F.count_if(F.col("cache_read").isNull()).alias("unknown")
    )


@query(
    f"WITH {OBS}, b AS (SELECT output AS x, floor(log2(greatest(output, 1)) + 1e-12) AS p FROM obs) SELECT CASE WHEN x <= 0 THEN -1 ELSE CAST(p * 8 + floor((x / pow(2.0, p) - 1) * 8) AS BIGINT) END AS bucket, count(*) AS n, min(x) AS low, max(x) AS high, CAST(sum(x) AS BIGINT) AS total FROM b GROUP BY 1"
)
def loglinear_histogram(spark, d):
    return observations(spark, d).groupBy(ordered.log_linear_bucket(F.col("output")).alias("bucket")).agg(F.count("*").alias("n"), F.min("output").alias("low"), F.max("output").alias("high"), F.sum("output").alias("total"))


@query(
    f"WITH {OBS}, i AS (SELECT thread, epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 1000000 + 600 + output * 10 AS e FROM obs), m AS (SELECT *, max(e) OVER (PARTITION BY thread ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM i)"
    " SELECT thread, CAST(sum(greatest(0, e - greatest(s, coalesce(p, s)))) AS BIGINT) AS busy_seconds, count(*) AS intervals FROM m GROUP BY 1"
)
def busy_time(spark, d):
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    rows = observations(spark, d).select("thread", seconds.alias("start"), (seconds + 600 + F.col("output") * 10).alias("end"))
    return ordered.busy_time(rows, ["thread"], "start", "end")


@query(f"WITH {OBS}, {prices.RATES_SQL}, j AS (SELECT off, rate, threshold FROM obs JOIN rates ON rates.model = obs.model AND ts >= effective_from AND (effective_until IS NULL OR ts < effective_until) AND {_SIZE} >= threshold),"
    " m AS (SELECT off, arg_max(rate, threshold) AS rate FROM j GROUP BY off) SELECT obs.model, count(*) AS requests, count(rate) AS priced, round(CAST(sum(output * rate) AS DOUBLE) / 1000000, 9) AS cost FROM obs LEFT JOIN m ON m.off = obs.off GROUP BY 1")
def price_join(spark, d):
    priced = prices.with_rate(observations(spark, d).withColumn("size", inclusive_input()), prices.rates(spark), "off", "ts", "size")
    return priced.groupBy("model").agg(F.count("*").alias("requests"), F.count("rate").alias("priced"), F.round(F.sum(F.col("output") * F.col("rate")).cast("double") / 1000000, 9).alias("cost"))


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem GROUP BY 1")
def line_fit(spark, d):
    return read(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 6).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 3).alias("intercept"))


@query(
    f"WITH {OBS}, x AS (SELECT abs(output - k) / greatest(k, 1) AS r FROM obs) SELECT CASE WHEN r = 0 THEN 'exact' WHEN r <= 0.01 THEN '<=1%' WHEN r <= 0.05 THEN '<=5%' ELSE '>5%' END AS class, count(*) AS n FROM x GROUP BY 1"
)
def delta_histogram(spark, d):
    r = F.abs(F.col("output") - F.col("k")) / F.greatest(F.col("k"), F.lit(1))
    return observations(spark, d).groupBy(F.when(r == 0, "exact").when(r <= 0.01, "<=1%").when(r <= 0.05, "<=5%").otherwise(">5%").alias("class")).agg(F.count("*").alias("n"))


@query(
    "WITH k AS (SELECT l_partkey, l_suppkey, count(*) AS n, count(DISTINCT l_orderkey) AS files, count(DISTINCT l_quantity) AS versions FROM lineitem GROUP BY 1, 2)"
    " SELECT count(*) AS distinct_keys, CAST(sum(n - files) AS BIGINT) AS same_file, CAST(sum(files - 1) AS BIGINT) AS cross_file, count(*) FILTER (WHERE versions > 1) AS conflicting FROM k"
)
def dup_stats(spark, d):
    each = read(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey", "l_orderkey").agg(F.count("*").alias("n"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"))
    per = each.groupBy("l_partkey", "l_suppkey").agg(F.sum("n").alias("n"), F.count("*").alias("files"), (F.min("low") != F.max("high")).alias("conflicts"))
    return per.agg(F.count("*").alias("distinct_keys"), F.sum(F.col("n") - F.col("files")).alias("same_file"), F.sum(F.col("files") - 1).alias("cross_file"), F.count_if("conflicts").alias("conflicting"))


@query("SELECT o_orderpriority, median(o_totalprice) AS median_price FROM orders GROUP BY 1")
def median_by_group(spark, d):
    return rollups.medians(read(spark, d, "orders"), ["o_orderpriority"], F.col("o_totalprice"), "median_price")


@query(
    f"WITH {OBS} SELECT thread, CASE WHEN count(*) FILTER (WHERE seen_ts IS NULL) > 0 THEN 'undated' WHEN max(ts) >= TIMESTAMP '2024-01-28' THEN 'active' ELSE 'stable' END AS class, count(*) AS requests FROM obs GROUP BY 1"
)
def session_classes(spark, d):
    undated = F.count_if(F.col("seen_ts").isNull()) > 0
    return observations(spark, d).groupBy("thread").agg(F.when(undated, "undated").when(F.max("ts") >= F.expr("TIMESTAMP_NTZ '2024-01-28'"), "active").otherwise("stable").alias("class"), F.count("*").alias("requests"))


@query(
    f"WITH {OBS}, r AS (SELECT *, row_number() OVER (PARTITION BY thread, model ORDER BY CASE status WHEN 'owned' THEN 0 ELSE 1 END, off) AS n FROM obs) SELECT off, thread, model, CASE WHEN n = 1 THEN 'counted' ELSE 'unresolved' END AS counting FROM r"
)
def candidate_sets(spark, d):
    rows = observations(spark, d).select("off", "thread", "model", F.when(F.col("status") == "owned", 0).otherwise(1).alias("basis"))
    return reconcile.candidate_sets(rows, ["thread", "model"], ["basis", "off"]).drop("basis")


@query(
    f"WITH {OBS} SELECT thread, arg_min(project, off) FILTER (WHERE project IS NOT NULL) AS project, arg_min(model, off) AS model, count(DISTINCT project) > 1 OR count(DISTINCT model) > 1 AS conflicted FROM obs GROUP BY 1"
)
def pricing_merge(spark, d):
    return reconcile.merge_pricing(observations(spark, d), ["thread"], ["project", "model"], F.col("off"))


@query(
    f"WITH {OBS}, x AS (SELECT thread, unnest([thread, thread + 1]) AS c, off FROM obs WHERE status = 'ambiguous'), j AS (SELECT off, count(DISTINCT c_mktsegment) AS n, min(c_mktsegment) AS p FROM x LEFT JOIN customer ON c_custkey = c GROUP BY 1)"
    " SELECT off, CASE WHEN n = 0 THEN 'unknown' WHEN n = 1 THEN p ELSE 'ambiguous' END AS project FROM j"
)
def candidate_projects(spark, d):
    rows = observations(spark, d).filter("status = 'ambiguous'").select("off", F.array(F.col("thread"), F.col("thread") + 1).alias("candidates"))
    return selection.candidate_property(rows, "off", "candidates", read(spark, d, "customer"), "c_custkey", "c_mktsegment", "project")


@query("SELECT max(ts) AS last, min(ts) AS first, CAST(date_diff('second', min(ts), max(ts)) AS BIGINT) AS skew_seconds FROM events")
def cutoff_skew(spark, d):
    span = F.unix_seconds(F.max("ts").cast("timestamp")) - F.unix_seconds(F.min("ts").cast("timestamp"))
    return read(spark, d, "events").agg(F.max("ts").alias("last"), F.min("ts").alias("first"), span.alias("skew_seconds"))


@query("SELECT conv_id, count(*) AS turns, string_agg(role, '>' ORDER BY turn) AS roles, min(turn) AS first_turn, max(turn) AS last_turn FROM conversations GROUP BY 1")
def conversation_threads(spark, d):
    order = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return read(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_join(F.transform(order, lambda x: x["role"]), ">").alias("roles"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))


@query(
    f"WITH {OBS} SELECT project, model, count(*) AS requests, CAST(sum(output) AS BIGINT) AS output FROM obs WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' AND (project = 'p1' OR NOT (k > 50)) GROUP BY 1, 2 HAVING sum(output) > 1000"
)
def typed_predicates(spark, d):
    window = (F.col("ts") >= F.expr("TIMESTAMP_NTZ '2024-01-05'")) & (F.col("ts") < F.expr("TIMESTAMP_NTZ '2024-01-20'"))
    rows = observations(spark, d).filter(window & ((F.col("project") == "p1") | ~(F.col("k") > 50)))
    return rows.groupBy("project", "model").agg(F.count("*").alias("requests"), F.sum("output").alias("output")).filter("output > 1000")


def counter_gaps(spark, d):
    """Counters some rows leave out, through the grouped state machine."""
    rows = _counter(spark, d).withColumn("other", F.when(F.col("off") % 3 != 0, F.col("total") * 2)).withColumn("ts", F.col("ts").cast("string"))
    return ordered.grouped_counter_deltas(rows, "thread", ["ts", "off"], ["total", "other"])


QUERIES["counter_gaps"] = counter_gaps
