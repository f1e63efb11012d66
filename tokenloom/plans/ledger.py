"""Queries of the ledger: sets to requests, properties, edges, aliases, replays, contexts, coverage, costs. Each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenloom.functions import texts
from tokenloom.functions.measures import inclusive_input
from tokenloom.operators import ordered, prices, reconcile, rollups
from tokenloom.plans.queries import _SIZE, query
from tokenloom.plans.tables import MEASURES, OBS, SUMS, observations, read


@query(
    f"WITH {OBS}, w AS (SELECT off, thread, k, coalesce(min(model) OVER (PARTITION BY thread, k) <> max(model) OVER (PARTITION BY thread, k), false) AS split FROM obs)"
    " SELECT off, split, CASE WHEN split THEN 'local/' || off ELSE 'set/' || thread || '/' || k END AS request FROM w"
)
def invariant_split(spark, d):
    rows = observations(spark, d).select("off", "thread", "k", "model")
    named = F.concat_ws("/", F.lit("set"), F.col("thread").cast("string"), F.col("k").cast("string"))
    return reconcile.split_by_invariant(rows, ["thread", "k"], "model", named, F.concat(F.lit("local/"), F.col("off").cast("string"))).select("off", "split", "request")


@query(
    f"WITH {OBS} SELECT thread, k, count(*) FILTER (WHERE counting <> 'copy_only') AS originals, count(*) FILTER (WHERE counting = 'copy_only') AS copies, min(seen_ts) FILTER (WHERE counting <> 'copy_only') AS first_seen,"
    " max(seen_ts) FILTER (WHERE counting <> 'copy_only') AS last_seen, min(off) FILTER (WHERE counting <> 'copy_only') AS first_place, max(off) FILTER (WHERE counting <> 'copy_only') AS last_place,"
    " count(*) FILTER (WHERE counting <> 'copy_only') = 0 AS copy_only FROM obs GROUP BY thread, k"
)
def request_build(spark, d):
    return reconcile.build_requests(observations(spark, d), ["thread", "k"], F.col("counting") != "copy_only", "seen_ts", "off")


@query(
    f"WITH {OBS}, r AS (SELECT *, CASE WHEN off % 6 <> 0 THEN model END AS served, CASE status WHEN 'owned' THEN 0 ELSE 1 END AS basis FROM obs),"
    " g AS (SELECT thread, k, arg_max({'m': served}, {'a': output, 'b': off}).m AS own, arg_min(served, {'a': basis, 'b': served}) FILTER (WHERE served IS NOT NULL) AS least, coalesce(min(served) <> max(served), false) AS model_conflict FROM r GROUP BY 1, 2)"
    " SELECT thread, k, coalesce(own, least) AS model, model_conflict FROM g"
)
def model_resolution(spark, d):
    rows = observations(spark, d).withColumns({"served": F.when(F.col("off") % 6 != 0, F.col("model")), "basis": F.when(F.col("status") == "owned", 0).otherwise(1)})
    return reconcile.resolve_property(rows, ["thread", "k"], F.struct("output", "off"), "served", "basis", "model")


@query(
    f"WITH {OBS}, g AS (SELECT thread, k, arg_max({{'m': project}}, {{'a': output, 'b': off}}).m AS own, min(project) AS least, coalesce(min(project) <> max(project), false) AS effort_conflict FROM obs GROUP BY 1, 2)"
    " SELECT thread, k, coalesce(own, least) AS effort, effort_conflict FROM g"
)
def effort_resolution(spark, d):
    return reconcile.resolve_property(observations(spark, d), ["thread", "k"], F.struct("output", "off"), "project", None, "effort")


@query(
    f"WITH {OBS} SELECT thread, CASE WHEN min(project) = max(project) THEN min(project) END AS project, CASE WHEN min(model) = max(model) THEN min(model) END AS model,"
    " coalesce(min(project) <> max(project), false) AS project_conflict, coalesce(min(model) <> max(model), false) AS model_conflict FROM (SELECT * REPLACE (thread * 1000 + k AS thread) FROM obs) GROUP BY 1"
)
def thread_merge(spark, d):
    """Threads are users by k, so that some are reported once and some several times."""
    rows = observations(spark, d).withColumn("thread", F.col("thread") * 1000 + F.col("k"))
    return reconcile.merge_properties(rows, ["thread"], ["project", "model"])


@query(
    f"WITH {OBS} SELECT model AS kind, k AS source, output % 30 AS target, CASE WHEN min(status) = max(status) THEN min(status) END AS status, coalesce(min(status) <> max(status), false) AS status_conflict FROM obs GROUP BY 1, 2, 3"
)
def action_merge(spark, d):
    rows = observations(spark, d).select(F.col("model").alias("kind"), F.col("k").alias("source"), (F.col("output") % 30).alias("target"), "status")
    return reconcile.merge_properties(rows, ["kind", "source", "target"], ["status"])


@query(f"WITH {OBS} SELECT model AS kind, thread AS source, k % 20 AS target, bool_or(off % 2 = 0) AS proven, count(*) AS reports, min(off) AS first_place FROM obs GROUP BY 1, 2, 3")
def edge_merge(spark, d):
    rows = observations(spark, d).select(F.col("model").alias("kind"), F.col("thread").alias("source"), (F.col("k") % 20).alias("target"), "off")
    return reconcile.merge_edges(rows, F.col("off") % 2 == 0, "off")


@query("SELECT substr(sha256(CAST(event_id AS VARCHAR)), 1, 3) AS id, count(DISTINCT substr(sha256(CAST(event_id AS VARCHAR)), 33, 16)) AS keys FROM events GROUP BY 1 HAVING keys > 1")
def digest_collisions(spark, d):
    digest = F.sha2(F.col("event_id").cast("string").cast("binary"), 256)
    return reconcile.collisions(read(spark, d, "events").select(F.substring(digest, 1, 3).alias("id"), F.substring(digest, 33, 16).alias("check")), "id", "check")


@query(
    f"WITH {OBS} SELECT count(*) AS observations, count(*) FILTER (WHERE counting = 'copy_only') AS copies_excluded, count(*) FILTER (WHERE counting = 'unresolved') AS unresolved, count(*) FILTER (WHERE counting = 'counted') AS requests,"
    " count(*) FILTER (WHERE counting = 'counted' AND output IS NULL) AS requests_without_usage, count(*) FILTER (WHERE seen_ts IS NULL) AS undated FROM obs"
)
def coverage_summary(spark, d):
    return reconcile.coverage(observations(spark, d))


@query(f"WITH {OBS}, a AS (SELECT *, CASE WHEN model IN ('click', 'view') THEN 'one' WHEN model <> 'error' THEN 'two' ELSE 'unknown' END AS agent FROM obs) SELECT agent, count(*) AS requests, {SUMS} FROM a GROUP BY GROUPING SETS ((agent), ())")
def agent_totals(spark, d):
    agent = F.when(F.col("model").isin("click", "view"), "one").when(F.col("model") != "error", "two")
    return rollups.by_agent(observations(spark, d).withColumn("agent", agent), "agent")


@query(
    f"WITH {OBS}, g AS (SELECT thread, bool_or(counting = 'counted' AND coalesce({', '.join(MEASURES)}) IS NULL) AS w, bool_or(counting = 'unresolved') AS u, bool_or(status = 'ambiguous') AS p, (thread // 1000) % 7 = 0 AS x FROM (SELECT * REPLACE (thread * 1000 + k AS thread) FROM obs) GROUP BY thread)"
    " SELECT thread, NOT (w OR u OR p OR x) AS complete, array_to_string(list_filter([CASE WHEN w THEN 'without_usage' END, CASE WHEN u THEN 'unresolved' END, CASE WHEN p THEN 'possible' END, CASE WHEN x THEN 'gap' END], lambda r: r IS NOT NULL), ',') AS reasons FROM g"
)
def completeness(spark, d):
    """Threads are users by k; every seventh user's have a gap."""
    rows = observations(spark, d).withColumn("thread", F.col("thread") * 1000 + F.col("k"))
    gaps = rows.select("thread").filter("(thread div 1000) % 7 = 0")
    return rollups.completeness(rows, gaps, "thread")


@query(
    f"WITH {OBS}, l AS (SELECT thread % 10 AS source, unnest(list_filter([CASE WHEN off % 7 = 0 THEN 'truncated' END, CASE WHEN off % 11 = 0 THEN 'malformed' END, CASE WHEN off % 77 = 0 THEN 'oversized' END], lambda r: r IS NOT NULL)) AS loss FROM obs)"
    " SELECT source, loss, count(*) AS n FROM l GROUP BY 1, 2"
)
def loss_histogram(spark, d):
    losses = F.array_compact(F.array(F.when(F.col("off") % 7 == 0, "truncated"), F.when(F.col("off") % 11 == 0, "malformed"), F.when(F.col("off") % 77 == 0, "oversized")))
    return observations(spark, d).select((F.col("thread") % 10).alias("source"), F.explode(losses).alias("loss")).groupBy("source", "loss").agg(F.count("*").alias("n"))


@query(f"WITH {OBS} SELECT max(n) AS largest, count(*) AS sets FROM (SELECT thread, k, count(*) AS n FROM obs GROUP BY 1, 2)")
def largest_set(spark, d):
    return observations(spark, d).groupBy("thread", "k").agg(F.count("*").alias("n")).agg(F.max("n").alias("largest"), F.count("*").alias("sets"))


@query(f"WITH {OBS}, a AS (SELECT c_custkey AS alias, c_custkey - 1 AS canonical FROM customer WHERE c_custkey % 10 = 3) SELECT coalesce(canonical, thread) AS thread, count(*) AS requests FROM obs LEFT JOIN a ON alias = thread GROUP BY 1")
def alias_rewrite(spark, d):
    aliases = read(spark, d, "customer").filter("c_custkey % 10 = 3").select(F.col("c_custkey").alias("alias"), (F.col("c_custkey") - 1).alias("canonical"))
    return reconcile.rewrite_aliases(observations(spark, d).select("thread"), aliases, "thread").groupBy("thread").agg(F.count("*").alias("requests"))


@query(
    f"WITH {OBS}, o AS (SELECT k, output, arg_min(thread, {{'a': status <> 'owned', 'b': seen_ts IS NULL, 'c': off}}) AS first_owner FROM obs GROUP BY 1, 2) SELECT off, thread, first_owner <> thread AS replayed FROM obs JOIN o USING (k, output)"
)
def replay_test(spark, d):
    rows = observations(spark, d).select("off", "thread", "status", "seen_ts", F.concat_ws("/", F.col("k").cast("string"), F.col("output").cast("string")).alias("uuid"))
    order = F.struct((F.col("status") != "owned").alias("child"), F.col("seen_ts").isNull().alias("undated"), "off")
    owners = rows.groupBy("uuid").agg(F.min_by("thread", order).alias("first_owner"))
    return reconcile.replayed(rows, owners, "uuid", "thread").select("off", "thread", "replayed")


@query(f"WITH {OBS}, t AS (SELECT DISTINCT thread, k FROM obs) SELECT off, obs.thread, t.k IS NOT NULL AS in_parent FROM obs LEFT JOIN t ON t.thread = obs.thread - 1 AND t.k = obs.k")
def parent_turns(spark, d):
    rows = observations(spark, d).select("off", "thread", "k").withColumn("parent", F.col("thread") - 1)
    return reconcile.reported_by_parent(rows, "thread", "parent", "k").select("off", "thread", "in_parent")


@query("SELECT event_id FROM events e WHERE event_type = 'error' AND NOT EXISTS (SELECT 1 FROM events r WHERE r.event_type = 'purchase' AND r.user_id = e.user_id AND r.props = e.props)")
def compacted_alone(spark, d):
    events = read(spark, d, "events")
    own = events.filter("event_type = 'purchase'").select("user_id", "props")
    return events.filter("event_type = 'error'").join(own, ["user_id", "props"], "left_anti").select("event_id")


@query(
    "WITH c AS (SELECT user_id, event_id, value AS tier FROM events WHERE event_type = 'signup') SELECT u.event_id, u.user_id, c.tier, c.event_id AS context FROM (SELECT * FROM events WHERE event_type = 'purchase') u"
    " ASOF LEFT JOIN c ON c.user_id = u.user_id AND c.event_id < u.event_id"
)
def turn_context(spark, d):
    events = read(spark, d, "events").select("event_id", "user_id", "event_type", F.col("value").alias("tier"), F.col("event_id").alias("context"))
    uses = events.filter("event_type = 'purchase'").select("event_id", "user_id")
    return ordered.in_force(uses, events.filter("event_type = 'signup'"), ["user_id"], "event_id", ["tier", "context"])


@query(
    "WITH e AS (SELECT user_id AS thread, 's' || (event_id % 9) AS source FROM events), l AS (SELECT CAST(split_part(c_name, '#', 2) AS BIGINT) AS thread, 'file/' || c_mktsegment AS source FROM customer) SELECT * FROM e UNION SELECT * FROM l"
)
def thread_sources(spark, d):
    evidence = read(spark, d, "events").select(F.col("user_id").alias("thread"), F.concat(F.lit("s"), (F.col("event_id") % 9).cast("string")).alias("source"))
    located = read(spark, d, "customer").select(F.split_part("c_name", F.lit("#"), F.lit(2)).cast("long").alias("thread"), F.concat(F.lit("file/"), "c_mktsegment").alias("source"))
    return evidence.unionByName(located).distinct()


@query(f"WITH {OBS} SELECT thread, arg_min(project, off) FILTER (WHERE project IS NOT NULL) AS project, arg_min(cache_write_5m, off) FILTER (WHERE cache_write_5m IS NOT NULL) AS cache_write_5m FROM obs GROUP BY 1")
def first_facts(spark, d):
    return reconcile.first_known(observations(spark, d), ["thread"], ["project", "cache_write_5m"], "off")


@query(
    f"WITH {OBS}, s AS (SELECT *, CASE WHEN counting = 'counted' THEN model END AS m FROM obs) SELECT off, CASE WHEN coalesce(min(m) OVER w <> max(m) OVER w, false) THEN thread || '/' || output ELSE CAST(output AS VARCHAR) END AS message FROM s WINDOW w AS (PARTITION BY output)"
)
def ambiguous_messages(spark, d):
    rows = observations(spark, d)
    return reconcile.scoped_ids(rows, "output", "model", "thread", "message", F.col("counting") == "counted").select("off", "message")


@query(f"WITH {OBS}, g AS (SELECT thread, count(DISTINCT model) AS models FROM obs GROUP BY 1) SELECT off, models FROM obs JOIN g USING (thread)")
def distinct_over(spark, d):
    per = observations(spark, d).groupBy("thread").agg(F.count_distinct("model").alias("models"))
    return observations(spark, d).select("off", "thread").join(per, "thread").select("off", "models")


@query(
    f"WITH {OBS}, r AS (SELECT off, thread, output FROM obs WHERE off % 3 <> 0 UNION ALL SELECT off, thread, output FROM obs WHERE off % 3 <> 1) SELECT off, thread, min(output) AS output, count(*) - 1 AS rereads, count(DISTINCT output) - 1 AS conflicts FROM r GROUP BY off, thread"
)
def bundle_merge(spark, d):
    rows = observations(spark, d).select("off", "thread", "output")
    return reconcile.dedupe_rereads(rows.filter("off % 3 <> 0").unionByName(rows.filter("off % 3 <> 1")), ["off", "thread"])


@query(
    "SELECT c_custkey, split_part(c_name, '#', 2) AS after, substr(c_name, 1, length(c_name) - 9) AS stem, right(c_name, 4) AS last_four, contains(c_name, 'stomer#0') AS has, replace(replace(c_name, '%', '%25'), '#', '%23') AS escaped,"
    " array_to_string([c_mktsegment, 'x'], ', ') AS joined FROM customer"
)
def text_functions(spark, d):
    name = F.col("c_name")
    return read(spark, d, "customer").select(
        "c_custkey", texts.after_first(name, "#").alias("after"), texts.before_last(name, 9).alias("stem"), texts.last(name, 4).alias("last_four"), name.contains("stomer#0").alias("has"),
        texts.escaped(name, "%#").alias("escaped"), F.array_join(F.array("c_mktsegment", F.lit("x")), ", ").alias("joined"),
    )


@query(f"WITH {OBS} SELECT off, coalesce(format('{{:,}}', output * 1000), '-') AS output, coalesce(format('{{:,}}', cache_write_5m), '-') AS cache_write FROM obs")
def shown_numbers(spark, d):
    return observations(spark, d).select("off", texts.shown(F.col("output") * 1000).alias("output"), texts.shown(F.col("cache_write_5m")).alias("cache_write"))


@query(
    "SELECT event_id, '{\"k\":' || CAST(props->>'$.k' AS BIGINT) || ',\"type\":\"' || event_type || '\",\"user\":' || user_id || '}' AS canonical FROM events"
)
def canonical_json(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return read(spark, d, "events").select("event_id", texts.canonical({"user": F.col("user_id"), "k": k, "type": F.col("event_type")}).alias("canonical"))


@query(
    "WITH p AS (SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS session, 'k' AS name, props->>'$.k' AS value FROM events) SELECT session, name, CASE WHEN min(value) = max(value) THEN min(value) END AS value, min(value) <> max(value) AS conflict FROM p GROUP BY 1, 2"
)
def property_maps(spark, d):
    session = F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"))
    maps = read(spark, d, "events").select(session.alias("session"), F.from_json("props", "map<string,string>").alias("m"))
    return texts.merge_maps(maps, "session", "m")


@query(
    "WITH s AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, octet_length(encode(html)) AS size FROM pages), g AS (SELECT CASE WHEN host LIKE '%.org' THEN 'org' WHEN host LIKE '%.net' THEN 'net' ELSE 'other' END AS kind, size FROM s)"
    " SELECT kind, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, quantile_disc(size, 0.5) AS p50, quantile_disc(size, 0.9) AS p90, max(size) AS max FROM g GROUP BY 1"
)
def volume_survey(spark, d):
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    kind = F.when(host.endswith(".org"), "org").when(host.endswith(".net"), "net").otherwise("other")
    at = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY size)").cast("long").alias(f"p{int(p * 100)}")
    sizes = read(spark, d, "pages").select(kind.alias("kind"), F.octet_length("html").cast("long").alias("size"))
    return sizes.groupBy("kind").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), at(0.5), at(0.9), F.max("size").alias("max"))


@query(
    "SELECT conv_id, turn, CASE role WHEN 'user' THEN 'prompt' WHEN 'assistant' THEN 'answer' ELSE 'other' END AS kind, coalesce(octet_length(encode(text)), 0) AS bytes, substr(sha256(coalesce(text, '')), 1, 16) AS digest FROM conversations"
)
def stripped_records(spark, d):
    """Records by kind with their content replaced by its size and digest: only allowed fields are left."""
    kind = F.when(F.col("role") == "user", "prompt").when(F.col("role") == "assistant", "answer").otherwise("other")
    body = F.coalesce("text", F.lit("")).cast("binary")
    return read(spark, d, "conversations").select("conv_id", "turn", kind.alias("kind"), F.length(body).cast("long").alias("bytes"), F.substring(F.sha2(body, 256), 1, 16).alias("digest"))


@query(
    f"WITH {OBS}, {prices.RATES_SQL}, s AS (SELECT *, {_SIZE} AS size FROM obs), j AS (SELECT off, arg_max(rate, threshold) AS rate FROM s JOIN rates ON rates.model = s.model AND ts >= effective_from AND (effective_until IS NULL OR ts < effective_until) AND size >= threshold GROUP BY off),"
    " c AS (SELECT s.model, CASE WHEN rate IS NULL THEN 'unpriced' WHEN project IS NULL THEN 'default assumed' ELSE 'priced' END AS coverage, (output * 5 + uncached_input + coalesce(cache_write_5m, 0) * 1.25 + coalesce(cache_read, 0) * 0.1) * rate AS cost FROM s LEFT JOIN j USING (off))"
    " SELECT model, coverage, count(*) AS requests, round(CAST(sum(cost) AS DOUBLE) / 1000000, 9) AS cost FROM c GROUP BY 1, 2"
)
def cost_coverage(spark, d):
    """List-price cost by category, and which requests it covers: priced, with an assumed default, or not at all."""
    priced = prices.with_rate(observations(spark, d).withColumn("size", inclusive_input()), prices.rates(spark), "off", "ts", "size")
    weight = lambda c, w: F.coalesce(F.col(c), F.lit(0)) * F.lit(w).cast("decimal(6,2)")
    units = weight("output", "5") + weight("uncached_input", "1") + weight("cache_write_5m", "1.25") + weight("cache_read", "0.1")
    kind = F.when(F.col("rate").isNull(), "unpriced").when(F.col("project").isNull(), "default assumed").otherwise("priced")
    return priced.groupBy("model", kind.alias("coverage")).agg(F.count("*").alias("requests"), F.round(F.sum(units * F.col("rate")).cast("double") / 1000000, 9).alias("cost"))


@query(f"WITH {OBS} SELECT off, output FROM obs WHERE output < 400 OR (output = 400 AND off > 100) ORDER BY output DESC, off LIMIT 25")
def next_page(spark, d):
    """The page after a cursor (output 400, place 100) in the order of topn_requests."""
    return rollups.page(observations(spark, d).select("off", "output"), [("output", True), ("off", False)], [400, 100], 25)
