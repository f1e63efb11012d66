"""Message transcripts: lines to observations with owners, replays and child threads, and observations to requests.

Files are `<session>.jsonl`, and `<session>/subagents/.../agent-<id>.jsonl` for subagents. Runs of sidechain lines in a main file
are child threads of their own. A record is a copy if it is nested in a progress line, names another session than its
file's, or if its uuid (for children also its message) was first recorded by another thread. Records of one message or
request id, however indirectly, are one request; of its originals that with the largest output stands for it, whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenloom.functions.measures import INPUTS, MEASURES, counts_only, split_writes, sum_known, whole_number
from tokenloom.operators.graph import stored
from tokenloom.operators.joins import dealt_join
from tokenloom.operators.ordered import carry_forward
from tokenloom.operators.reconcile import build_requests, largest_output, linked_sets, merge_edges, ownership, scoped_ids, select_revision

#: Only these fields are parsed. Counts are decimals, so that whole numbers keep their digits and text in their place is absent.
_N = "DECIMAL(38,6)"
_PARTS = f"input_tokens: {_N}, cache_read_input_tokens: {_N}, cache_creation_input_tokens: {_N}, output_tokens: {_N}, output_tokens_details: STRUCT<thinking_tokens: {_N}>"
_USAGE = f"STRUCT<{_PARTS}, cache_creation: STRUCT<ephemeral_5m_input_tokens: {_N}, ephemeral_1h_input_tokens: {_N}>, service_tier: STRING, speed: STRING, inference_geo: STRING, iterations: ARRAY<STRUCT<type: STRING, model: STRING, {_PARTS}>>>"
_FIELDS = f"sessionId: STRING, requestId: STRING, uuid: STRING, timestamp: STRING, cwd: STRING, effort: STRING, isSidechain: BOOLEAN, version: STRING, apiBlockIndex: {_N}, quotaLimits: MAP<STRING,STRING>"
_MESSAGE = f"message: STRUCT<id: STRING, model: STRING, usage: {_USAGE}, content: ARRAY<STRUCT<type: STRING, id: STRING>>>"
_RECORD = f"type: STRING, {_FIELDS}, {_MESSAGE}, data: STRUCT<message: STRUCT<{_FIELDS}, {_MESSAGE}>>"
CHILD = r"/subagents/(?:.*/)?agent-([^/]+)\.jsonl$"


def utc(instant: Column) -> Column:
    """The civil time of an instant in UTC, whatever the session's zone."""
    seconds = (F.unix_micros(instant).cast("decimal(20,0)") / 1000000).cast("decimal(18,6)")
    return F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'") + F.make_dt_interval(secs=seconds)


def project(cwd: Column) -> Column:
    """The last component of a working directory."""
    return F.nullif(F.regexp_extract(cwd, r"([^/]+)/*$", 1), F.lit(""))


#: A record without this text has no usage, so it is never parsed.
_MARK = '"output_tokens"'


def located(lines: DataFrame) -> DataFrame:
    """Record lines with their file's session and agent, the thread that holds them (main, agent or inline run) and the session named last up to them.

    Every line decides where threads begin and which session holds, but only what it says of that is shuffled; the record `r` is parsed before, where there may be usage.
    """
    agent = F.nullif(F.regexp_extract("locator", CHILD, 1), F.lit(""))
    folder = F.regexp_extract("locator", r"([^/]+)/subagents/(?!.*/subagents/)", 1)
    stem = F.regexp_extract("locator", r"([^/]+)\.jsonl$", 1)
    rows = lines.filter("state = 'record'").select("locator", "offset", "line", F.json_tuple("line", "type", "isSidechain", "sessionId").alias("_type", "_side", "_session"))
    rows = rows.withColumn("agent", agent).withColumn("file_session", F.when(F.col("agent").isNull(), stem).otherwise(folder))
    rows = rows.withColumn("side", F.coalesce(F.col("_side") == "true", F.lit(False)) & F.col("agent").isNull())
    usage = F.col("_type").isin("assistant", "progress") & F.contains("line", F.lit(_MARK))
    record = F.when(usage, F.from_json(counts_only(F.col("line")), f"STRUCT<{_RECORD}>"))
    rows = rows.select("locator", "offset", "agent", "file_session", "side", "_session", record.alias("r"), F.when(F.col("side"), F.substring(F.sha2("line", 256), 1, 16)).alias("_line"))
    w = Window.partitionBy("locator").orderBy("offset")
    rows = rows.withColumn("_start", F.col("side") & ~F.coalesce(F.lag("side").over(w), F.lit(False)))
    # a run goes by the digest of the line that it begins with, which holds until the next run
    rows = rows.withColumn("_digest", F.last(F.when(F.col("_start"), F.col("_line")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # the session that lines of a subagent name holds for the lines after them
    rows = carry_forward(rows, ["locator"], ["offset"], F.col("_session"), "_named", inclusive=True)
    own = F.when(F.col("agent").isNotNull(), F.concat_ws("/", "file_session", "agent")).when(F.col("side"), F.concat_ws("/", "file_session", F.concat(F.lit("inline-"), "_digest"))).otherwise(F.col("file_session"))
    return rows.withColumn("thread", own).drop("_start", "_digest", "_line", "_session")


def records(lines: DataFrame) -> DataFrame:
    """One row for each usage-bearing record, nested ones marked as forced copies; with the session that the record names."""
    parsed = located(lines)
    nested = F.col("r.type") == "progress"
    body = F.when(nested, F.col("r.data.message")).otherwise(F.struct(*(F.col(f"r.{c.split(':')[0].strip()}") for c in [*_FIELDS.split(", "), "message:"])))
    rows = parsed.filter("r.type IN ('assistant', 'progress')").withColumn("nested", nested).withColumn("b", body)
    rows = rows.filter(whole_number(F.col("b.message.usage.output_tokens")).isNotNull())
    # an API error has neither a model of its own nor a request
    rows = rows.filter(~F.coalesce((F.col("b.message.model") == "<synthetic>") & F.col("b.requestId").isNull(), F.lit(False)))
    session = F.coalesce(F.col("b.sessionId"), F.when(F.col("agent").isNotNull(), F.col("_named")), F.col("file_session"))
    return rows.withColumn("session", session).withColumn("foreign", F.col("session") != F.col("file_session"))


def observations(lines: DataFrame) -> DataFrame:
    """Usage-bearing records as observations: measures with those of advisors added, context of prices, place and thread."""
    rows = records(lines)
    usage = lambda name: whole_number(F.col(f"b.message.usage.{name}"))
    advised = F.filter(F.coalesce("b.message.usage.iterations", F.array()), lambda x: x["type"] == "advisor_message")
    rows = rows.withColumn("components", F.transform(advised, lambda x: F.struct(x["model"].alias("model"), *(whole_number(x[c]).alias(n) for n, c in _ADVISED), whole_number(x["output_tokens_details"]["thinking_tokens"]).alias("reasoning"))))
    extra = lambda name: F.when(F.size("components") > 0, F.aggregate("components", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x[name], F.lit(0))))
    writes = split_writes(usage("cache_creation_input_tokens"), usage("cache_creation.ephemeral_5m_input_tokens"), usage("cache_creation.ephemeral_1h_input_tokens"))
    rows = rows.withColumn("w", writes)
    pricing = F.struct(*(F.col(f"b.message.usage.{c}").alias(c) for c in ("service_tier", "speed", "inference_geo")))
    return rows.select(
        "locator", "offset", "thread", "session", "file_session", "agent", "side", "nested", "foreign", F.col("b.message.id").alias("message"), F.col("b.requestId").alias("request_id"), F.col("b.uuid").alias("uuid"),
        F.col("b.message.model").alias("model"), F.col("b.effort").alias("effort"), pricing.alias("pricing"), "components", F.col("b.message.content").alias("content"), F.col("b.quotaLimits").alias("limits"),
        utc(F.col("b.timestamp").try_cast("timestamp")).alias("ts"), project(F.col("b.cwd")).alias("project"), whole_number(F.col("b.apiBlockIndex")).alias("block"),
        sum_known(usage("input_tokens"), extra("uncached_input")).alias("uncached_input"), sum_known(usage("cache_read_input_tokens"), extra("cache_read")).alias("cache_read"), "w.cache_write_5m", "w.cache_write_1h",
        sum_known(F.col("w.cache_write_unspecified"), extra("cache_write_unspecified")).alias("cache_write_unspecified"), sum_known(usage("output_tokens"), extra("output")).alias("output"),
        sum_known(usage("output_tokens_details.thinking_tokens"), extra("reasoning")).alias("reasoning"), F.lit(None).cast("long").alias("provider_only"), F.col("w.mismatch").alias("writes_mismatch"),
    )


_ADVISED = (("uncached_input", "input_tokens"), ("cache_read", "cache_read_input_tokens"), ("cache_write_unspecified", "cache_creation_input_tokens"), ("output", "output_tokens"))


def attributed(rows: DataFrame) -> DataFrame:
    """Observations with whether they are copies, and the thread that owns them."""
    eligible = ~F.col("nested") & ~F.col("foreign")
    child = F.col("agent").isNotNull() | F.col("side")
    order = F.struct(child.alias("child"), F.col("ts").isNull().alias("undated"), "ts", "locator", "offset")

    rows = base = stored(rows)  # read several times, parsed once

    def owners(key: str) -> DataFrame:
        return base.filter(eligible & F.col(key).isNotNull()).groupBy(key).agg(F.min_by("thread", order).alias("first_owner"))

    # rows without a key match nothing and stay out of the joins; a key that many rows have is dealt over tasks
    at = F.xxhash64("locator", "offset")
    rows = rows.withColumn("child", child)
    for key in ("uuid", "message"):
        rows = dealt_join(rows, owners(key).withColumnRenamed("first_owner", f"_by_{key}"), [key], at, "left")
        rows = rows.withColumn(f"_{key}_replayed", F.coalesce(F.col(f"_by_{key}") != F.col("thread"), F.lit(False)))
    by_message = F.col("child") & F.col("_message_replayed")
    native = F.when(F.col("foreign"), F.col("session")).otherwise(F.col("thread"))
    owner = F.when(F.col("_uuid_replayed"), F.col("_by_uuid")).when(by_message | F.col("nested"), F.coalesce("_by_message", native)).otherwise(native)
    rows = rows.withColumn("copy", F.col("nested") | F.col("foreign") | F.col("_uuid_replayed") | by_message).withColumn("owner", owner)
    return rows.drop("_uuid_replayed", "_message_replayed", "_by_uuid", "_by_message", "child")


def requests(rows: DataFrame) -> DataFrame:
    """One row for each request of attributed observations: its selected revision, owner or candidates, counting and place.

    A message id that stands for several models counts within its session only. Members of a set that name several models are
    requests by themselves. A set of copies alone has no usage.
    """
    place = F.concat_ws("#", "locator", F.col("offset").cast("string"), F.col("nested").cast("string"))
    keyed = scoped_ids(rows.withColumn("place", place), "message", "model", "session", "_message", ~F.col("copy"))
    message = F.when(F.col("message").isNotNull(), F.concat(F.lit("m:"), "_message"))
    keyed = keyed.withColumn("keys", F.array_compact(F.array(message, F.concat(F.lit("r:"), "request_id"))))
    keyed = keyed.join(linked_sets(keyed, "place", "keys"), "place")
    own_model = F.when(~F.col("copy"), F.col("model"))
    w = Window.partitionBy("set_id")
    split = F.coalesce(F.min(own_model).over(w) != F.max(own_model).over(w), F.lit(False))
    keyed = keyed.withColumn("request", F.when(split, F.concat(F.lit("local:"), "place")).otherwise(F.col("set_id")))
    original = ~F.col("copy")
    usage = F.coalesce(*MEASURES).isNotNull()
    # of equal places the lowest source wins: the complement of its name's digits
    lowest = F.translate(F.hex("locator"), "0123456789ABCDEF", "FEDCBA9876543210").alias("source")
    picked = select_revision(keyed.filter(original), ["request"], largest_output("output", "block", [F.col("offset"), lowest]), ["model", "effort", "project", "pricing", "components", *MEASURES], [*INPUTS, "provider_only"], usage)
    built = build_requests(keyed, ["request"], original, "ts", "offset").select("request", "originals", "copies", "first_seen", "last_seen", "copy_only")
    owned = ownership(keyed, ["request"], "owner")
    out = built.join(owned, "request").join(picked, "request", "left")
    return out.withColumn("counting", F.when(F.col("copy_only"), "copy_only").otherwise("counted"))


def limit_rows(rows: DataFrame) -> DataFrame:
    """Quota observations: one row for each record with limits, as canonical JSON."""
    entries = F.array_sort(F.map_entries("limits"))
    named = F.transform(entries, lambda e: F.concat(F.to_json(F.array(e["key"])).substr(F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2), F.lit(":"), e["value"]))
    return rows.filter("limits IS NOT NULL").select("locator", "offset", "owner", "ts", F.concat(F.lit("{"), F.array_join(named, ","), F.lit("}")).alias("window"))


def read_sidecars(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(session, agent, tool_use) of the `.meta.json` files beside subagents' transcripts; one that isn't an object, or is above 1 MiB, says nothing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "agent-*.meta.json").option("ignoreMissingFiles", True)
    there = [r for r in roots if not r.endswith((".jsonl", ".zst", ".gz"))]
    if not there:
        return spark.createDataFrame([], "session string, agent string, tool_use string")
    found = files.load(there).filter(f"length <= {1 << 20}").select("path", F.decode("content", "UTF-8").alias("body"))
    agent = F.regexp_extract("path", r"/agent-([^/]+)\.meta\.json$", 1)
    folder = F.regexp_extract("path", r"([^/]+)/subagents/(?!.*/subagents/)", 1)
    return found.select(folder.alias("session"), agent.alias("agent"), F.get_json_object("body", "$.toolUseId").alias("tool_use")).filter("tool_use IS NOT NULL")


def edges(rows: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Relations of threads: forks, inline sidechains, and one spawn for each subagent.

    sidecars has session, agent and tool_use. A subagent's parent is the thread that issued the call its sidecar names (the first
    by order of ownership, never the subagent itself), else its session.
    """
    fork = rows.filter("foreign").select(F.lit("fork").alias("kind"), F.col("session").alias("source"), F.col("thread").alias("target"), F.lit(True).alias("proven"), "offset")
    inline = rows.filter("side").select(F.lit("inline").alias("kind"), F.col("file_session").alias("source"), F.col("thread").alias("target"), F.lit(False).alias("proven"), "offset")
    order = F.struct((F.col("agent").isNotNull() | F.col("side")).alias("child"), F.col("ts").isNull().alias("undated"), "ts", "locator", "offset")
    issued = rows.select("thread", order.alias("at"), F.explode("content").alias("c")).filter("c.type = 'tool_use'").select("thread", "at", F.col("c.id").alias("tool_use"))
    children = rows.filter("agent IS NOT NULL").groupBy("thread", "file_session", "agent").agg(F.min("offset").alias("offset"))
    named = children.join(sidecars.select(F.col("session").alias("file_session"), "agent", "tool_use"), ["file_session", "agent"], "left")
    found = named.withColumnRenamed("thread", "target").join(issued, "tool_use", "left").filter("thread IS NULL OR thread <> target").groupBy("target").agg(F.min_by("thread", "at").alias("issuer"))
    spawn = children.join(found, F.col("thread") == F.col("target"), "left").select(F.lit("spawn").alias("kind"), F.coalesce("issuer", "file_session").alias("source"), F.col("thread").alias("target"), F.col("issuer").isNotNull().alias("proven"), "offset")
    return merge_edges(fork.unionByName(inline).unionByName(spawn), F.col("proven"), "offset")
