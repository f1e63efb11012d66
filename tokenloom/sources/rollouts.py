"""Rollouts: files of one thread's usage as records and cumulative counters, to observations.

This module types the lines and what stands around usage; module accounting says which usage counts, and whose it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.measures import INPUTS, MEASURES, counts_only
from tokenloom.operators.ordered import in_force
from tokenloom.operators.reconcile import build_requests, ownership, select_revision
from tokenloom.sources.transcripts import project, utc

COUNTS = ("input_tokens", "cached_input_tokens", "cache_write_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens")
_U = "STRUCT<" + ", ".join(f"{c}: DECIMAL(38,6)" for c in COUNTS) + ">"
_PAYLOAD = (
    "id: STRING, parent_thread_id: STRING, forked_from_id: STRING, model_provider: STRING, cwd: STRING, subagent_history_start_ordinal: STRING, history_mode: STRING, history_base: STRING, thread_source: STRING, source: STRING, turn_id: STRING, root_turn_id: STRING, model: STRING, effort: STRING,"
    f" thread_id: STRING, response_id: STRING, usage: {_U}, type: STRING, info: STRUCT<total_token_usage: {_U}, last_token_usage: {_U}>, latest_token_usage_record: STRUCT<thread_id: STRING, response_id: STRING, turn_id: STRING, root_turn_id: STRING, usage: {_U}>,"
    " thread_settings: STRUCT<service_tier: STRING, model_provider_id: STRING>, rate_limits: STRUCT<limit_id: STRING, limit_name: STRING, primary: MAP<STRING,STRING>, secondary: MAP<STRING,STRING>>"
)
#: One of these stands in every line that matters.
MARKERS = ("session_meta", "turn_context", "token_usage_record", "compacted", "token_count", "thread_settings_applied")


def named(locator: Column) -> Column:
    """thread and rollout of a file's name: the last 36 characters, or those before `_` and a rollout of its own."""
    stem = F.regexp_extract(locator, r"([^/]+)\.jsonl$", 1)
    thread = F.regexp_extract(stem, r"(.{36})(?:_(.+))?$", 1)
    return F.struct(thread.alias("thread"), F.coalesce(F.nullif(F.regexp_extract(stem, r".{36}_(.+)$", 1), F.lit("")), thread).alias("rollout"))


def _whole(usage: Column) -> Column:
    return F.struct(*(F.when((usage[c] >= 0) & (usage[c] == F.floor(usage[c])), usage[c].cast("long")).alias(c) for c in COUNTS))


def events(lines: DataFrame) -> DataFrame:
    """Typed rows of the lines that matter: kind, ordinal, and the payload's fields."""
    hinted = lines.filter((F.col("state") == "record") & F.array_contains(F.array(*(F.col("line").contains(f'"{m}"') for m in MARKERS)), True))
    parsed = hinted.withColumn("r", F.from_json(counts_only(F.col("line")), f"STRUCT<type: STRING, timestamp: STRING, ordinal: DECIMAL(38,6), payload: STRUCT<{_PAYLOAD}>>"))
    kind = F.when(F.col("r.type") == "event_msg", F.col("r.payload.type")).otherwise(F.col("r.type"))
    record = F.when(F.col("r.type") == "compacted", F.col("r.payload.latest_token_usage_record")).otherwise(F.struct(*(F.col(f"r.payload.{c}") for c in ("thread_id", "response_id", "turn_id", "root_turn_id", "usage"))))
    rows = parsed.withColumn("kind", kind).filter(F.col("kind").isin(*MARKERS)).withColumn("u", record).withColumn("n", named(F.col("locator")))
    p = lambda c: F.col(f"r.payload.{c}")
    start = p("subagent_history_start_ordinal")
    inner = F.get_json_object(p("source"), "$.subagent")
    subagent = F.coalesce(p("thread_source").isin("subagent", "guardian_review"), F.lit(False)) | F.coalesce(inner != "memory_consolidation", F.lit(False))
    return rows.select(
        (p("history_mode") == "paginated").alias("paginated"), p("history_base").isNotNull().alias("based"), subagent.alias("subagent"), F.get_json_object(p("source"), "$.subagent.thread_spawn.parent_thread_id").isNotNull().alias("nested"),
        project(p("cwd")).alias("project"), "locator", "offset", F.col("n.thread").alias("file_thread"), F.col("n.rollout").alias("rollout"), "kind", utc(F.col("r.timestamp").try_cast("timestamp")).alias("ts"), F.col("r.ordinal").cast("long").alias("ordinal"), p("id").alias("id"),
        F.coalesce(p("parent_thread_id"), p("forked_from_id")).alias("parent"), F.when(p("parent_thread_id").isNotNull(), "spawn").when(p("forked_from_id").isNotNull(), "fork").alias("relation"),
        start.try_cast("long").alias("boundary"), (start.isNotNull() & start.try_cast("long").isNull()).alias("boundary_invalid"), F.coalesce("u.thread_id", p("thread_id")).alias("thread_id"), F.col("u.response_id").alias("response_id"),
        F.coalesce("u.turn_id", "u.root_turn_id", p("turn_id")).alias("turn"), p("model").alias("model"), p("effort").alias("effort"), p("thread_settings.service_tier").alias("tier"),
        F.coalesce(p("thread_settings.model_provider_id"), p("model_provider")).alias("provider"), p("rate_limits").alias("rate_limits"), _whole(F.col("u.usage")).alias("usage"), _whole(p("info.total_token_usage")).alias("total"), _whole(p("info.last_token_usage")).alias("last"),
    )


def in_context(usage: DataFrame, rows: DataFrame) -> DataFrame:
    """Usage with the model and effort of its turn, and the tier and provider in force: the last before it in its file."""
    turns = rows.filter("kind = 'turn_context'").select("locator", "turn", "offset", "model", "effort")
    settings = rows.filter("tier IS NOT NULL OR provider IS NOT NULL").select("locator", "offset", "tier", "provider")
    return in_force(in_force(usage, turns, ["locator", "turn"], "offset", ["model", "effort"]), settings, ["locator"], "offset", ["tier", "provider"])


def requests(usage: DataFrame) -> DataFrame:
    """One row for each request of usage in context: observations of one key are one request; the latest original stands for it. Usage without a key is a request by itself."""
    place = F.concat_ws("#", "locator", F.col("offset").cast("string"))
    keyed = usage.withColumn("request", F.coalesce("key", F.concat(F.lit("local:"), place)))
    missing = [m for m in MEASURES if m not in usage.columns]
    keyed = keyed.withColumns({m: F.lit(None).cast("long") for m in missing})
    original, reported = ~F.col("copy"), F.coalesce(*MEASURES).isNotNull()
    order = F.struct("ts", "locator", "offset")
    picked = select_revision(keyed.filter(original), ["request"], order, ["model", "effort", "tier", "provider", *MEASURES], [*INPUTS, "provider_only"], reported)
    built = build_requests(keyed, ["request"], original, "ts", "offset").select("request", "originals", "copies", "first_seen", "last_seen", "copy_only")
    out = built.join(ownership(keyed, ["request"], "owner"), "request").join(picked, "request", "left")
    return out.withColumn("counting", F.when(F.col("copy_only"), "copy_only").otherwise("counted"))


def relations(rows: DataFrame) -> DataFrame:
    """Edges (kind, source, target) that files name, and whether the parent was found."""
    metas = rows.filter("kind = 'session_meta' AND id = file_thread AND parent IS NOT NULL").select(F.col("relation").alias("kind"), F.col("parent").alias("source"), F.col("id").alias("target")).distinct()
    known = rows.select(F.col("file_thread").alias("source")).distinct().withColumn("found", F.lit(True))
    return metas.join(known, "source", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def limit_windows(rows: DataFrame) -> DataFrame:
    """One row for each quota window that a counter reports."""
    window = F.explode(F.array_compact(F.array(F.col("rate_limits.primary"), F.col("rate_limits.secondary"))))
    named_ = rows.filter("rate_limits IS NOT NULL").select("locator", "offset", "ts", F.coalesce("rate_limits.limit_id", "rate_limits.limit_name").alias("limit"), window.alias("window"))
    return named_.withColumn("window", F.array_join(F.transform(F.array_sort(F.map_entries("window")), lambda e: F.concat_ws("=", e["key"], e["value"])), ","))


def duplicate_locations(files: DataFrame) -> DataFrame:
    """Rollouts that lie at several places."""
    return files.withColumn("n", named(F.col("locator"))).groupBy("n.rollout").agg(F.count("*").alias("locations"), F.min("locator").alias("first")).filter("locations > 1")
