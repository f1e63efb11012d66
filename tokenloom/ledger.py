"""From logs to reports in one call: roots or files of both dialects, read, typed, attributed, reconciled and selected as one plan.

    ledger = read(spark, sources(spark, ["/logs/a", "/logs/b"]))
    report(ledger), daily(ledger, "Europe/Berlin"), sessions(ledger, chosen=covered(ledger, ["a-session"]))

`read` keeps what both the ledger's parts and its reports use more than once, the typed observations, in the cluster's checkpoint folder. With sessions named, only the
files of their families are read at all (`families`): heads tell which files belong together. Everything here is a DataFrame; only names of dialects, and the
locators of named sessions' families, reach the driver.
"""

from __future__ import annotations

import time
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass, replace
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions.measures import MEASURES
from tokenloom.operators import conditions, rollups, selection
from tokenloom.operators.graph import connected_components, stored
from tokenloom.sources import accounting, dialects, logs, rollouts, transcripts
from tokenloom.sources.dialects import MESSAGES, ROLLOUTS

#: The agent whose logs are in a dialect.
AGENTS = {MESSAGES: "claude", ROLLOUTS: "codex"}
Roots = dict[str, list[str]]


@dataclass
class Ledger:
    """threads: id, agent, session, native_id, path, located, project. requests: agent, request, owner, status, candidates, counting, instants, model,
    effort, project, measures. edges: kind, source, target, found. gaps: agent, thread, code, occurrences. logs: agent, locator, lines by state."""

    threads: DataFrame
    requests: DataFrame
    edges: DataFrame
    gaps: DataFrame
    logs: DataFrame


def default_roots(variables: Mapping[str, str], home: str | None) -> Roots:
    """Where each dialect's logs are looked for if nothing else is said."""
    homes = dialects.rollout_homes(variables, home)
    return {MESSAGES: dialects.message_roots(variables, home), ROLLOUTS: [f"{h}/{d}" for h in homes for d in ("sessions", "archived_sessions")]}


def sources(spark: SparkSession, paths: list[str]) -> Roots:
    """Folders and files, each by the dialect of its logs. One that holds several dialects, or none, is an error."""
    out: Roots = {MESSAGES: [], ROLLOUTS: []}
    for path in paths:
        out[dialects.dialect_of(logs.read_heads(spark, path, dialects.PEEK))].append(path)
    return out


def _message_heads(heads: DataFrame) -> DataFrame:
    """(locator, family, name): the sessions that a transcript's path and, for a subagent's, its first named session put it with."""
    agent = F.nullif(F.regexp_extract("locator", transcripts.CHILD, 1), F.lit(""))
    folder = F.regexp_extract("locator", r"([^/]+)/subagents/(?!.*/subagents/)", 1)
    stem = F.regexp_extract("locator", r"([^/]+)\.jsonl$", 1)
    named = F.min_by(F.get_json_object("line", "$.sessionId"), F.when(F.get_json_object("line", "$.sessionId").isNotNull(), F.col("offset")))
    files = heads.groupBy("locator").agg(named.alias("named")).withColumn("agent", agent)
    own = F.when(F.col("agent").isNull(), stem).otherwise(folder)
    families = F.array_distinct(F.array_compact(F.array(own, F.when(F.col("agent").isNotNull(), F.col("named")))))
    return files.select("locator", F.explode(families).alias("family"), F.coalesce("agent", stem).alias("name"))


def _rollout_heads(heads: DataFrame) -> DataFrame:
    """(locator, family, name): rollouts are one family with those that their headers name as parents, however indirectly."""
    meta = heads.filter(F.get_json_object("line", "$.type") == "session_meta").withColumn("n", rollouts.named(F.col("locator")))
    thread = F.col("n.thread")
    p = lambda c: F.get_json_object("line", f"$.payload.{c}")
    links = F.array_compact(F.array(thread, p("id"), p("parent_thread_id"), p("forked_from_id"), p("source.subagent.thread_spawn.parent_thread_id")))
    edges = meta.select(thread.alias("a"), F.explode(links).alias("b")).distinct()
    roots = connected_components(edges)
    files = heads.select("locator").distinct().withColumn("name", rollouts.named(F.col("locator"))["thread"])
    return files.join(roots, F.col("name") == F.col("node"), "left").select("locator", F.coalesce("root", "name").alias("family"), "name")


def families(spark: SparkSession, roots: Roots) -> DataFrame:
    """(dialect, locator, family, name) of each log, from its first lines alone."""
    parts = [find(logs.read_heads(spark, roots[d], dialects.PEEK)).select(F.lit(d).alias("dialect"), "locator", "family", "name") for d, find in ((MESSAGES, _message_heads), (ROLLOUTS, _rollout_heads)) if roots.get(d)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def narrowed(spark: SparkSession, roots: Roots, sessions: list[str]) -> dict[str, list[str]] | None:
    """The logs of the families that sessions (native ids or paths) belong to, by dialect; None where one isn't found among heads, so that everything must be read."""
    found = stored(families(spark, roots))
    wanted = found.filter(F.col("name").isin(sessions) | F.col("family").isin(sessions) | F.col("locator").isin([logs.path_locator(s) for s in sessions]))
    known = wanted.agg(*(F.max((F.col("name") == s) | (F.col("family") == s) | (F.col("locator") == logs.path_locator(s))) for s in sessions)).first()
    if not all(known):
        return None
    out: dict[str, list[str]] = {d: [] for d in roots}
    for r in found.join(wanted.select("dialect", "family").distinct(), ["dialect", "family"], "left_semi").select("dialect", "locator").distinct().collect():  # the files of the named sessions
        out[r["dialect"]].append(r["locator"])
    return out


class Stats:
    """Counts and seconds of what a run did, in the order in which it did it; counts come from metrics that Spark takes along while the parts are made."""

    def __init__(self):
        self.metrics: list[tuple[str, Observation]] = []
        self.seconds: dict[str, float] = {}

    def watched(self, rows: DataFrame, name: str, *metrics: Column) -> DataFrame:
        """The rows; their count and the metrics are known once they have been made."""
        seen = Observation(f"{name}-{len(self.metrics)}")
        self.metrics.append((name, seen))
        return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *metrics)

    @contextmanager
    def phase(self, name: str) -> Iterator[None]:
        began = time.monotonic()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.monotonic() - began

    def lines(self) -> list[str]:
        """One line a measurement, as key=value."""
        out = [f"stats: phase={k} seconds={v:.3f}" for k, v in self.seconds.items()]
        return out + [f"stats: part={name} " + " ".join(f"{k}={v}" for k, v in seen.get.items()) for name, seen in self.metrics]


_REQUEST = ("request", "owner", "status", "candidates", "counting", "originals", "copies", "first_seen", "last_seen", "model", "effort", "project", *MEASURES)


def _line_states() -> list[Column]:
    return [F.count_if(F.col("state") == s).alias(s) for s in ("record", "malformed", "oversized", "pending", "failed")]


def coverage(ledger: Ledger) -> DataFrame:
    """What reconciliation did with each agent's observations, in one pass over requests."""
    counted = F.col("counting") == "counted"
    return ledger.requests.groupBy("agent").agg(
        F.sum(F.col("originals") + F.col("copies")).alias("observations"), F.sum("copies").alias("copies"), F.count("*").alias("requests"), F.count_if(F.col("counting") == "copy_only").alias("copy_only_requests"),
        F.count_if(counted & F.coalesce(*MEASURES).isNull()).alias("requests_without_usage"), F.count_if(F.col("counting") == "unresolved").alias("unresolved_requests"), F.count_if(F.col("status") == "ambiguous").alias("ambiguous_requests"),
        F.count_if(counted & F.col("last_seen").isNull()).alias("undated_requests"),
    )


def _of_messages(spark: SparkSession, roots: list[str], only: list[str] | None, stats: Stats) -> Ledger:
    lines = logs.read_lines(spark, roots, only=only)
    with stats.phase("read-messages"):
        seen = stats.watched(transcripts.observations(stats.watched(lines, "message-lines", *_line_states())), "message-observations", F.count_if(F.col("ts").isNull()).alias("undated"))
        owned = transcripts.attributed(seen)
    with stats.phase("attribute-messages"):
        rows = stored(stats.watched(owned, "message-owners", F.count_if("copy").alias("copies")))
    requests = transcripts.requests(rows)
    sidecars = transcripts.read_sidecars(spark, roots)
    edges = transcripts.edges(rows, sidecars).select("kind", "source", "target", F.col("proven").alias("found"))
    own = rows.groupBy(F.col("thread").alias("id")).agg(F.min("file_session").alias("session"), F.min(F.coalesce("agent", "file_session")).alias("native_id"), F.min("locator").alias("path"), F.max(~F.col("side")).alias("located"), F.min_by("project", F.struct("locator", "offset")).alias("project"))
    counts = stored(logs.manifest(lines))
    gaps = rows.limit(0).select(F.col("thread"), F.lit("").alias("code"), F.lit(0).cast("long").alias("occurrences"))
    return Ledger(own, requests.select(*_REQUEST), edges, gaps, counts)


def _of_rollouts(spark: SparkSession, roots: list[str], only: list[str] | None, stats: Stats) -> Ledger:
    lines = logs.read_lines(spark, roots, only=only)
    with stats.phase("read-rollouts"):
        rows = stored(stats.watched(rollouts.events(stats.watched(lines, "rollout-lines", *_line_states())), "rollout-events"))
    with stats.phase("account-rollouts"):
        kinds = (F.count_if((F.col("what") == "usage") & ~F.col("copy")).alias("originals"), F.count_if((F.col("what") == "usage") & F.col("copy")).alias("copies"), F.count_if(F.col("what") == "gap").alias("gaps"), F.count_if(F.col("what") == "diagnostic").alias("diagnostics"))
        found = stored(stats.watched(rollouts.in_context(accounting.observe(rows), rows), "rollout-usage", *kinds))
    projects = rows.filter("kind = 'session_meta' AND id = file_thread").groupBy("file_thread").agg(F.min_by("project", F.struct("locator", "offset")).alias("project"))
    own = rows.groupBy("file_thread").agg(F.min("locator").alias("path")).join(projects, "file_thread", "left")
    own = own.select(F.col("file_thread").alias("id"), F.col("file_thread").alias("session"), F.col("file_thread").alias("native_id"), "path", F.lit(True).alias("located"), "project")
    requests = rollouts.requests(found.filter("what = 'usage'")).join(projects.select(F.col("file_thread").alias("owner"), "project"), "owner", "left")
    gaps = found.filter("what = 'gap'").groupBy(F.col("file_thread").alias("thread"), "code").agg(F.count("*").alias("occurrences"))
    return Ledger(own, requests.select(*_REQUEST), rollouts.relations(rows).select("kind", "source", "target", "found"), gaps, stored(logs.manifest(lines)))


def read(spark: SparkSession, roots: Roots, sessions: list[str] | None = None, stats: Stats | None = None) -> Ledger:
    """The ledger of all logs under roots; with `sessions`, of the logs of their families. `stats` gets counts and seconds."""
    stats = stats or Stats()
    roots = {d: r for d, r in roots.items() if r}
    only = narrowed(spark, roots, sessions) if sessions else None
    parts = []
    for dialect, build in ((MESSAGES, _of_messages), (ROLLOUTS, _of_rollouts)):
        if roots.get(dialect):
            part = build(spark, roots[dialect], None if only is None else only[dialect], stats)
            agent = F.lit(AGENTS[dialect]).alias("agent")
            parts.append(Ledger(*(getattr(part, f).select(agent, "*") for f in Ledger.__dataclass_fields__)))
    if not parts:
        raise ValueError("a ledger needs roots")
    return Ledger(*(reduce(lambda a, b: a.unionByName(b), [getattr(p, f) for p in parts]) for f in Ledger.__dataclass_fields__))


def covered(ledger: Ledger, sessions: list[str], everything: bool = False, agents: tuple[str, ...] = (), scope: str | None = None) -> DataFrame:
    """Ids of the threads that a query covers; each session is a native id, an id or a path."""
    named = [ledger.threads.filter(F.lit(selection.resolve(ledger.threads, s)) == F.col("id")).select("id") for s in sessions]
    edges = ledger.edges.select(F.col("source").alias("parent"), F.col("target").alias("child"))
    return selection.covered(ledger.threads, edges, [selection.any_of(named)] if named else [], everything or not named, agents, scope)


def choice(ledger: Ledger, command: str, sessions: list[str] = (), everything: bool = False, current: bool = False, given: bool = False, environment: Mapping[str, str] | None = None, variables: Mapping[str, str] | None = None, scope: str | None = None) -> DataFrame | None:
    """The threads that a command covers if it is told this much, for the functions named `daily`, `sessions` and `report`; None for all of them.

    Without a choice, `daily` and `sessions` cover everything, and so does `report` where sources were given (`given`), else the session the process runs in, as
    the environment names it (variables: each agent's name for it). Named sessions and the current one intersect.
    """
    if command not in ("report", "daily", "sessions"):
        raise ValueError(command)
    chosen = bool(sessions) or everything or current
    if everything or not chosen and (given or command != "report"):
        return covered(ledger, list(sessions), everything=True, scope=scope) if sessions or scope else None
    names = list(sessions)
    parts = [covered(ledger, names, scope=scope)] if names else []
    if current or not chosen:
        agent, own = selection.current_session(dict(environment or {}), dict(variables or {}))
        parts.append(covered(ledger, [own], agents=(agent,), scope=scope))
    return selection.select(parts)


def within(ledger: Ledger, since: datetime | None = None, until: datetime | None = None, where: Column | None = None) -> Ledger:
    """The ledger with the requests last seen in a half-open interval, and for which a condition on them is true. Threads, gaps and logs have no instant and stay."""
    rows = ledger.requests.filter(conditions.during(F.col("last_seen"), since, until))
    return replace(ledger, requests=rows if where is None else rows.filter(where))


def active(ledger: Ledger, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """Ids of the threads with usage in an interval: as a choice they bring all their usage, also that outside it."""
    return conditions.active_threads(ledger.requests, "owner", "last_seen", since, until)


def latest(ledger: Ledger, project: str | None = None) -> DataFrame:
    """The id of the thread used last, of those of a project if one is named."""
    return conditions.latest_thread(ledger.requests, "owner", "last_seen", None if project is None else F.col("project") == project)


def of_projects(ledger: Ledger, projects: list[str]) -> DataFrame:
    """Ids of the threads that belong to any of the projects."""
    return ledger.threads.filter(F.col("project").isin(projects)).select("id").distinct()


def placed(requests: DataFrame, chosen: DataFrame | None) -> DataFrame:
    """Requests with `place`: inside the chosen threads (column id), possible where only some of their candidates are, else outside. Without a choice all are inside."""
    if chosen is None:
        return requests.withColumn("place", F.lit("inside"))
    rows = requests.withColumn("_id", F.concat_ws("/", "agent", "request"))
    each = rows.select("_id", F.explode("candidates").alias("id")).distinct().join(chosen.select("id").distinct().withColumn("_in", F.lit(1)), "id", "left")
    hits = each.groupBy("_id").agg(F.count("*").alias("_known"), F.sum(F.coalesce("_in", F.lit(0))).alias("_hits"))
    place = F.when(F.coalesce("_hits", F.lit(0)) == 0, "outside").when(F.col("_hits") == F.col("_known"), "inside").otherwise("possible")
    return rows.join(hits, "_id", "left").withColumn("place", place).drop("_id", "_known", "_hits")


def _counted(ledger: Ledger, chosen: DataFrame | None) -> DataFrame:
    return placed(ledger.requests, chosen).filter("counting = 'counted' AND place = 'inside'")


def report(ledger: Ledger, chosen: DataFrame | None = None) -> DataFrame:
    """One row of totals: counted requests by status, measures, copies, possible ones, gaps, lost lines, and whether all of it is complete."""
    rows = placed(ledger.requests, chosen)
    totals = rollups.with_derived(rollups.totals(rows.filter("place = 'inside'")))
    possible = rows.filter("place = 'possible' AND counting = 'counted'").agg(F.count("*").alias("possible"))
    gaps = ledger.gaps if chosen is None else ledger.gaps.join(chosen.select(F.col("id").alias("thread")), "thread", "left_semi")
    gaps = gaps.agg(F.coalesce(F.sum("occurrences"), F.lit(0)).alias("gaps"))
    lost = ledger.logs.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("malformed", "oversized", "pending", "failed")))
    out = totals
    for one in (possible, gaps, lost):  # a row each
        out = out.join(F.broadcast(one), F.lit(True))
    return out.withColumn("complete", F.col("complete") & (F.col("gaps") == 0) & (F.col("possible") == 0) & (F.col("malformed") + F.col("oversized") + F.col("failed") == 0))


def daily(ledger: Ledger, zone: str = "UTC", chosen: DataFrame | None = None) -> DataFrame:
    """Counted requests by local date of their last sight; those without an instant are a row of their own."""
    return rollups.daily(_counted(ledger, chosen), "last_seen", zone)


def sessions(ledger: Ledger, zone: str = "UTC", chosen: DataFrame | None = None) -> DataFrame:
    """Every thread with its requests and sums; requests without an owner are one row for each agent."""
    threads = ledger.threads if chosen is None else ledger.threads.join(chosen.select("id"), "id", "left_semi")
    rows = _counted(ledger, chosen)
    owned = rollups.sessions(threads.select("id", "agent", "session", "project"), rows.filter("owner IS NOT NULL"), "id", "owner", "last_seen", zone)
    lone = rows.filter("owner IS NULL").groupBy("agent").agg(F.count("*").alias("requests"), *rollups.measure_sums(), F.max(rollups.local_date(F.col("last_seen"), zone)).alias("last_date"), F.count_if(F.col("last_seen").isNull()).alias("undated_requests"))
    return owned.unionByName(rollups.with_derived(lone), allowMissingColumns=True)


def breakdowns(ledger: Ledger, dimensions: list[str], chosen: DataFrame | None = None) -> DataFrame:
    """Independent breakdowns of counted requests by agent, model, effort or project."""
    return rollups.breakdowns(_counted(ledger, chosen), dimensions)


def by(ledger: Ledger, column: Column, chosen: DataFrame | None = None, having: Column | None = None) -> DataFrame:
    """Counted requests grouped by any expression over them (column value); with `having`, the groups whose sums meet it."""
    out = rollups.with_derived(_counted(ledger, chosen).groupBy(column.alias("value")).agg(F.count("*").alias("requests"), *rollups.measure_sums()))
    return out if having is None else out.filter(having)
