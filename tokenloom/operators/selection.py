"""Which threads a query covers: selectors, set operations on them, properties of candidates."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.operators.graph import descendants


class UnknownSelector(ValueError):
    """No thread matches a selector."""


class AmbiguousSelector(ValueError):
    """Several threads match a selector."""


def select(clauses: list[DataFrame]) -> DataFrame:
    """Threads that every clause has; a query without a clause is an error."""
    if not clauses:
        raise ValueError("a selection needs a clause")
    return reduce(lambda a, b: a.intersect(b), clauses).distinct()


def any_of(parts: list[DataFrame]) -> DataFrame:
    """Threads that any part has, as of a selector given more than once."""
    return reduce(lambda a, b: a.unionByName(b), parts).distinct()


def resolve(threads: DataFrame, text: str, columns: tuple[str, ...] = ("id", "native_id"), path: str = "path", located: str = "located") -> str:
    """The id of the one thread that a selector names by id, native id or path.

    A path may hold records of several threads; if only the path matches and threads has the column `located` (whether
    the path is the thread's own place), the one thread located there is meant.
    """
    named = reduce(lambda a, b: a | b, (F.coalesce(F.col(c) == text, F.lit(False)) for c in columns))
    own = F.coalesce(F.col(located), F.lit(False)) if located in threads.columns else F.lit(False)
    matches = threads.withColumns({"_named": named, "_own": own}).filter(F.col("_named") | (F.col(path) == text))
    each = matches.groupBy("id").agg(F.max("_named").alias("named"), F.max("_own").alias("own"))
    count, named_any, least, own_count, own_id = each.agg(F.count("*"), F.max("named"), F.min("id"), F.count_if("own"), F.min(F.when(F.col("own"), F.col("id")))).first()
    if count == 0:
        raise UnknownSelector(text)
    if count == 1:
        return least
    if not named_any and own_count == 1:
        return own_id
    raise AmbiguousSelector(f"{text}: {count} threads")


def current_session(environment: dict[str, str], variables: dict[str, str], allowed: tuple[str, ...] = ()) -> tuple[str, str]:
    """(agent, selector) of the session the process runs in; variables names each agent's. None or several are errors."""
    found = [(agent, environment[name]) for agent, name in variables.items() if environment.get(name) and (not allowed or agent in allowed)]
    if not found:
        raise UnknownSelector("no current session")
    if len(found) > 1:
        raise AmbiguousSelector("current session of " + ", ".join(agent for agent, _ in found))
    return found[0]


def covered(threads: DataFrame, edges: DataFrame, clauses: list[DataFrame], everything: bool = False, agents: tuple[str, ...] = (), scope: str | None = None) -> DataFrame:
    """Ids of the threads (columns id, agent) that a query covers.

    Clauses are tables of ids and intersect; `everything` is a clause of all. Without a scope, clauses take their
    descendants along and `everything` alone doesn't. Agents, if any are given, apply to what the scope has added too.
    """
    parts = [*clauses, *([threads.select("id")] if everything else [])]
    chosen = select(parts)
    if (scope or ("descendants" if clauses else "self")) == "descendants":
        chosen = descendants(edges, chosen.select(F.col("id").alias("node"))).select(F.col("node").alias("id"))
    kept = threads.filter(F.col("agent").isin(*agents)) if agents else threads
    return chosen.join(kept.select("id").distinct(), "id", "left_semi")


def relevant(diagnostics: DataFrame, chosen: DataFrame, everything: bool) -> DataFrame:
    """Diagnostics without a subject, and those of chosen threads (column id)."""
    if everything:
        return diagnostics
    general = diagnostics.filter(F.col("subject").isNull())
    return general.unionByName(diagnostics.join(chosen.select(F.col("id").alias("subject")), "subject", "left_semi"))


def candidate_property(rows: DataFrame, key: str, candidates: str, threads: DataFrame, thread: str, value: str, to: str) -> DataFrame:
    """The value that all known candidates of a row share, else `ambiguous`, or `unknown` if none is known."""
    each = rows.select(key, F.explode_outer(candidates).alias("_candidate")).join(threads.select(F.col(thread).alias("_candidate"), F.col(value).alias("_value")), "_candidate", "left")
    n = F.count_distinct("_value")
    kind: Column = F.when(n == 0, "unknown").when(n == 1, F.min("_value")).otherwise("ambiguous")
    return each.groupBy(key).agg(kind.alias(to))


def thread_sources(evidence: DataFrame, located: DataFrame, sources: DataFrame) -> DataFrame:
    """(thread, path): the files of each thread, each once: those of the sources that its evidence (thread, source) names, and those whose locator
    begins with the thread's own native id and a slash. located has thread and native_id; sources has source, locator and paths (a file and its twins)."""
    named = evidence.select("thread", "source").distinct().join(sources.select("source", "paths"), "source").select("thread", F.explode("paths").alias("path"))
    first = F.when(F.contains("locator", F.lit("/")), F.split_part("locator", F.lit("/"), F.lit(1)))
    own = sources.select(first.alias("native_id"), "paths").join(located.select("thread", "native_id").distinct(), "native_id").select("thread", F.explode("paths").alias("path"))
    return named.unionByName(own).distinct()


class HookMismatch(ValueError):
    """A hook's transcript is not that of the session it names."""


class UnsavedSession(ValueError):
    """A hook's session has no transcript yet."""


def hook_input(text: str | bytes) -> dict[str, str | None]:
    """session, child (a subagent's id, if any) and path of a hook's JSON; when a subagent stops, the path is its own."""
    try:
        value = json.loads(text)
    except ValueError as e:
        raise ValueError("hook input is not JSON") from e
    value = value if isinstance(value, dict) else {}
    child = value.get("agent_id")
    field = "agent_transcript_path" if value.get("hook_event_name") == "SubagentStop" else "transcript_path"
    if not isinstance(value.get("session_id"), str):
        raise ValueError("hook input lacks session_id")
    if field not in value or not isinstance(value[field], str | None):
        raise ValueError(f"hook input lacks {field}")
    return {"session": value["session_id"], "child": child if isinstance(child, str) else None, "path": value[field]}


def resolve_hook(threads: DataFrame, hook: dict[str, str | None], one_id: bool = False) -> str:
    """The id of the thread whose transcript a hook names, if the thread is the session's.

    threads has the columns of `resolve` and session and child; where threads have `one_id` of their own, that native id
    must be the hook's child, or its session where it names no child.
    """
    if hook["path"] is None:
        raise UnsavedSession(hook["session"])
    found = resolve(threads, hook["path"])
    if one_id:
        same = F.col("native_id") == (hook["child"] or hook["session"])
    else:
        same = (F.col("session") == hook["session"]) & (F.lit(hook["child"] is None) | (F.col("child") == F.lit(hook["child"])))
    if threads.filter((F.col("id") == found) & same).isEmpty():
        raise HookMismatch(found)
    return found
