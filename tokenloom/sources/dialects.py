"""Where logs are looked for, and which dialect they are in."""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import PurePosixPath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MESSAGES, ROLLOUTS = "messages", "rollouts"
#: The record types of each dialect.
TYPES = {
    MESSAGES: ("assistant", "user", "progress", "system", "summary", "queue-operation", "file-history-snapshot", "attachment", "bridge-session", "custom-title"),
    ROLLOUTS: ("session_meta", "turn_context", "token_usage_record", "compacted", "event_msg", "response_item"),
}
#: Lines of a log that are looked at for a record of a known type.
PEEK = 100


class MixedDialects(ValueError):
    """Logs of several dialects lie under one root."""


class UnknownDialect(ValueError):
    """No log under a root has a record of a known type."""


def _listed(value: str) -> list[str]:
    return [p for p in value.split(":") if p]


def message_roots(variables: Mapping[str, str], home: str | None, override: str | None = None) -> list[str]:
    """The folders of message transcripts: of the variable named `override` (folders parted by `:`), else of the native
    variable, else those below the home folder. An empty variable counts as missing."""
    if override and variables.get(override):
        return [str(PurePosixPath(p) / "projects") for p in _listed(variables[override])]
    if variables.get("CLAUDE_CONFIG_DIR"):
        return [str(PurePosixPath(variables["CLAUDE_CONFIG_DIR"]) / "projects")]
    found = [PurePosixPath(home) / ".claude/projects"] if home else []
    if variables.get("XDG_CONFIG_HOME"):
        found.append(PurePosixPath(variables["XDG_CONFIG_HOME"]) / "claude/projects")
    elif home:
        found.append(PurePosixPath(home) / ".config/claude/projects")
    return sorted({str(p) for p in found})


def rollout_homes(variables: Mapping[str, str], home: str | None, override: str | None = None) -> list[str]:
    """The homes of rollouts, each with `sessions` and `archived_sessions`, in the same order of precedence."""
    if override and variables.get(override):
        return _listed(variables[override])
    if variables.get("CODEX_HOME"):
        return [variables["CODEX_HOME"]]
    return [str(PurePosixPath(home) / ".codex")] if home else []


def sniffed(heads: DataFrame) -> DataFrame:
    """(locator, dialect) of each log by the first record of a known type among its first lines (`read_heads`, PEEK of them); null where there is none,
    or where an oversized or damaged line comes first."""
    kind = F.get_json_object("line", "$.type")
    named = F.coalesce(*(F.when(kind.isin(*types), F.lit(d)) for d, types in TYPES.items()))
    said = F.when(F.col("state").isin("oversized", "failed"), F.lit("")).otherwise(named)
    found = heads.withColumn("_said", said).groupBy("locator").agg(F.min_by("_said", F.when(F.col("_said").isNotNull(), F.col("offset"))).alias("dialect"))
    return found.withColumn("dialect", F.nullif("dialect", F.lit("")))


def dialect_of(heads: DataFrame) -> str:
    """The only dialect of the logs under a root; logs that tell none don't count."""
    found = sorted(r["dialect"] for r in sniffed(heads).select("dialect").distinct().filter("dialect IS NOT NULL").collect())  # a row a dialect
    if len(found) > 1:
        raise MixedDialects(f"logs of several dialects ({', '.join(found)}): read each root by itself")
    if not found:
        raise UnknownDialect("no log has a record of a known type")
    return found[0]
