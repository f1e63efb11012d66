"""Reports as documents: the order of their rows, JSON and text tables.

Rows are sorted and formatted by Spark and written by its tasks; only `document`, one JSON object for a reader, brings
rows to the driver, and refuses more than it is told to.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.texts import shown

# The codes of diagnostics, in the order in which they are reported.
CODES = (
    "conflicting-reread", "conflicting-shared-key", "conflicting-owners", "conflicting-accounts", "conflicting-models",
    "conflicting-pricing-context", "revision-disagreement", "copy-without-original", "unresolved-candidate",
    "usage-inconsistency", "counter-reset", "counter-gap", "claude-block-usage-conflict",
    "claude-cache-creation-breakdown-mismatch", "claude-nested-copy-without-original", "identity-key-conflict",
    "codex-copied-history-inferred", "codex-counter-epoch-reset", "codex-estimate-compaction",
    "codex-estimate-context-window-fill", "codex-history-boundary-unverified", "codex-inclusive-input-underflow",
    "codex-rollout-duplicate-location", "malformed-line", "pending-tail", "source-incomplete", "thread-orphan",
)
# Agents in the order in which their rows come.
AGENTS = ("claude", "codex", "pi")


class TooManyRows(ValueError):
    """A document would hold more rows than it may."""


def rank(value: Column, order: tuple[str, ...]) -> Column:
    """The place of a value in a listed order, from 0; values that aren't listed come after all."""
    at = F.array_position(F.array(*(F.lit(v) for v in order)), value)
    return F.when(at > 0, at - 1).otherwise(len(order)).cast("int")


def daily_order(date: str = "date") -> list[Column]:
    """Dates in order; requests without a date come last."""
    return [F.asc_nulls_last(date)]


def sessions_order(thread: str = "thread", agent: str = "agent") -> list[Column]:
    """Each agent's requests without an owner, in the order of agents, then the threads in order."""
    unowned = F.col(thread).isNull()
    return [F.when(unowned, 0).otherwise(1), F.when(unowned, rank(F.col(agent), AGENTS)).otherwise(0), F.col(thread)]


def breakdowns_order(dimension: str = "dimension", value: str = "value") -> list[Column]:
    return [F.col(dimension), F.col(value)]


def diagnostics_order(code: str = "code", *rest: str) -> list[Column]:
    """By the codes' listed order, not their text."""
    return [rank(F.col(code), CODES), F.col(code), *(F.asc_nulls_last(c) for c in rest)]


def text_line(cells: list[Column], between: str = " | ") -> Column:
    """One line of a text table: counts with separators, a dash for what isn't known (see `cell`)."""
    return F.concat_ws(between, *cells)


def cell(rows: DataFrame, name: str) -> Column:
    """A column as a table shows it."""
    kind = dict(rows.dtypes)[name]
    whole = kind in ("tinyint", "smallint", "int", "bigint") or kind.startswith("decimal")
    return shown(F.col(f"`{name}`")) if whole else F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("-"))


def text_table(rows: DataFrame, columns: list[str], order: list[Column]) -> DataFrame:
    """The rows as lines of text (column line), in order."""
    return rows.orderBy(*order).select(text_line([cell(rows, c) for c in columns]).alias("line"))


def write_text(rows: DataFrame, columns: list[str], order: list[Column], path: str) -> None:
    """The text table in files whose names follow the order. The header is the first line of its own file."""
    text_table(rows, columns, order).write.text(f"{path}/rows")
    rows.sparkSession.range(1, numPartitions=1).select(F.lit(" | ".join(c.upper() for c in columns)).alias("line")).write.text(f"{path}/header")


def write_json(rows: DataFrame, order: list[Column], path: str) -> None:
    """A JSON object for each row, in files whose names follow the order; unknown values are null, not left out."""
    rows.orderBy(*order).write.option("ignoreNullFields", False).json(path)


def document(kind: str, query: dict, rows: DataFrame, order: list[Column], most: int = 100_000) -> str:
    """One JSON object with the query and the rows in order. More rows than `most` are an error: `write_json` takes any number."""
    found = rows.orderBy(*order).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row")).limit(most + 1).collect()
    if len(found) > most:
        raise TooManyRows(f"{kind}: more than {most} rows")
    return json.dumps({"document": kind, "query": query, "rows": [json.loads(r["row"]) for r in found]}, indent=2, ensure_ascii=False)
