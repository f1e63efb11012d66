"""Records of logs by what they are for, and which of their fields hold content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.operators.nested import Content, stripped
from tokenloom.sources.dialects import MESSAGES, ROLLOUTS

CLASSES = ("usage", "structure", "conversation", "display")
# Fields of content in each dialect, fields that never are, and what the records of rollouts are for.
_NEVER = ("usage", "info", "rate_limits", "message_usage", "iterations", "payload")
CONTENT = {
    MESSAGES: Content(
        ("content", "text", "thinking", "signature", "input", "wireToolInputs", "attachment", "snapshot", "trackedFileBackups", "originalFile", "oldString", "newString", "stdout", "stderr", "prompt", "lastPrompt", "summary", "data",
         "normalizedMessages", "structuredPatch", "result", "output", "query", "results", "questions", "answers", "todos", "oldTodos", "newTodos", "filenames", "matches", "plan"), _NEVER,
    ),
    ROLLOUTS: Content(
        ("content", "text", "summary", "encrypted_content", "arguments", "input", "output", "message", "replacement_history", "base_instructions", "instructions", "user_instructions", "developer_instructions", "last_agent_message", "patch",
         "stdout", "stderr", "aggregated_output", "formatted_output", "changes", "unified_diff", "action", "results", "query"), _NEVER,
    ),
}
_STRUCTURE_EVENTS = (
    "task_started", "task_complete", "turn_aborted", "thread_settings_applied", "context_compacted", "thread_rolled_back", "sub_agent_activity", "entered_review_mode", "exited_review_mode", "error", "stream_error",
)
_STRUCTURE = ("session_meta", "turn_context", "compacted", "inter_agent_communication_metadata")
_SAID = ("message", "reasoning", "agent_message")


def class_of(dialect: str, line: Column) -> Column:
    """What a record is for, one of CLASSES: usage, the structure of threads, the conversation, or display alone."""
    at = lambda path: F.coalesce(F.get_json_object(line, f"$.{path}"), F.lit(""))
    kind = at("type")
    if dialect == MESSAGES:
        used = at("message.usage").startswith("{") | (at("quotaLimits") != "")
        answer = F.when(used, "usage").otherwise("structure")
        return F.when(kind == "assistant", answer).when(kind.isin("user", "system", "summary"), "structure").when(kind == "attachment", "conversation").otherwise("display")
    inner = at("payload.type")
    usage = (kind == "token_usage_record") | ((kind == "event_msg") & (inner == "token_count"))
    structure = kind.isin(*_STRUCTURE) | ((kind == "event_msg") & inner.isin(*_STRUCTURE_EVENTS))
    item = F.when(inner.isin(*_SAID), "conversation").otherwise("structure")
    return F.when(usage, "usage").when(structure, "structure").when(kind == "response_item", item).otherwise("display")


def captured(lines: DataFrame, dialect: str, classes: tuple[str, ...] = ("usage", "structure")) -> DataFrame:
    """(locator, offset, class, stripped, stubs, stubbed_bytes): records of the named classes without their content, from the rows of `read_lines`."""
    rows = lines.filter("state = 'record'").withColumn("class", class_of(dialect, F.col("line"))).filter(F.col("class").isin(*classes))
    return stripped(rows.select("locator", "offset", "class", "line"), ["locator", "offset", "class"], "line", CONTENT[dialect])


def volumes(lines: DataFrame, dialect: str) -> DataFrame:
    """(class, records, bytes): how much of the logs each class of records is."""
    rows = lines.filter("state = 'record'").select(class_of(dialect, F.col("line")).alias("class"), F.col("length").alias("size"))
    return rows.groupBy("class").agg(F.count("*").alias("records"), F.sum("size").alias("bytes"))
