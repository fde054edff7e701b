"""Editor and agent hook logs: raw hook JSON lines to report rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import blank_to_null, strings
from ..functions.paths import basename

HOOK = T.StructType([T.StructField(n, T.StringType()) for n in (
    "hook_event_name", "cwd", "session_id", "tool_name", "conversation_id", "file_path", "status")] + [
    T.StructField("tool_input", T.StructType([T.StructField("file_path", T.StringType()), T.StructField("path", T.StringType())])),
    T.StructField("workspace_roots", T.ArrayType(T.StringType()))])


def hook_reports(lines: DataFrame, *, flavour: str, ts_wall: Column, value: str = "value") -> DataFrame:
    """Hook lines to ``summary, tool, identity, session_id, repo, files, project, status, ts_wall``.

    ``flavour`` is ``claude_code`` (tool use / stop) or ``cursor`` (file edit / stop).
    """
    h = F.from_json(value, HOOK)
    named = lines.select("*", h.alias("h"))
    event = F.coalesce("h.hook_event_name", F.lit(""))
    if flavour == "claude_code":
        where, session, label = F.coalesce("h.cwd", F.lit("")), F.col("h.session_id"), "Claude Code"
        path = F.coalesce(blank_to_null("h.tool_input.file_path"), blank_to_null("h.tool_input.path"))
        tool = F.coalesce("h.tool_name", F.lit("tool"))
        used, stopped = event == "PostToolUse", event == "Stop"
        edit = F.when(path.isNotNull(), F.concat(F.lit("Claude Code "), tool, F.lit(": "), basename(path))) \
            .otherwise(F.concat(F.lit("Claude Code used "), tool))
        tail, status, identity, name = F.lit(""), F.lit(None).cast("string"), "agent:claude-code", "claude-code"
    elif flavour == "cursor":
        where, session, label = F.coalesce(F.get("h.workspace_roots", F.lit(0)), F.lit("")), F.col("h.conversation_id"), "Cursor"
        path = blank_to_null("h.file_path")
        used, stopped = event == "afterFileEdit", event == "stop"
        edit = F.when(path.isNotNull(), F.concat(F.lit("Cursor edited: "), basename(path))).otherwise(F.lit("Cursor edited a file"))
        status = F.when(stopped, F.coalesce("h.status", F.lit("")))
        tail = F.when(F.coalesce(status, F.lit("")) != "", F.concat(F.lit(" ("), status, F.lit(")"))).otherwise(F.lit(""))
        identity, name = "agent:cursor", "cursor"
    else:
        raise ValueError(f"unknown hook flavour {flavour!r}")
    place = F.when(where != "", basename(where)).otherwise(F.lit("a session"))
    done = F.concat(F.lit(f"{label} finished a session in "), place, tail)
    other = F.concat(F.lit(f"{label} event: "), F.coalesce(blank_to_null(event), F.lit("unknown")))
    others = [c for c in lines.columns if c != value]
    return named.select(
        *others, F.when(used, edit).when(stopped, done).otherwise(other).alias("summary"), F.lit(name).alias("tool"),
        F.lit(identity).alias("identity"), F.coalesce(session, F.lit("")).alias("session_id"), where.alias("repo"),
        F.when(used & path.isNotNull(), F.array(path)).otherwise(strings([])).alias("files"),
        F.when(where != "", basename(where)).alias("project"), status.alias("status"), ts_wall.alias("ts_wall"))
