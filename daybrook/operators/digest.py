"""One readable digest per event, for prompts and the timeline."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import IDLE_TYPES, SESSION_TYPES
from ..functions.core import blank_to_null, has_text, to_int
from ..functions.dates import hhmm
from ..model import PAYLOAD_FIELDS
from .rollup import satellite_titles


def payload_json() -> Column:
    """The payload as JSON without its null fields."""
    return F.to_json(F.struct(*[F.col(f"payload.{f}").alias(f) for f in PAYLOAD_FIELDS]))


def _line(prefix: str, value: Column, tail: str = "") -> Column:
    return F.concat(F.lit(prefix), blank_to_null(value), F.lit(tail))


def digest() -> Column:
    """Journal digest: one line, or a small block for sessions; empty for idle rows."""
    p, kind = F.col("payload"), F.col("type")
    at = F.concat(F.lit("["), hhmm("ts_wall"), F.lit("] "))
    what = F.coalesce(blank_to_null(p["anchor"]), blank_to_null(p["process"]))
    focus = F.concat(F.lit("  focus: "), what, F.coalesce(_line(" [", p["process"], "]"), F.lit("")))
    session = F.concat_ws(
        "\n",
        F.concat(at, kind, F.lit(" "), to_int(p["duration_sec"]).cast("string"), F.lit("s"),
                 F.coalesce(_line(" (", p["mode"], ")"), F.lit(""))),
        focus, _line("  file: ", p["active_file"]), _line('  intent: "', p["intent"]["label"], '"'),
        _line("  also: ", satellite_titles(5)),
        _line("  cmd: ", F.coalesce(blank_to_null(p["cmdline"]), p["command"])))
    mark = F.when(has_text(p["diff_ref"]), F.lit(" (+diff)")).otherwise(F.lit(""))

    def text(c: Column) -> Column:
        return F.coalesce(c, F.lit(""))

    n = F.size(p["files"])
    files = F.when(n > 0, F.concat(F.lit(" ("), n.cast("string"), F.when(n == 1, F.lit(" file)")).otherwise(F.lit(" files)"))))
    commit = F.concat(at, F.lit("commit"), text(_line(" by ", p["actor"])), F.lit(": "), text(p["message"]),
                      text(files), F.lit(" ["), text(p["repo"]), F.lit("]"), mark)
    change = F.concat(at, F.lit("file "), F.coalesce(p["action"], F.lit("changed")), F.lit(": "), text(p["path"]), mark)
    note = F.concat(at, F.lit('narration: "'), text(p["note"]), F.lit('"'))
    clip = F.rtrim(F.concat(at, F.lit("clipboard "), text(p["kind"]), F.lit(" "), text(p["host"])))
    said = F.coalesce(blank_to_null(p["summary"]), blank_to_null(p["note"]), F.substring(payload_json(), 1, 160))
    agent = F.concat(at, F.lit("agent report ("), text(F.col("source.identity")), F.lit("): "), said)
    return F.when(kind.isin(list(SESSION_TYPES)), session).when(kind == "FILE_CHANGE", change) \
        .when(kind == "GIT_COMMIT", commit).when(kind == "NARRATION", note).when(kind == "CLIPBOARD", clip) \
        .when(kind == "AGENT_REPORT", agent).when(kind.isin(list(IDLE_TYPES)), F.lit("")) \
        .otherwise(F.concat(at, kind, F.lit(": "), F.substring(payload_json(), 1, 160)))


def timeline_text() -> Column:
    """First digest line without its time; the type where there is none."""
    first = F.regexp_replace(F.substring_index(digest(), "\n", 1), r"^\[\d{1,2}:\d{2}\]\s*", "")
    return F.coalesce(blank_to_null(first), F.col("type"))


def review_digest(index: Column) -> Column:
    """Compact block of one event for the categorise prompt."""
    p, kind = F.col("payload"), F.col("type")

    def text(c: Column) -> Column:
        return F.coalesce(c, F.lit(""))

    session = F.concat_ws(
        "\n", F.concat(F.lit('  app="'), text(p["process"]), F.lit('" title="'), text(p["anchor"]), F.lit('"')),
        _line("  file=", p["active_file"]), F.when(F.size("payload.satellites") > 0, F.concat(F.lit("  also: "), satellite_titles(5))),
        _line('  intent="', p["intent"]["label"], '"'))
    body = F.when(kind.isin(list(SESSION_TYPES)), session) \
        .when(kind == "FILE_CHANGE", F.concat(F.lit("  path="), text(p["path"]))) \
        .when(kind == "GIT_COMMIT", F.concat(F.lit("  repo="), text(p["repo"]), F.lit(' msg="'), text(p["message"]), F.lit('"'))) \
        .when(kind == "NARRATION", F.concat(F.lit('  note="'), text(p["note"]), F.lit('"'))) \
        .when(kind == "CLIPBOARD", F.concat(F.lit("  clipboard kind="), text(p["kind"]), F.lit(" host="), text(p["host"]))) \
        .otherwise(F.concat(F.lit("  "), F.substring(payload_json(), 1, 120)))
    return F.concat(F.lit("["), index.cast("string"), F.lit("] "), kind, F.lit(" "), hhmm("ts_wall"), F.lit("\n"), body)
