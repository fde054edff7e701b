"""Which project an event belongs to, by explainable rules.

A registry given as a list travels inside the plan as one literal and every event is scored
where it lies: no shuffle, no row explosion.  A registry given as a table, of any size, goes
through ``operators.rulejoin``; the answers are the same.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    ASSIGN_THRESHOLD, IDLE_TYPES, KEYWORD_BASE, KEYWORD_CAP, KEYWORD_STEP, SIGNAL_SCORES, UNRELATED,
)
from ..functions.core import bind, blank_to_null, has_text, once, strings
from ..functions.paths import canonical

_HOME = [(re.compile(r"(?i)\b[A-Za-z]:[\\/]Users[\\/][^\\/]+"), "~"),
         (re.compile(r"(?i)/home/[^/]+|/Users/[^/]+"), "~")]
RULES = ("pid STRING, roots ARRAY<STRING>, remotes ARRAY<STRING>, tickets ARRAY<STRING>, "
         "domains ARRAY<STRING>, apps ARRAY<STRING>, keywords ARRAY<STRING>")


def active_projects(projects: list[dict]) -> list[dict]:
    return [p for p in projects if p.get("status", "active") == "active"]


def _root(path: str) -> str:
    """A registry path in the form gated event paths have, closed by a slash."""
    for pattern, tilde in _HOME:
        path = pattern.sub(tilde, path)
    return path.replace("\\", "/").lower().rstrip("/") + "/"


def rule_rows(projects: list[dict]) -> list[dict]:
    """Registry lists in comparable form, one row per project."""
    def low(p, field):
        return [str(v).lower() for v in (p.get("signals") or {}).get(field) or [] if v]

    rows = []
    for p in projects:
        sig = p.get("signals") or {}
        rows.append({
            "pid": p["id"],
            "roots": [r for r in (_root(v) for v in sig.get("paths") or []) if r != "/"],
            "remotes": low(p, "git_remotes"), "domains": low(p, "domains"),
            "tickets": [t for t in low(p, "jira_prefixes") if re.fullmatch(r"[a-z0-9_]+", t)],
            "apps": [str(a).lower() for a in sig.get("apps") or []],
            "keywords": [str(k).lower() for k in sig.get("keywords") or []],
        })
    return rows


def _java_regex(pattern: str) -> str | None:
    """A title pattern usable by Spark, or null; Python's group names are rewritten."""
    try:
        re.compile(pattern)
    except re.error:
        return None
    return re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern.replace("(?P<", "(?<"))


def title_patterns(projects: list[dict]) -> list[tuple[str, str, str]]:
    """``(kind, project, regex)`` for rules that only a regular expression can express."""
    out = []
    for p in projects:
        sig = p.get("signals") or {}
        for pat in sig.get("window_patterns") or []:
            java = _java_regex(pat) if pat else None
            if java:
                out.append(("pattern", p["id"], "(?i)" + java))
        for pre in sig.get("jira_prefixes") or []:
            if pre and not re.fullmatch(r"[A-Za-z0-9_]+", pre):
                out.append(("ticket", p["id"], r"(?i)\b" + re.escape(pre) + r"-\d+\b"))
    return out


def signals() -> Column:
    """Text signals of an event, whatever its type: ``struct<titles, procs, paths, note, blob>``."""
    p = F.col("payload")
    kind = F.col("type")

    def only(event_type: str, *values: Column) -> list[Column]:
        return [F.when(kind == event_type, blank_to_null(v)) for v in values]

    def items(event_types: list[str], array: Column) -> Column:
        return F.when(kind.isin(event_types), F.coalesce(array, strings([]))).otherwise(strings([]))

    satellites = F.coalesce(p["satellites"], F.array().cast("array<struct<title:string,process:string>>"))
    titles = F.concat(
        F.array(blank_to_null(p["anchor"]), blank_to_null(p["intent"]["label"])),
        F.transform(satellites, lambda s: s["title"]),
        F.array(*only("GIT_COMMIT", p["message"]), *only("NARRATION", p["note"]), *only("CLIPBOARD", p["host"]),
                *only("AGENT_REPORT", p["summary"], p["message"], p["project_hint"], p["tool"])))
    procs = F.concat(F.array(F.lower(p["process"])), F.transform(satellites, lambda s: F.lower(s["process"])))
    paths = F.concat(
        F.array(p["active_file"], *only("FILE_CHANGE", p["path"]),
                F.when(kind.isin("GIT_COMMIT", "AGENT_REPORT"), p["repo"])),
        items(["GIT_COMMIT", "AGENT_REPORT"], p["files"]),
        F.array(p["cmdline"], p["cwd"], p["command"]))

    def present(a: Column) -> Column:
        return F.filter(a, lambda v: v.isNotNull() & (v != ""))

    note = F.when(kind == "NARRATION", F.coalesce(p["note"], F.lit(""))).otherwise(F.lit(""))
    lists = F.struct(present(titles).alias("titles"), present(procs).alias("procs"),
                     present(paths).alias("paths"), note.alias("note"))
    return bind(lists, lambda v: F.struct(
        F.array_join(v["titles"], " ").alias("titles"), v["procs"].alias("procs"),
        F.transform(v["paths"], lambda x: F.concat(canonical(x), F.lit("/"))).alias("paths"),
        F.lower(v["note"]).alias("note"),
        F.lower(F.array_join(F.concat(v["titles"], v["procs"], v["paths"]), " ")).alias("blob")))


def _hit(name: str, test: Column) -> Column:
    return F.when(test, F.struct(F.lit(SIGNAL_SCORES[name]).alias("score"), F.lit(name).alias("method")))


def project_score(s: Column, p: Column) -> Column:
    """Strongest signal of one project: ``struct<score, method>``, null without any."""
    def inside(text: Column, values: Column) -> Column:
        return F.exists(values, lambda v: F.contains(text, v))

    hits = F.size(F.filter(p["keywords"], lambda k: F.contains(s["blob"], k)))
    keyword = F.when(hits > 0, F.struct(
        F.round(F.least(KEYWORD_BASE + KEYWORD_STEP * hits, F.lit(KEYWORD_CAP)), 4).alias("score"),
        F.lit("signal_keyword").alias("method")))
    return F.greatest(
        _hit("signal_path", F.exists(s["paths"], lambda e: F.exists(p["roots"], lambda r: F.startswith(e, r)))),
        _hit("signal_jira", F.arrays_overlap(s["ticket_keys"], p["tickets"])
             | F.array_contains(s["ticket_pids"], p["pid"])),
        _hit("signal_git", inside(s["blob"], p["remotes"])),
        _hit("signal_domain", inside(s["blob"], p["domains"])),
        _hit("signal_pattern", F.array_contains(s["pattern_pids"], p["pid"])),
        _hit("signal_note", (s["note"] != "") & inside(s["note"], p["keywords"])),
        _hit("signal_app", F.arrays_overlap(s["procs"], p["apps"])),
        keyword)


def _verdict(scored: Column) -> Column:
    """Best project out of ``array<struct<score, method, pid>>``; a tie names nobody."""
    def judge(v: Column) -> Column:
        top = F.array_max(F.transform(v, lambda x: x["score"]))

        def pick(t: Column) -> Column:
            best = F.filter(v, lambda x: x["score"] == t)
            tie = (F.size(best) > 1) & (t >= ASSIGN_THRESHOLD)
            ids = F.array_join(F.transform(best, lambda x: x["pid"]), ", ")
            return F.when(t.isNull(), F.struct(
                F.lit(None).cast("string").alias("project_id"), F.lit(0.0).alias("score"),
                F.lit("unresolved").alias("method"), F.lit("no signal matched").alias("reason"))) \
                .when(tie, F.struct(
                    F.lit(None).cast("string").alias("project_id"), t.alias("score"),
                    F.lit("ambiguous_tie").alias("method"),
                    F.concat(F.lit("tie between "), ids).alias("reason"))) \
                .otherwise(F.struct(
                    best[0]["pid"].alias("project_id"), t.alias("score"), best[0]["method"].alias("method"),
                    F.concat(best[0]["method"], F.lit(" of "), best[0]["pid"]).alias("reason")))
        return bind(top, pick)
    return bind(scored, judge)


def match(projects: list[dict]) -> Column:
    """``struct<project_id, score, method, reason>`` of the current event row."""
    live = active_projects(projects)
    rules = F.from_json(F.lit(json.dumps(rule_rows(live))), f"ARRAY<STRUCT<{_ddl(RULES)}>>")
    regexes = title_patterns(live)

    def ids(kind: str, titles: Column) -> Column:
        tests = [F.when(titles.rlike(rx), F.lit(pid)) for k, pid, rx in regexes if k == kind]
        return F.filter(F.array(*tests), lambda v: v.isNotNull()) if tests else strings([])

    def with_tickets(s: Column) -> Column:
        keys = F.transform(F.regexp_extract_all(
            s["titles"], F.lit(r"\b([A-Za-z0-9_]+)(?=-\d+\b)"), F.lit(1)), lambda t: F.lower(t))
        return F.struct(
            s["procs"].alias("procs"), s["paths"].alias("paths"), s["note"].alias("note"), s["blob"].alias("blob"),
            keys.alias("ticket_keys"), ids("ticket", s["titles"]).alias("ticket_pids"),
            ids("pattern", s["titles"]).alias("pattern_pids"))

    def score(s: Column) -> Column:
        all_scores = F.transform(rules, lambda p: bind(project_score(s, p), lambda h: F.when(
            h.isNotNull(), F.struct(h["score"].alias("score"), h["method"].alias("method"), p["pid"].alias("pid")))))
        return _verdict(F.filter(all_scores, lambda x: x.isNotNull()))

    return bind(bind(signals(), with_tickets), score)


def _ddl(fields: str) -> str:
    return ", ".join(f.strip().replace(" ", ": ", 1) for f in fields.split(", "))


def has_signal_text() -> Column:
    return bind(signals(), lambda s: F.trim(F.concat(s["blob"], s["note"])) != "")


def with_match(events: DataFrame, projects: list[dict]) -> DataFrame:
    return once(events, match=match(projects))


def attribute(events: DataFrame, projects: list[dict] | DataFrame) -> DataFrame:
    """Fill ``attribution``; what no rule settles is marked for review, nothing is dropped.

    ``projects`` is a list of projects, or the registry table.
    """
    if isinstance(projects, DataFrame):
        from .rulejoin import with_match_joined
        scored = with_match_joined(events, projects)
    else:
        scored = with_match(events, projects)
    m = F.col("match")
    assigned = (m["score"] >= ASSIGN_THRESHOLD) & m["project_id"].isNotNull()
    decided = F.when(F.col("type").isin(list(IDLE_TYPES)), F.col("attribution")) \
        .when(assigned, F.struct(m["project_id"].alias("project_id"),
                                 F.round(m["score"], 4).alias("confidence"), m["method"].alias("method"))) \
        .otherwise(F.struct(F.lit(None).cast("string").alias("project_id"),
                            F.lit(0.0).alias("confidence"), F.lit("needs_review").alias("method")))
    return scored.withColumn("attribution", decided).drop("match")


def residue(attributed: DataFrame) -> DataFrame:
    """Events a reviewer or a model has to look at: unresolved and with something to read."""
    waiting = attributed.where(F.col("attribution.method") == "needs_review")
    return once(waiting, _text=has_signal_text()).where("_text").drop("_text")


def settled(attributed: DataFrame) -> DataFrame:
    """Events that are not in the review queue."""
    waiting = F.coalesce(F.col("attribution.method") == "needs_review", F.lit(False))
    return once(attributed, _text=waiting & has_signal_text()).where(~F.coalesce("_text", F.lit(False))).drop("_text")


def answered(given: Column, project_id: Column, confidence: Column, project_ids: list[str]) -> Column:
    """Attribution after an outside answer: a known project and enough confidence, else the event goes on waiting."""
    ok = project_id.isin(project_ids) & (confidence >= ASSIGN_THRESHOLD)
    return F.when(~given, F.col("attribution")).otherwise(F.struct(
        F.when(ok, project_id).alias("project_id"), F.round(confidence, 4).alias("confidence"),
        F.when(ok, F.lit("llm")).otherwise(F.lit("needs_review")).alias("method")))


def in_projects(attributed: DataFrame) -> DataFrame:
    """Rows that belong to a real project."""
    pid = F.col("attribution.project_id")
    return attributed.where(pid.isNotNull() & (pid != UNRELATED))


def apply_assignments(attributed: DataFrame, responses: DataFrame, project_ids: list[str]) -> DataFrame:
    """Accept outside answers ``(event_id, project_id, confidence)`` for the review queue."""
    answer = responses.select(
        F.col("event_id").alias("_id"), F.col("project_id").alias("_pid"),
        F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.0)).alias("_conf"))
    answer = answer.groupBy("_id").agg(F.max_by("_pid", "_conf").alias("_pid"), F.max("_conf").alias("_conf"))
    waiting = F.col("attribution.method") == "needs_review"
    joined = attributed.join(answer, (F.col("event_id") == F.col("_id")) & waiting, "left")
    value = answered(F.col("_id").isNotNull(), F.col("_pid"), F.col("_conf"), project_ids)
    return joined.withColumn("attribution", value).drop("_id", "_pid", "_conf")


def method_histogram(attributed: DataFrame) -> DataFrame:
    method = F.coalesce(F.col("attribution.method"), F.lit("unattributed"))
    return attributed.groupBy(method.alias("method")).agg(F.count("*").alias("n_events"))


__all__ = ["attribute", "match", "with_match", "residue", "in_projects", "apply_assignments",
           "method_histogram", "active_projects", "has_text"]
