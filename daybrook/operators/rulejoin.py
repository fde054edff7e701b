"""Attribution against a registry of any size: rules are a table from end to end.

Folders above a path, ticket prefixes and processes meet the rules by equi-joins; names, domains and
keywords are found in the text by automata over the rule table, title patterns by the texts that
they require (``operators.patterns``).  The answers equal ``attribution.match``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import ASSIGN_THRESHOLD, KEYWORD_BASE, KEYWORD_CAP, KEYWORD_STEP, SIGNAL_SCORES
from ..functions.core import once
from ..functions.paths import ancestors
from ..session import materialize
from . import patterns
from .attribution import signals

TEXT_KINDS = {"git_remotes": "signal_git", "domains": "signal_domain", "keywords": "signal_keyword"}
_PLAIN = "^[a-z0-9_]+$"


def _registry_rows(spark, projects: DataFrame | list[dict]) -> DataFrame:
    """``pid, field, value`` of the active projects' signals."""
    from ..sources import registry
    rows = registry.from_dicts(spark, projects) if isinstance(projects, list) else projects
    live = rows.where(F.coalesce("status", F.lit("active")) == "active")
    return registry.signal_rows(live).where("value is not null").select(F.col("project_id").alias("pid"), F.col("kind").alias("field"), "value")


def rule_table(rows: DataFrame) -> DataFrame:
    """``pid, kind, value, entries`` of the rules that are plain text; equal list entries are counted."""
    field, low = F.col("field"), F.lower("value")
    tilde = F.regexp_replace(F.regexp_replace("value", r"(?i)\b[A-Za-z]:[\\/]Users[\\/][^\\/]+", "~"), "(?i)/home/[^/]+|/Users/[^/]+", "~")
    root = F.regexp_replace(F.lower(F.translate(tilde, "\\", "/")), "/+$", "")
    kind = F.when((field == "paths") & (root != ""), "signal_path").when((field == "jira_prefixes") & low.rlike(_PLAIN), "signal_jira").when(field == "apps", "signal_app") \
        .when((field == "git_remotes") & (low != ""), "signal_git").when((field == "domains") & (low != ""), "signal_domain").when(field == "keywords", "signal_keyword")
    value = F.when(field == "paths", root).otherwise(low)
    return rows.select("pid", kind.alias("kind"), value.alias("value")).where("kind is not null").groupBy("pid", "kind", "value").agg(F.count("*").alias("entries"))


def regex_rules(rows: DataFrame) -> DataFrame:
    """``rule, pattern`` of the rules that only an expression can say; a rule is ``kind/project``."""
    quoted = F.regexp_replace("value", r"([\\.^$|?*+(){}\[\]\-])", r"\\$1")
    ticket = (F.col("field") == "jira_prefixes") & (F.col("value") != "") & ~F.col("value").rlike("^[A-Za-z0-9_]+$")
    pattern = F.when(F.col("field") == "window_patterns", F.col("value")).when(ticket, F.concat(F.lit(r"\b"), quoted, F.lit(r"-\d+\b")))
    kind = F.when(F.col("field") == "window_patterns", "signal_pattern").otherwise("signal_jira")
    return rows.select(F.concat_ws("/", kind, F.col("pid")).alias("rule"), pattern.alias("pattern")).where("pattern <> ''").distinct()


def _keys(s: Column) -> Column:
    """The lookup keys of a signal record: folders, ticket prefixes and processes."""
    def tagged(tag: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(tag).alias("kind"), v.alias("value")))
    folders = F.flatten(F.transform(s["paths"], lambda p: ancestors(F.regexp_replace(p, "/+$", ""))))
    tickets = F.transform(F.regexp_extract_all(s["titles"], F.lit(r"\b([A-Za-z0-9_]+)(?=-\d+\b)"), F.lit(1)), lambda t: F.lower(t))
    return F.array_distinct(F.concat(tagged("signal_path", folders), tagged("signal_jira", tickets), tagged("signal_app", s["procs"])))


def with_match_joined(events: DataFrame, projects: DataFrame | list[dict]) -> DataFrame:
    """Add ``match`` as ``attribution.with_match`` does; ``projects`` is the registry table, or a list.

    The verdict depends on the signals alone, so equal signals are scored once and the
    verdict is joined back by their hash.
    """
    rows = materialize(_registry_rows(events.sparkSession, projects), "signals")
    rules = materialize(rule_table(rows), "rules")
    marked = once(events, _s=signals())
    marked = materialize(once(marked, _h=F.sha2(F.to_json("_s"), 256)), "marked")
    distinct = materialize(marked.groupBy("_h").agg(F.first("_s").alias("_s")), "distinct-signals")
    looked = distinct.select("_h", F.explode(_keys(F.col("_s"))).alias("k")).select("_h", "k.kind", "k.value")
    met = looked.join(rules, ["kind", "value"]).select("_h", "pid", "kind", "value", "entries")
    texts = rules.where(F.col("kind").isin(list(TEXT_KINDS.values())))
    inside = patterns.contains_join(distinct.select("_h", F.col("_s.blob").alias("text")), texts.select(F.col("value").alias("pattern")), key="_h")
    inside = inside.join(texts, inside["pattern"] == texts["value"]).select("_h", "pid", "kind", "value", "entries")
    # what a note says is part of the text, so notes are looked up among its finds
    notes = distinct.where("_s.note <> ''").select("_h", F.col("_s.note").alias("note"))
    noted = inside.where("kind = 'signal_keyword'").join(notes.hint("merge"), "_h").where(F.contains("note", F.col("value"))).select("_h", "pid", F.lit("signal_note").alias("kind"), "value", "entries")
    found = patterns.regex_join(distinct.select("_h", F.col("_s.titles").alias("text")), regex_rules(rows), key="_h")
    named = found.select("_h", F.regexp_replace("rule", "^[^/]*/", "").alias("pid"), F.substring_index("rule", "/", 1).alias("kind"), F.lit("").alias("value"), F.lit(1).cast("bigint").alias("entries"))
    hits = met.unionByName(inside).unionByName(noted).unionByName(named)
    kind = F.col("kind")
    flat = F.lit(0.0)
    for name, value_ in SIGNAL_SCORES.items():
        flat = F.when(kind == name, F.lit(value_)).otherwise(flat)
    words = F.sum(F.when(kind == "signal_keyword", F.col("entries")).otherwise(0))
    per = hits.groupBy("_h", "pid").agg(F.max(F.struct(flat.alias("score"), kind.alias("method"))).alias("flat"), words.alias("words"))
    keyword = F.when(F.col("words") > 0, F.struct(
        F.round(F.least(KEYWORD_BASE + KEYWORD_STEP * F.col("words"), F.lit(KEYWORD_CAP)), 4).alias("score"),
        F.lit("signal_keyword").alias("method")))
    best = per.select("_h", "pid", F.greatest("flat", keyword).alias("b")).select("_h", "pid", "b.score", "b.method")
    level = best.groupBy("_h", "score").agg(
        F.count("*").alias("n"), F.min("pid").alias("pid"), F.min_by("method", "pid").alias("method"),
        F.array_join(F.array_sort(F.collect_list("pid")), ", ").alias("ids"))
    top = level.groupBy("_h").agg(F.max_by(F.struct("n", "pid", "method", "ids", "score"), "score").alias("t"))
    tie = (F.col("t.n") > 1) & (F.col("t.score") >= ASSIGN_THRESHOLD)
    none = F.lit(None).cast("string")
    verdict = F.when(F.col("t").isNull(), F.struct(
        none.alias("project_id"), F.lit(0.0).alias("score"), F.lit("unresolved").alias("method"), F.lit("no signal matched").alias("reason"))) \
        .when(tie, F.struct(none.alias("project_id"), F.col("t.score").alias("score"), F.lit("ambiguous_tie").alias("method"),
                            F.concat(F.lit("tie between "), "t.ids").alias("reason"))) \
        .otherwise(F.struct(F.col("t.pid").alias("project_id"), F.col("t.score").alias("score"), F.col("t.method").alias("method"),
                            F.concat("t.method", F.lit(" of "), "t.pid").alias("reason")))
    # both sides grow with the events; packed files look smaller than the rows that a broadcast would hold on the driver
    return marked.join(top.hint("merge"), "_h", "left").withColumn("match", verdict).drop("_h", "_s", "t")
