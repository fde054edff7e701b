"""Standup and period reports, timeline table, project cards and outbound payload rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import blank_to_null, bind, splitlines
from ..functions.dates import duration_text, hhmm
from ..functions.text import body_without_title, chat_markup, excerpt
from ..operators import numbering
from ..operators.digest import timeline_text
from ..operators.timeline import timeline_order
from ..session import materialize

WEEK_SECTIONS = 7


def sections(daily: DataFrame) -> DataFrame:
    """Daily rows with ``section_no``: the newest run is 1.  One row per run in the window."""
    runs = daily.select("run_date", "run_seq").distinct()
    placed = numbering.numbered(runs, [F.desc("run_seq"), F.desc("run_date")], "section_no")
    return daily.join(placed.withColumn("section_no", F.col("section_no").cast("int")), ["run_date", "run_seq"])


def select_sections(numbered: DataFrame, *, date: str | None = None, rollup: bool = False) -> DataFrame:
    """One date, or the newest section, or the newest seven (sections, not days)."""
    if date:
        return numbered.where(F.col("run_date") == date)
    return numbered.where(F.col("section_no") <= (WEEK_SECTIONS if rollup else 1))


def standup_lines(numbered: DataFrame, *, date: str | None = None, rollup: bool = False) -> DataFrame:
    """Report lines ``section_no, pos, text`` of the chosen sections."""
    chosen = select_sections(numbered, date=date, rollup=rollup)
    body = chosen.select("section_no", F.lit(1).alias("pos"), "project_id", F.concat(
        F.lit("- **"), "project_id", F.lit("** — "), "paragraph").alias("text"))
    if rollup:
        heads = chosen.select("section_no", "run_date").distinct().select(
            "section_no", F.lit(0).alias("pos"), F.lit("").alias("project_id"), F.concat(F.lit("### "), "run_date").alias("text"))
        body = body.unionByName(heads)
    return body


def standup_title(chosen: DataFrame, rollup: bool) -> DataFrame:
    """One row: the report's title."""
    span = chosen.agg(F.max_by("run_date", "section_no").alias("oldest"), F.min_by("run_date", "section_no").alias("newest"))
    dated = F.concat(F.lit("## Work summary — "), "oldest", F.lit(" → "), "newest") if rollup \
        else F.concat(F.lit("## Daily standup — "), "newest")
    return span.select(F.coalesce(dated, F.lit("## Work summary")).alias("title"))


def standup_document(lines: DataFrame, title: DataFrame, exec_body: str = "") -> DataFrame:
    """The whole report as one text: a handful of sections of one paragraph per project."""
    head = title.select(F.lit(-1).alias("section_no"), F.lit(0).alias("pos"), F.lit("").alias("project_id"), F.col("title").alias("text"))
    rows = lines.select("section_no", "pos", "project_id", "text").unionByName(head)
    row = F.struct("pos", "project_id", "text")
    gathered = rows.groupBy("section_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["text"]), "\n").alias("t"))
    parts = gathered.agg(F.array_sort(F.collect_list(F.struct("section_no", "t"))).alias("p"))
    texts = F.transform("p", lambda r: r["t"])
    none = F.lit("_No journal entries found for the requested period._")
    tail = F.lit(f"\n\n### Executive summary\n{exec_body}" if exec_body else "")
    body = F.when(F.size(texts) == 1, none).otherwise(F.concat(F.array_join(F.slice(texts, 2, F.size(texts)), "\n\n"), tail))
    return parts.select(F.concat(texts[0], F.lit("\n\n"), body, F.lit("\n")).alias("markdown"))


def newest_summary(summaries: DataFrame, granularity: str) -> DataFrame:
    """Newest week or month summary: ``period_key, body`` without the title line."""
    week = F.col("period_key").contains("-W")
    mine = summaries.where(week if granularity == "week" else ~week)
    return mine.agg(F.max("period_key").alias("period_key"), F.max_by("body", "period_key").alias("_b")).where(
        F.col("period_key").isNotNull()).select("period_key", body_without_title("_b").alias("body"))


def newest_first(summaries: DataFrame) -> DataFrame:
    return summaries.select("period_key").distinct().orderBy(F.desc("period_key"))


def chat_payloads(documents: DataFrame, text: str = "markdown") -> DataFrame:
    """``{"text": …}`` rows for a chat webhook; sending is not part of the engine."""
    return documents.withColumn("payload", F.to_json(F.struct(chat_markup(text).alias("text"))))


_TARGET = r"^([^/\s]+/[^#\s]+)#(\d+)$"


def comment_payloads(documents: DataFrame, target: str = "target", text: str = "markdown") -> DataFrame:
    """Issue-comment rows: repository, number and body; malformed targets are flagged."""
    t = F.trim(target)
    return documents.select("*", blank_to_null(F.regexp_extract(t, _TARGET, 1)).alias("repository"),
                            blank_to_null(F.regexp_extract(t, _TARGET, 2)).alias("number"), t.rlike(_TARGET).alias("target_ok"),
                            F.to_json(F.struct(F.col(text).alias("body"))).alias("payload"))


def timeline_table(reconciled: DataFrame) -> DataFrame:
    """``clock, type, text`` rows in timeline order."""
    return reconciled.orderBy(*timeline_order()).select(hhmm("ts_wall").alias("clock"), "type", timeline_text().alias("text"))


def with_bars(times: DataFrame, width: int = 360) -> DataFrame:
    """Share of the busiest project; the input has one row per project."""
    times = materialize(times, "times")
    top = times.agg(F.max("seconds")).first()[0] or 1
    share = F.col("seconds") / F.lit(max(top, 1))
    return times.select("name", "seconds", duration_text("seconds").alias("label"),
                                  F.greatest(F.lit(2), F.bround(share * width).cast("int")).alias("bar"))


def _title_of(md: Column) -> Column:
    return bind(F.filter(splitlines(md), lambda s: s.startswith("# ")), lambda t: F.when(
        F.size(t) > 0, F.trim(F.substr(t[0], F.lit(3)))))


def project_cards(overviews: DataFrame, registry: DataFrame) -> DataFrame:
    """``project_id, name, excerpt``; the name falls back to the document title, then the id."""
    names = registry.select(F.col("id").alias("project_id"), F.col("name").alias("_n"))
    return overviews.join(names, "project_id", "left").select(
        "project_id", F.coalesce(blank_to_null("_n"), blank_to_null(_title_of(F.col("overview"))), "project_id").alias("name"),
        excerpt("overview").alias("excerpt"))
