"""Registered queries: gate, timeline, attribution, rollup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import attribution, gate, refresh, rollup, timeline
from ..session import materialize, prepare, spread, work_dir
from ..sources.registry import names_of
from .activity import PROJECTS, RUN_TS, activity, table

ROOTS = ["/home/dev/code", "/home/u7/code/p3/", "C:\\Users\\dev\\code"]


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return gate.gate(activity(spark, sf_dir), ROOTS, passed_at=RUN_TS)


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.kept(gated(spark, sf_dir)).drop("diff_clean")


def attributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.attribute(timeline.reconcile(stored(spark, sf_dir)), PROJECTS)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.archive_lines(attributed(spark, sf_dir))


def time_per_project(spark, sf_dir):
    return rollup.time_per_project(attributed(spark, sf_dir), names_of(spark, PROJECTS)).select("name", "seconds")


def reconcile_timeline(spark, sf_dir):
    prepare(spark)
    return timeline.reconcile(activity(spark, sf_dir), ordered=True).select(
        "event_id", "arrival_seq", "trust", "date_key", F.col("effective_ts").cast("timestamp_ntz").alias("effective_ts"))


def dedup_winner(spark, sf_dir):
    prepare(spark)
    rows = timeline.dedup_winners(timeline.drop_rejected(activity(spark, sf_dir)))
    return rows.select("event_id", "arrival_seq", "trust", "recv_ts")


def equal_events_stay(spark, sf_dir):
    """Events without an id that look alike in every other way are still events of their own."""
    prepare(spark)
    rows = activity(spark, sf_dir).where("event_id = ''").drop("arrival_seq")
    doubled = rows.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_copy")
    return timeline.reconcile(doubled).groupBy("ts_wall", "type", F.col("source.identity").alias("host")).agg(F.count("*").alias("n"))


def lateness_by_host(spark, sf_dir):
    prepare(spark)
    return timeline.lateness_by(activity(spark, sf_dir), "host", F.col("source.identity")) \
        .select("host", "n_events", "n_late", "max_sec", F.round("mean_sec", 4).alias("mean_sec"))


def lateness_quantiles(spark, sf_dir):
    """Median and 95th percentile of the lateness per host, out of sketches per host and day; is their rank as stated?"""
    prepare(spark)
    host, rows = F.col("source.identity"), activity(spark, sf_dir)
    found = timeline.lateness_quantiles(timeline.lateness_sketches(rows, "host", host), "host")
    exact = timeline.lateness(rows).where("lateness_sec is not null").select(host.alias("host"), "lateness_sec").join(found, "host")

    def off(rank: float, value: str) -> Column:
        below, upto = F.avg((F.col("lateness_sec") < F.col(value)).cast("int")), F.avg((F.col("lateness_sec") <= F.col(value)).cast("int"))
        return (below <= rank + 2 * timeline.RANK_ERROR) & (upto >= rank - 2 * timeline.RANK_ERROR)
    return exact.groupBy("host").agg(F.max("n_events").alias("n_events"), off(0.5, "p50_sec").alias("p50_holds"), off(0.95, "p95_sec").alias("p95_holds"))


def attribution_methods(spark, sf_dir):
    return attribution.method_histogram(attributed(spark, sf_dir))


def attribution_events(spark, sf_dir):
    a = F.col("attribution")
    return attributed(spark, sf_dir).select("arrival_seq", "type", a["project_id"].alias("project_id"),
                                            F.round(a["confidence"], 4).alias("confidence"), a["method"].alias("method"))


def attribution_ties(spark, sf_dir):
    rows = attribution.with_match(timeline.reconcile(stored(spark, sf_dir)), PROJECTS)
    tied = rows.where(F.col("match.method") == "ambiguous_tie")
    return tied.groupBy(F.round("match.score", 4).alias("score"),
                        F.replace("match.reason", F.lit("tie between "), F.lit("")).alias("tied")) \
        .agg(F.count("*").alias("n_events"))


def gate_outcomes(spark, sf_dir):
    return gate.gate_counts(gated(spark, sf_dir))


def gated_events(spark, sf_dir):
    p = F.col("payload")
    return stored(spark, sf_dir).select(
        "arrival_seq", "event_id", "type", p["path"].alias("path"), p["repo"].alias("repo"), p["note"].alias("note"),
        p["host"].alias("host"), p["kind"].alias("clip_kind"), p["cmdline"].alias("cmdline"),
        F.array_join("privacy.redactions", ",").alias("codes"))


def archive_lines(spark, sf_dir):
    return rollup.numbered_lines(lines(spark, sf_dir)).select("project_id", "date_label", "section_no", "line_no", "text")


def archive_files(spark, sf_dir):
    return rollup.changed_files(attributed(spark, sf_dir)).select(
        "project_id", "date_key", "file", F.col("first.o_ts").alias("first_ts"), F.col("first.o_class").alias("o_class"))


def archive_document(spark, sf_dir):
    return rollup.document_lines(attributed(spark, sf_dir)).groupBy("project_id", "date_label", "section_no", "o_class", "text") \
        .agg(F.count("*").alias("n"))


def section_merge(spark, sf_dir):
    from pyspark.sql import Window
    dated = materialize(lines(spark, sf_dir), "archive-lines").where(F.col("date_key").rlike("^[0-9]{8}$"))
    old = dated.where("date_label <= '2024-01-20'").withColumn("batch", F.lit("old"))
    labels = old.select("project_id", "date_label").distinct().withColumn(
        "label_pos", F.row_number().over(Window.partitionBy("project_id").orderBy("date_label")))
    fresh = dated.where("date_label >= '2024-01-15'").withColumn("batch", F.lit("new"))
    merged = rollup.merge_sections(old.join(labels, ["project_id", "date_label"]), fresh)
    return merged.select("project_id", "date_label", "label_pos", "section_no", "batch", "text")


def _period(spark, sf_dir, granularity):
    return rollup.in_period(lines(spark, sf_dir), granularity).groupBy("project_id", "period_key", "section_no").agg(
        F.count("*").alias("n_lines"), F.sum(F.length("text")).cast("bigint").alias("n_chars"))


def period_rollup_week(spark, sf_dir):
    return _period(spark, sf_dir, "week")


def period_rollup_month(spark, sf_dir):
    return _period(spark, sf_dir, "month")


def period_fallback(spark, sf_dir):
    archive = materialize(lines(spark, sf_dir), "archive-lines")
    return rollup.period_lines(archive.where("section_no = 5"), archive, "week") \
        .groupBy("project_id", "period_key", "origin").agg(F.count("*").alias("n_lines"))


def affected_periods(spark, sf_dir):
    return rollup.affected_periods(attributed(spark, sf_dir), "week")


# What the activity view tells about an event.
_TOLD = ("event_id", "ts_wall", "recv_ts", "type", "trust", "source.identity", *(f"payload.{name}" for name in (
    "anchor", "process", "active_file", "mode", "intent.label", "cmdline", "path", "repo", "message", "actor", "note", "host", "kind", "summary", "tool")))


def project_fingerprint(spark, sf_dir):
    rows = attribution.in_projects(attributed(spark, sf_dir)).withColumn("project_id", F.col("attribution.project_id"))
    return rollup.fingerprint(rows, ["project_id"], rollup.event_text(*_TOLD))


def _days(rows):
    return attribution.in_projects(rows).select(F.col("attribution.project_id").alias("project_id"), "date_key", "type")


def incremental_days(spark, sf_dir):
    days = materialize(_days(attributed(spark, sf_dir)), "project-days")
    return rollup.new_days(days, days.where("type = 'GIT_COMMIT'"))


def done_days(spark, sf_dir):
    days = materialize(_days(attributed(spark, sf_dir)), "project-days")
    state = days.where("type = 'GIT_COMMIT'").groupBy("project_id").agg(F.collect_set("date_key").alias("synth_days"))
    return rollup.merge_done_days(state, days).select("project_id", F.array_join("synth_days", ",").alias("synth_days"))


def counts_grouping_sets(spark, sf_dir):
    return rollup.counts_by_facet(stored(spark, sf_dir))


def event_chunks(spark, sf_dir):
    return rollup.with_chunks(attributed(spark, sf_dir)).groupBy("project_id", "chunk_no").agg(
        F.count("*").alias("n_events"), F.max("event_no").alias("last_no"))


def refresh_runs(spark, sf_dir):
    """What four runs write: everything, nothing, the path of one changed event, and a project day that is gone.

    The prompts that a run asks for are listed with it.
    """
    from ..sources import registry
    from . import prompts
    root, known = work_dir(spark, "journal"), registry.from_dicts(spark, PROJECTS)
    rows = materialize(attributed(spark, sf_dir), "attributed")
    owned = attribution.in_projects(rows)
    one = owned.where("event_id <> ''").agg(F.min("event_id")).first()[0]
    gone = owned.where("attribution.project_id = 'cobalt'").agg(F.max("date_key")).first()[0]
    edited = rows.withColumn("payload", F.when(F.col("event_id") == one, F.col("payload").withField("summary", F.lit("said anew"))).otherwise(F.col("payload")))
    cut = edited.where(~((F.coalesce("attribution.project_id", F.lit("")) == "cobalt") & F.col("date_key").eqNullSafe(gone)))
    out = None
    for run, events in enumerate((rows, rows, edited, cut), 1):
        changed = materialize(refresh.refresh(events, root), "changed")
        asked = prompts.due_entry_prompts(events, changed, known).select(
            "project_id", F.lit("prompt").alias("level"), F.col("date_key").alias("key"), F.concat(F.lit("asks "), F.col("chunk_no").cast("string")).alias("action"))
        rows_of_run = changed.unionByName(asked).withColumn("run", F.lit(run))
        out = rows_of_run if out is None else out.unionByName(rows_of_run)
    return out


def week_bodies(spark, sf_dir):
    """Bodies of all weeks from the stored lines, with a heading and a gap for each project."""
    root = work_dir(spark, "journal")
    refresh.refresh(materialize(attributed(spark, sf_dir), "attributed"), root)
    body = refresh.period_body(refresh.read_periods(spark, root, "week"))
    return body.groupBy("period_key", "project_id", "part", F.coalesce("date_key", F.lit("")).alias("date_key"), "text").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    time_per_project, reconcile_timeline, dedup_winner, equal_events_stay, lateness_by_host, lateness_quantiles, attribution_methods, attribution_events,
    attribution_ties, gate_outcomes, gated_events, archive_lines, archive_files, archive_document, section_merge,
    period_rollup_week, period_rollup_month, period_fallback, affected_periods, project_fingerprint,
    incremental_days, done_days, counts_grouping_sets, event_chunks, refresh_runs, week_bodies)}


def attribution_by_joins(spark, sf_dir):
    """The same attribution through the rule joins that large registries use."""
    from ..operators.rulejoin import with_match_joined
    rows = with_match_joined(materialize(timeline.reconcile(stored(spark, sf_dir)), "timeline"), PROJECTS)
    return rows.where(F.col("match.method") != "unresolved").select(
        "arrival_seq", F.col("match.project_id").alias("project_id"), F.round("match.score", 4).alias("score"))


QUERIES["attribution_by_joins"] = attribution_by_joins


def rules_in_pages(spark, sf_dir):
    """A hundred rules a part and some a customer, looked up in every page: pages and first page per rule."""
    from ..operators import patterns
    prepare(spark)
    # a row becomes a hundred and more
    part = spread(table(spark, sf_dir, "part"), 10_000).select("p_name", F.explode(F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.col("p_partkey") * 100 + i)).alias("n"))
    rules = part.select(F.concat(F.when(F.col("n") % 3 == 0, "/").when(F.col("n") % 3 == 1, " ").otherwise(">"), F.col("n").cast("string")).alias("pattern"))
    customers = table(spark, sf_dir, "customer").select(F.explode(F.array(F.col("c_name"), F.concat(F.lit("id"), F.col("c_custkey").cast("string")))).alias("pattern"))
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text"))
    every = rules.unionByName(customers).unionByName(part.select(F.col("p_name").alias("pattern")))
    met = patterns.contains_join(pages, every, key="page_id")
    return met.groupBy("pattern").agg(F.count("*").alias("n_pages"), F.min("page_id").alias("first_page"))


def expressions_in_urls(spark, sf_dir):
    """Five title expressions a part, looked up in every page address."""
    from ..operators import patterns
    prepare(spark)
    k = F.col("p_partkey")
    forms = [F.concat(F.lit("/en/"), k.cast("string"), F.lit("(?:#top|/|$)")), F.concat(F.lit("ref=x.*"), k.cast("string"), F.lit("|page=2.{0,3}"), k.cast("string")),
             F.concat(F.lit("BLOG\\.[a-z]+(?:ou|an)\\.example.*/"), k.cast("string"), F.lit("\\b")), F.concat(F.lit("[a-z]{3}/"), k.cast("string"), F.lit("\\.html")),
             F.concat(F.lit("(?P<lang>fr|de)/0*"), k.cast("string"), F.lit("[?/]"))]
    rules = table(spark, sf_dir, "part").select(F.posexplode(F.array(*forms)).alias("i", "pattern"), k.cast("string").alias("p"))
    rules = rules.select(F.concat_ws("/", "p", F.col("i").cast("string")).alias("rule"), "pattern")
    urls = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("text"))
    return patterns.regex_join(urls, rules, key="page_id")


QUERIES |= {f.__name__: f for f in (rules_in_pages, expressions_in_urls)}
