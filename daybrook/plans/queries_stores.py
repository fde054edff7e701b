"""Registered queries of logs, stores, journal documents and schedules: what is written is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rollup
from ..session import materialize, prepare, work_dir
from ..sinks import store
from ..sources import journal, log
from ..streaming import jobs
from . import prompts
from .activity import RUN_TS, activity, table
from .queries_core import ROOTS, gated, stored
from .queries_sessions import stream_rows
from .queries_streams import arrivals


def row_log(spark, sf_dir):
    """A log of lines with broken and blank ones; unknown payload keys are kept."""
    path = work_dir(prepare(spark), "log")
    rows = stream_rows(spark, sf_dir)
    e, k = F.col("event_id").cast("string"), F.col("k")
    line = F.concat(F.lit('{"event_id": "e'), e, F.lit('", "type": "NARRATION", "ts_wall": "2024-01-01", "payload": {"note": "n'), k.cast("string"), F.lit('", "mood": "'), "event_type", F.lit('"}}'))
    rows.select(F.when(k % 13 == 0, F.concat(F.lit("{oops "), e)).when(k % 17 == 0, F.lit("  ")).otherwise(line).alias("value")).write.text(path)
    good, bad = log.split_corrupt(log.read_log(spark, path))
    told = good.select("event_id", F.col("payload.note").alias("note"), F.col("extras")["mood"].alias("mood"))
    return told.unionByName(bad.select(F.substring("_corrupt", 7, 20).alias("event_id"), F.lit("corrupt").alias("note"), F.lit("").alias("mood")))


def stored_log(spark, sf_dir):
    """Two batches of gated events, one of them stored twice; rows by day, and the drops beside them."""
    root = work_dir(prepare(spark), "store")
    rows = materialize(gated(spark, sf_dir), "gated")
    for batch in (0, 1, 1):
        store.append_events(rows.where(F.col("arrival_seq") % 2 == batch), root, f"b{batch}")
    kept = store.read_events(spark, root).groupBy(F.col("date_key").cast("string").alias("name")).agg(F.count("*").alias("n"))
    return kept.unionByName(spark.read.parquet(f"{root}/drops").select(F.lit("(dropped)").alias("name")).groupBy("name").agg(F.count("*").alias("n")))


def stream_gate(spark, sf_dir):
    """The gate over a stream of files: stored events by type, and the metrics of all batches together."""
    src, root = work_dir(prepare(spark), "raw"), work_dir(spark, "gate-store")
    rows = activity(spark, sf_dir)
    # a file for each split, and a batch of files for all cores
    files = max(4, rows.rdd.getNumPartitions())
    rows.repartition(files).write.parquet(src)
    at_once = min(files // 2, 2 * spark.sparkContext.defaultParallelism)
    feed = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", at_once).parquet(src)
    jobs.run(jobs.gate_stream(feed, ROOTS, root, work_dir(spark, "gate-state"), passed_at=RUN_TS), once=True).awaitTermination()
    sums = jobs.metric_rows(spark, root).agg(*(F.sum(c).alias(c) for c in ("rows", "dropped")))
    facts = sums.select(F.explode(F.array(F.struct(F.lit("(rows)").alias("type"), F.col("rows").alias("n")), F.struct(F.lit("(dropped)").alias("type"), F.col("dropped").alias("n")))).alias("f"))
    return store.read_events(spark, root).groupBy("type").agg(F.count("*").alias("n")).unionByName(facts.select("f.type", "f.n"))


def stream_churn(spark, sf_dir):
    """Changes of a path kept by spacing, from a feed in two arrivals; the rows of ``churn_coalesce``."""
    rows = stream_rows(spark, sf_dir).select(F.concat(F.lit("p"), (F.col("user_id") % 40).cast("string")).alias("path"), "ts", F.unix_micros("ts").alias("us"), F.col("event_id").alias("arrival_seq"))
    kept = jobs.collect_table(jobs.coalesce_stream(arrivals(rows, "changes").where("path is not null"), 5 * 3600.0), "churn-stream")
    return kept.select("path", F.col("arrival_seq").alias("event_id"), F.timestamp_micros("us").cast("timestamp_ntz").alias("ts"))


def daily_runs(spark, sf_dir):
    """Daily paragraphs of two runs over common dates: each date's newest run, and the newest state."""
    root = work_dir(prepare(spark), "daily")
    o = table(spark, sf_dir, "orders")
    day = o.groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("run_date"), F.col("o_orderpriority").alias("project_id")).agg(F.count("*").alias("n"))
    day = materialize(day, "days")
    for run, rows in ((1, day.where("run_date < '1996-01-01'")), (2, day.where("run_date >= '1995-01-01'"))):
        told = rows.select("run_date", "project_id", F.concat(F.lit(f"run {run}: "), F.col("n").cast("string")).alias("paragraph"))
        store.append_daily(told, f"{root}/rows", run)
        store.save_state(told.groupBy("project_id").agg(F.max("run_date").alias("last_date")), f"{root}/state", run)
    newest = store.latest_daily(spark.read.parquet(f"{root}/rows")).select("run_date", "project_id", "paragraph")
    return newest.unionByName(store.load_state(spark, f"{root}/state").select(F.lit("state").alias("run_date"), "project_id", F.col("last_date").alias("paragraph")))


def _documents(spark, sf_dir, line):
    """One text a customer, out of a line for each order, in order of their keys."""
    o = table(prepare(spark), sf_dir, "orders")
    said = F.struct("o_orderkey", line.alias("t"))
    return o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(said)).alias("l")).select("o_custkey", F.array_join(F.transform("l", lambda x: x["t"]), "").alias("text"))


def _day():
    return F.date_format("o_orderdate", "yyyy-MM-dd")


def dated_sections(spark, sf_dir):
    """Framed journals cut at their dated headings."""
    docs = _documents(spark, sf_dir, F.concat(F.lit("---\n## "), _day(), F.lit("\n\nabout "), F.col("o_orderkey").cast("string"), F.lit("\n\n---\n")))
    cut = docs.select("o_custkey", F.posexplode(journal.dated_sections(F.col("text"))).alias("pos", "s"))
    # a closing rule before the next heading opens no section of its own
    return cut.select("o_custkey", F.col("s.label").alias("label"), F.regexp_extract("s.chunk", "about (\\d+)", 1).alias("about")).where("about <> ''")


def batched_replies(spark, sf_dir):
    """Replies with a heading a day; a day that comes twice keeps its last text."""
    docs = _documents(spark, sf_dir, F.concat(F.lit("## "), F.substring(_day(), 1, 7), F.lit("-01\nabout "), F.col("o_orderkey").cast("string"), F.lit("\n")))
    cut = docs.select("o_custkey", F.explode(journal.batched_reply(F.col("text"))).alias("s"))
    return cut.select("o_custkey", F.col("s.date_label").alias("label"), F.col("s.body").alias("body"))


def daily_log(spark, sf_dir):
    """Daily logs read back: sections newest first, a project named twice keeps its last paragraph."""
    docs = _documents(spark, sf_dir, F.concat(F.lit("## "), _day(), F.lit("\n\n**"), "o_orderpriority", F.lit("** — first\n**"), "o_orderstatus", F.lit("** - mid\n**"), "o_orderpriority", F.lit("** — order "), F.col("o_orderkey").cast("string"), F.lit("\n---\n")))
    rows = journal.daily_rows(docs)
    return rows.select("o_custkey", F.col("section_no").cast("bigint").alias("section_no"), "date", "project", "paragraph")


def due_runs(spark, sf_dir):
    """Which projects are due on a date, by their weekday, and which runs by their hour."""
    o = table(prepare(spark), sf_dir, "orders")
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    setting = F.element_at(F.array(*map(F.lit, ("mon", " TUE ", "fri", "sun", "", "someday"))), (k % 6 + 1).cast("int"))
    target = F.element_at(F.array(*map(F.lit, ("07:30", "23:59", "7:5", "24:00", "soon"))), (k % 5 + 1).cast("int"))
    now = F.to_timestamp(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" 09:00:00")))
    last = F.when(k % 3 == 0, day).otherwise(F.date_sub(day, 1))
    return o.select("o_orderkey", rollup.is_due(setting, day).alias("project_due"), rollup.run_is_due(target, now, last).alias("run_due"))


def exec_lines(spark, sf_dir):
    """Summary lines without a model, a heading for each project."""
    o = table(prepare(spark), sf_dir, "orders")
    told = o.groupBy(F.col("o_orderpriority").alias("project_id")).agg(F.count("*").alias("n"))
    rows = prompts.exec_body(told.select("project_id", F.when(F.col("project_id") != "5-LOW", F.concat(F.col("n").cast("string"), F.lit(" orders"))).alias("paragraph")))
    return rows.select("project_id", F.col("pos").cast("bigint").alias("pos"), "text")


def sent_rows(spark, sf_dir):
    """Device sync: rows with a privacy stamp are taken in and scrubbed again, the others are held back."""
    rows = stored(spark, sf_dir)
    bare = rows.where("arrival_seq % 5 = 0").withColumn("privacy", F.lit(None).cast(rows.schema["privacy"].dataType))
    taken, held = store.intake(rows.where("arrival_seq % 5 <> 0").unionByName(bare))
    return taken.select(F.lit("taken").alias("route"), "type").unionByName(held.select(F.lit("held").alias("route"), F.lit("").alias("type"))).groupBy("route", "type").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (row_log, stored_log, stream_gate, stream_churn, daily_runs, dated_sections, batched_replies, daily_log, due_runs, exec_lines, sent_rows)}
