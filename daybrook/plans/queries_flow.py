"""Registered queries: intake, accounts, reports, prompts, registry jobs and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import strings
from ..model import validation_messages
from ..operators import attribution, rollup, timeline
from ..session import materialize, prepare, work_dir
from ..sinks import store
from ..sources import hooks, hosted, registry, reports
from ..streaming import jobs
from . import prompts, report, rounds
from .activity import PROJECTS, RUN_TS, activity, table
from .queries_core import attributed, gated, lines, stored
from .queries_sessions import stream_rows


def validate_messages(spark, sf_dir):
    """Envelope checks on the activity view with versions and types broken by rule."""
    prepare(spark)
    a = activity(spark, sf_dir)
    n = F.col("arrival_seq")
    broken = a.select(
        "arrival_seq", F.when(n % 13 == 0, F.lit("1")).otherwise(F.col("schema_version")).alias("schema_version"),
        F.when(n % 17 == 0, F.lit("PARTY")).otherwise(F.col("type")).alias("type"),
        F.when(n % 19 == 0, F.lit("banana")).otherwise(F.col("source.kind")).alias("kind"), F.col("source.adapter").alias("adapter"),
        F.when(n % 23 == 0, F.lit("")).otherwise(F.col("ts_wall")).alias("ts_wall"),
        F.when(n % 29 == 0, F.lit("sure")).otherwise(F.col("trust")).alias("trust"), (n % 31 != 0).alias("is_object"))
    m = validation_messages(kind="kind", adapter="adapter", is_object=F.col("is_object"), source_is_object=F.lit(True))
    return broken.select("arrival_seq", F.array_join(m, "; ").alias("messages"))


def report_json(spark, sf_dir):
    """One JSON report per row of ``events``, some malformed, late or from strangers."""
    rows = stream_rows(spark, sf_dir)
    k, e = F.col("k"), F.col("event_id").cast("string")
    ts = F.when(k % 11 == 0, F.lit("2024-03-01T00:00:00+00:00")).when(k % 11 == 1, F.lit("whenever")) \
        .otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    kind = F.when(k % 7 == 0, F.lit("remote")).when(k % 7 == 1, F.lit("banana")).otherwise(F.lit("agent"))
    head = F.concat(F.lit('{"event_id": "r'), e, F.lit('", "type": "AGENT_REPORT", "trust": "validated", "source": {"kind": "'), kind,
                    F.lit('", "adapter": "sdk", "identity": "agent:'), (F.col("user_id") % 5).cast("string"), F.lit('"}, "ts_wall": "'), ts)
    whole = F.concat(head, F.lit('", "payload": {"summary": "did '), e, F.lit('", "extra": 1}}'))
    text = F.when(k % 13 == 0, F.lit("{oops")).when(k % 13 == 1, F.concat(head, F.lit('", "payload": "not an object"}'))).otherwise(whole)
    return rows.select("event_id", text.alias("value"), F.concat(F.lit("f"), e, F.lit(".json")).alias("file_name"))


def trust_routes(spark, sf_dir):
    files = report_json(spark, sf_dir)
    texts = reports.report_texts(files)
    out = reports.classify(texts, now=RUN_TS, trusted=["agent:0", "agent:1", "agent:2"])
    return out.select("file_name", "trust", "source.identity", F.coalesce(F.array_join(F.coalesce("payload.reasons", "payload.trust_reasons"), "; "), F.lit("")).alias("why"),
                      F.col("payload.summary").alias("summary"))


def hosted_payloads(spark, sf_dir):
    """Commit, pull-request and CI payloads built from orders and customers."""
    prepare(spark)
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    j = o.join(c, o["o_custkey"] == c["c_custkey"])
    k = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00:00'Z'")
    login = F.when(k % 4 == 0, F.lit("dependabot[bot]")).otherwise(F.col("c_name"))
    remote = F.concat(F.lit("github.com/acme/r"), (k % 9).cast("string"), F.when(k % 3 == 0, F.lit(".git")).otherwise(F.lit("")))
    pull = F.concat(F.lit('{"number": '), k.cast("string"), F.lit(', "title": "'), "o_orderpriority", F.lit('", "state": "'),
                    F.when(k % 5 == 0, F.lit("closed")).otherwise(F.lit("open")), F.lit('", "draft": '), F.when(k % 7 == 0, F.lit("true")).otherwise(F.lit("false")),
                    F.when(k % 10 == 0, F.concat(F.lit(', "merged_at": "'), day, F.lit('"'))).otherwise(F.lit("")),
                    F.lit(', "updated_at": "'), day, F.lit('", "user": {"login": "'), login, F.lit('", "type": "User"}}'))
    commit = F.concat(F.lit('{"sha": "'), F.sha2(k.cast("string"), 256), F.lit('", "commit": {"message": "'), "o_orderpriority", F.lit('\\nmore", "author": {"name": "'),
                      "c_name", F.lit('", "date": "'), day, F.lit('"}}, "files": [{"filename": "a.py"}, {"x": 1}]}'))
    run_ = F.concat(F.lit('{"name": "'), "o_orderstatus", F.lit('", "status": "queued", "conclusion": '), F.when(k % 2 == 0, F.lit('"success"')).otherwise(F.lit("null")),
                    F.lit(', "created_at": "'), day, F.lit('"}'))
    return j.select(k.alias("k"), remote.alias("remote"), pull.alias("pull"), commit.alias("commit_json"), run_.alias("run_json"))


def repo_payload_events(spark, sf_dir):
    rows = hosted_payloads(spark, sf_dir)
    reg = registry.from_dicts(spark, [{"id": f"r{i}", "signals": {"git_remotes": [f"github.com/acme/r{i}"]}} for i in range(6)])
    rows = hosted.only_tracked(rows, registry.tracked_remotes(reg))

    def parsed(column: str, schema: str):
        return rows.select("k", "remote", F.from_json(column, f"STRUCT<{schema}>").alias("j")).select("k", "remote", "j.*")
    out = hosted.commit_events(parsed("commit_json", hosted.COMMIT), now=RUN_TS, keep=("k",)) \
        .unionByName(hosted.pull_events(parsed("pull", hosted.PULL), now=RUN_TS, keep=("k",))) \
        .unionByName(hosted.run_events(parsed("run_json", hosted.RUN), now=RUN_TS, keep=("k",)))
    p = F.col("payload")
    return out.select("k", F.col("source.kind").alias("kind"), F.col("source.identity").alias("identity"), "ts_wall", p["summary"].alias("summary"),
                      p["kind_detail"].alias("detail"), F.coalesce(F.array_join(p["files"], ","), F.lit("")).alias("files"))


def incremental_pulls(spark, sf_dir):
    """Second poll: pull requests emitted again only where ``updated_at`` moved."""
    prepare(spark)
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    base = o.select(F.lit("github.com/acme/r").alias("remote"), k.cast("string").alias("number"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("updated_at"), k.alias("k"))
    seen = base.where("k % 3 <> 0").select("remote", "number", F.when(F.col("k") % 5 == 0, F.lit("1990-01-01")).otherwise(F.col("updated_at")).alias("updated_at"))
    fresh = hosted.new_pulls(base, seen)
    state = hosted.seen_after(seen, fresh, ["remote", "number"], "updated_at")
    return state.join(fresh.select("number", F.lit(True).alias("emitted")), "number", "left").select(
        "number", "updated_at", F.coalesce("emitted", F.lit(False)).alias("emitted"))


def hook_reports(spark, sf_dir):
    rows = stream_rows(spark, sf_dir)
    k, e = F.col("k"), F.col("event_id").cast("string")
    name = F.when(k % 3 == 0, F.lit("PostToolUse")).when(k % 3 == 1, F.lit("Stop")).otherwise(F.lit("Notify"))
    line = F.concat(F.lit('{"hook_event_name": "'), name, F.lit('", "cwd": "/w/p'), (k % 4).cast("string"), F.lit('", "session_id": "s'), e,
                    F.lit('", "tool_name": "Edit"'), F.when(k % 2 == 0, F.concat(F.lit(', "tool_input": {"file_path": "/w/x/f'), e, F.lit('.py"}'))).otherwise(F.lit("")), F.lit("}"))
    built = hooks.hook_reports(rows.select("event_id", line.alias("value")), flavour="claude_code", ts_wall=F.lit(RUN_TS))
    return built.select("event_id", "summary", "repo", "project", F.array_join("files", ",").alias("files"))


def egress_split(spark, sf_dir):
    """Stamped rows are sendable, the others are blocked by id."""
    from ..operators import gate
    rows = gated(spark, sf_dir).drop("diff_clean", "drop_reason")
    sent = gate.sendable(rows).select("event_id", F.lit("sendable").alias("route"), F.coalesce("payload.note", F.lit("")).alias("note"))
    return sent.unionByName(gate.blocked(rows).select("event_id", F.lit("blocked").alias("route"), F.lit("").alias("note")))


def account_store(spark, sf_dir):
    """Token to account, safe folder names, and a text comparison on the wall clock."""
    rows = stored(spark, sf_dir).select("event_id", "ts_wall", F.concat(F.lit("tok"), (F.col("arrival_seq") % 7).cast("string")).alias("token"))
    tokens = spark.createDataFrame([(f"tok{i}", f"../team {i}!") for i in range(5)], "t STRING, account STRING") \
        .select(F.sha2("t", 256).alias("token_sha256"), "account")
    known, unknown = store.route_accounts(rows, tokens)
    known = store.account_rows(known)
    since = known.where("ts_wall >= '2024-01-10'")
    return since.groupBy("account", "date_key").agg(F.count("*").alias("n_rows")).unionByName(
        unknown.agg(F.count("*").alias("n_rows")).select(F.lit("(unauthorised)").alias("account"), F.lit("").alias("date_key"), "n_rows"))


def _daily(spark, sf_dir):
    """Daily paragraphs: one run a day, with the day's notes counted per project."""
    rows = attribution.in_projects(attributed(spark, sf_dir)).where(F.col("date_key").rlike("^[0-9]{8}$"))
    day = rows.groupBy("date_key", F.col("attribution.project_id").alias("project_id")).agg(F.count("*").alias("n"))
    return materialize(day.select(
        F.concat_ws("-", F.substring("date_key", 1, 4), F.substring("date_key", 5, 2), F.substring("date_key", 7, 2)).alias("run_date"),
        "project_id", F.concat(F.col("n").cast("string"), F.lit(" events")).alias("paragraph"), F.col("date_key").cast("bigint").alias("run_seq")), "daily")


def standup_rows(spark, sf_dir):
    numbered = report.sections(_daily(spark, sf_dir))
    return report.standup_lines(numbered, rollup=True).select("section_no", F.col("pos").cast("bigint").alias("pos"), "text")


def timeline_rows(spark, sf_dir):
    return report.timeline_table(timeline.reconcile(stored(spark, sf_dir))).groupBy("clock", "type", "text").agg(F.count("*").alias("n"))


def project_bars(spark, sf_dir):
    times = rollup.time_per_project(attributed(spark, sf_dir), registry.names_of(spark, PROJECTS))
    return report.with_bars(times)


def review_batches(spark, sf_dir):
    """Review queue cut into prompt batches: sizes and output budgets."""
    rows = prompts.categorize_prompts(attributed(spark, sf_dir), PROJECTS)
    return rows.select("batch_no", "n_events", "max_tokens")


def apply_review(spark, sf_dir):
    """Apply outside answers to the review queue by batch and index."""
    rows = materialize(attributed(spark, sf_dir), "attributed")
    indexed = prompts.review_index(rows)
    item = F.concat(F.lit('{"index": "'), F.col("idx").cast("string"), F.lit('", "project_id": "'),
                    F.when(F.col("idx") % 3 == 0, F.lit("invented")).otherwise(F.lit("cobalt")), F.lit('", "confidence": '),
                    F.when(F.col("idx") % 2 == 0, F.lit("0.9")).otherwise(F.lit("0.4")), F.lit("}"))
    replies = indexed.groupBy("batch_no").agg(F.concat(F.lit("<think>x</think>```json\n{\"assignments\": ["),
                                                       F.array_join(F.collect_list(item), ","), F.lit("]}\n```")).alias("reply"))
    known = ["atlas", "borealis", "cobalt"]
    done = prompts.apply_answers(rows, prompts.parse_assignments(replies, known), known)
    a = F.col("attribution")
    return done.groupBy(F.coalesce(a["method"], F.lit("unattributed")).alias("method"), F.coalesce(a["project_id"], F.lit("")).alias("project_id"),
                        F.round(a["confidence"], 4).alias("confidence")).agg(F.count("*").alias("n_events"))


def day_tokens(spark, sf_dir):
    return prompts.day_tokens(attributed(spark, sf_dir))


def activity_chunks(spark, sf_dir):
    rows = prompts.activity_chunks(attributed(spark, sf_dir), 20)
    return rows.select("project_id", "date_key", "chunk_no", "n_events", F.md5("block").alias("block_md5"))


def apply_entries(spark, sf_dir):
    """One reply a block of 20 events, put together per day; every third day gets no reply."""
    chunks = materialize(prompts.activity_chunks(attributed(spark, sf_dir), 20).select("project_id", "date_key", "chunk_no", "n_events"), "chunks")
    said = chunks.where("substring(date_key, 8, 1) NOT IN ('0', '3', '6', '9')").select(
        "project_id", "date_key", "chunk_no", F.concat(F.lit(" part "), F.col("chunk_no").cast("string"), F.lit(" of "), "project_id", F.lit("\n")).alias("reply"))
    done = prompts.apply_entries(chunks.select("project_id", "date_key").distinct(), said)
    return done.select("project_id", "date_key", F.md5(F.coalesce("entry", F.lit("(archive)"))).alias("entry_md5"))


def _echo(asked, number):
    """Replies that name their node; every fifth part gets none."""
    known = asked.where(F.col("node_no") % 5 != 4)
    return known.select("prompt_sha256", F.concat(F.lit("round "), F.lit(str(number)), F.lit(" node "), F.col("node_no").cast("string"), F.lit("\n" + prompts.DAILY_SEPARATOR + "\nday")).alias("reply"))


def overview_rounds(spark, sf_dir):
    """Overview prompts in rounds of six blocks: hashes of all whole prompts of the first round, sizes of the others."""
    rows = materialize(attributed(spark, sf_dir), "attributed")
    none = spark.createDataFrame([], "project_id STRING, overview STRING")
    asked, done = rounds.overview_rounds(rows, none, _echo, size=20, fan=6)
    first = F.when(F.col("round") == 0, F.col("prompt_sha256")).otherwise(F.lit(""))
    out = asked.select("project_id", "round", F.col("node_no").cast("bigint").alias("node_no"), "label", "n_pieces", first.alias("said"))
    kept = done.select("project_id", F.lit(-1).alias("round"), F.lit(0).cast("bigint").alias("node_no"), F.col("daily").alias("label"), F.lit(0).cast("bigint").alias("n_pieces"), F.trim(F.replace("overview", F.lit("\n"), F.lit(""))).alias("said"))
    return out.unionByName(kept)


def unit_prompts(spark, sf_dir):
    """One prompt for each packed unit of days, with the hash of its material."""
    known = registry.from_dicts(spark, [{"id": p["id"], "signals": {"entry_extract": ["grades"]}} for p in PROJECTS])
    out = rounds.unit_prompts(materialize(attributed(spark, sf_dir), "attributed"), known, mode="adaptive", budget=3000, max_days=5)
    return out.select("project_id", F.col("unit_no").cast("bigint").alias("unit_no"), F.col("n_days").cast("bigint").alias("n_days"), "label", F.sha2("user", 256).alias("user_sha256"))


def journal_lines(spark, sf_dir):
    """Journal of days with and without a written entry; the archive stands in."""
    from .queries_core import rollup as core
    rows = materialize(attributed(spark, sf_dir), "attributed")
    days = rows.where("attribution.project_id is not null").select(F.col("attribution.project_id").alias("project_id"), "date_key").distinct()
    entry = F.when(~F.substring("date_key", 8, 1).isin("0", "3", "6", "9"), F.concat(F.lit("wrote "), "project_id"))
    out = rounds.journal_lines(days.withColumn("entry", entry), core.document_lines(rows))
    return out.groupBy("project_id", "date_key", "origin", "text").agg(F.count("*").alias("n"))


def discovered_projects(spark, sf_dir):
    """Registry rows for repositories found, with ids made unique against the registry."""
    prepare(spark)
    p = table(spark, sf_dir, "part")
    known = registry.from_dicts(spark, [{"id": "small-ring", "signals": {"paths": ["/repos/0/small ring"]}}, {"id": "red-widget-3", "signals": {"paths": ["/x"]}}])
    repos = p.select(F.concat(F.lit("/repos/"), F.col("p_partkey").cast("string"), F.lit("/"), "p_name").alias("path"), F.lit("").alias("title"),
                     F.array(F.concat(F.lit("github.com/acme/p"), F.col("p_partkey").cast("string"))).alias("remotes"),
                     F.when(F.col("p_size") % 2 == 0, strings(["setup.py", "go.mod"])).otherwise(strings([])).alias("markers"))
    d = registry.discover(repos, known, "2024-02-01")
    s = F.col("signals")
    return d.select("id", "name", F.array_join(s["paths"], ",").alias("path"), F.array_join(s["keywords"], "|").alias("keywords"),
                    F.array_join(s["apps"], "|").alias("apps"), F.array_join(s["window_patterns"], "|").alias("patterns"))


def discovered_clashes(spark, sf_dir):
    """Folder names that look like another folder's numbered name; every id occurs once."""
    prepare(spark)
    p = table(spark, sf_dir, "part")
    word, number = F.split("p_name", " ")[0], F.col("p_partkey") % 5
    known = registry.from_dicts(spark, [{"id": "small", "signals": {"paths": ["/x"]}}, {"id": "red-3", "signals": {"paths": ["/y"]}}])
    repos = p.select(F.concat(F.lit("/repos/"), F.col("p_partkey").cast("string"), F.lit("/"), word,
                              F.when(number > 1, F.concat(F.lit("-"), number.cast("string"))).otherwise(F.lit(""))).alias("path"),
                     F.lit("").alias("title"), F.array().cast("array<string>").alias("remotes"), F.array().cast("array<string>").alias("markers"))
    return registry.discover(repos, known, "2024-02-01").select("id", F.element_at("signals.paths", 1).alias("path"))


# --- streams -------------------------------------------------------------------------

def _event_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_dedup(spark, sf_dir):
    """Retries inside the watermark are dropped; every row comes twice."""
    prepare(spark)
    doubled = _event_stream(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    rows = jobs.collect_table(jobs.dedup_stream(doubled, "1 day", "ts"), "stream-dedup")
    return rows.select("event_id", "user_id")


def stream_trust(spark, sf_dir):
    """Reports through the trust stream; the same verdicts as the batch query."""
    src = work_dir(prepare(spark), "reports")
    report_json(spark, sf_dir).write.parquet(src)
    # a batch takes some files a core, however many there are
    stream = spark.readStream.schema("event_id LONG, value STRING, file_name STRING").option("maxFilesPerTrigger", 2 * spark.sparkContext.defaultParallelism).parquet(src)
    out, state = work_dir(spark, "trust"), work_dir(spark, "trust-state")
    jobs.run(jobs.trust_stream(reports.report_texts(stream), out, state, now=RUN_TS, trusted=["agent:0", "agent:1", "agent:2"]), once=True).awaitTermination()
    return spark.read.parquet(out).groupBy(F.col("trust").cast("string").alias("trust")).agg(F.count("*").alias("n_reports"))


def stream_timeline(spark, sf_dir):
    """Two arrivals of the activity view; touched days rebuilt; equal to the batch timeline."""
    src = work_dir(prepare(spark), "arrivals")
    rows = activity(spark, sf_dir)
    bronze, silver, state = work_dir(spark, "bronze"), work_dir(spark, "silver"), work_dir(spark, "timeline-state")
    with jobs.settings(spark, jobs.WHOLE_EVENTS):
        for turn in range(2):
            rows.where(F.col("arrival_seq") % 2 == turn).write.mode("append").parquet(src)
            # an arrival is one batch, however many files it has: a batch builds all days again that it touches
            stream = spark.readStream.schema(rows.schema).parquet(src)
            jobs.run(stream.writeStream.foreachBatch(jobs.rebuild_days(bronze, silver)).option("checkpointLocation", state), once=True).awaitTermination()
    out = spark.read.parquet(silver)
    return out.select("event_id", "arrival_seq", "trust", F.col("date_key").cast("string").alias("date_key"))


def daily_archive(spark, sf_dir):
    """Lines per project day, the whole flow from gate to archive."""
    return lines(spark, sf_dir).groupBy("project_id", "date_key").agg(F.count("*").alias("n_lines"))


QUERIES = {f.__name__: f for f in (
    validate_messages, trust_routes, repo_payload_events, incremental_pulls, hook_reports, egress_split, account_store, standup_rows,
    timeline_rows, project_bars, review_batches, apply_review, day_tokens, activity_chunks, apply_entries, overview_rounds, unit_prompts, journal_lines, discovered_projects, discovered_clashes,
    stream_dedup, stream_trust, stream_timeline, daily_archive)}
