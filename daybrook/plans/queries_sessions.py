"""Registered queries: sessions, windows, packing and call metrics over the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calls, focus, ordered, rollup, sessions, timeline
from ..session import prepare, spread
from .activity import activity, table


def stream_rows(spark, sf_dir):
    """``events`` with UTC timestamps, the payload number and ten hosts."""
    prepare(spark)
    e = spread(table(spark, sf_dir, "events"))
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value",
                    F.get_json_object("props", "$.k").try_cast("int").alias("k"),
                    F.concat(F.lit("host"), (F.col("user_id") % 10).cast("string")).alias("host"))


def _ntz(*names):
    return [F.col(n).cast("timestamp_ntz").alias(n) for n in names]


def churn_coalesce(spark, sf_dir):
    rows = stream_rows(spark, sf_dir).withColumn("path", F.concat(F.lit("p"), (F.col("user_id") % 40).cast("string")))
    kept = sessions.coalesce_changes(rows, ["path"], arrival="event_id", spacing_sec=5 * 3600.0, bucket_sec=86_400.0)
    return kept.select("path", "event_id", *_ntz("ts"))


def burst_size(spark, sf_dir):
    rows = stream_rows(spark, sf_dir)
    out = sessions.burst_size(rows, ["host"], arrival="event_id", window_sec=3600.0, bucket_sec=21_600.0)
    return out.select("event_id", "host", F.col("burst").cast("bigint").alias("burst"))


def file_actors(spark, sf_dir):
    """Noise filter, coalescing, burst and actor in one flow."""
    rows = stream_rows(spark, sf_dir)
    ending = F.when(F.col("k") % 9 == 0, F.lit(".tmp")).otherwise(F.lit(".py"))
    author = F.when(F.col("k") % 5 == 0, F.lit("Copilot")).when(F.col("k") % 5 == 1, F.lit("Ana B")).otherwise(F.lit(""))
    raw = rows.select("host", "ts", F.col("event_id").alias("arrival_seq"),
                      F.concat(F.lit("src/f"), (F.col("user_id") % 20).cast("string"), ending).alias("path"),
                      F.lit("modified").alias("action"), author.alias("author"), (F.col("k") % 2 == 0).alias("human_active"))
    out = sessions.file_changes(raw, humans=("ana",), spacing_sec=3 * 3600.0, window_sec=7200.0, threshold=3)
    return out.select("arrival_seq", "host", "path", F.col("burst").cast("bigint").alias("burst"), "actor.actor", "actor.method",
                      F.round("actor.confidence", 2).alias("confidence"))


def clipboard_dedup(spark, sf_dir):
    rows = stream_rows(spark, sf_dir)
    clips = rows.select("user_id", "ts", "event_id", F.when(F.col("k") % 10 == 0, F.lit("  ")).otherwise(F.col("event_type")).alias("text"))
    kept = sessions.changed_clips(clips, ["user_id"], [F.col("ts"), F.col("event_id")], ordered.time_bucket(F.col("ts"), 86_400.0))
    return kept.select("user_id", "event_id", "text")


def process_ticks(spark, sf_dir):
    """One scan per host and six hours: a process per user with its largest value as load."""
    rows = stream_rows(spark, sf_dir)
    tick = F.timestamp_seconds(F.floor(F.unix_seconds("ts") / 21_600) * 21_600)
    per_user = rows.groupBy("host", tick.alias("ts"), "user_id").agg(F.max("value").alias("cpu"), F.max("k").alias("k"))
    proc = F.struct(F.col("user_id").alias("pid"), F.concat(F.lit("job"), F.col("user_id").cast("string")).alias("name"),
                    F.concat(F.lit("run "), F.col("k").cast("string")).alias("cmdline"), F.col("cpu").alias("cpu_percent"))
    return per_user.groupBy("host", "ts").agg((F.min("user_id") % 3 == 0).alias("human_present"), F.collect_list(proc).alias("procs"))


def long_runs(spark, sf_dir):
    out = sessions.long_runs(process_ticks(spark, sf_dir), cpu_min=20.0, min_sec=21_600.0, bucket_sec=2 * 86_400.0)
    return out.select("host", "pid", *_ntz("started", "ended"), "cpu_peak", "process", "cmdline", "duration_sec")


def session_gap(spark, sf_dir):
    out = sessions.gap_sessions(stream_rows(spark, sf_dir), ["user_id"], 3600.0, tie="event_id")
    return out.select("user_id", "session_no", *_ntz("started", "ended"), "n_events")


def idle_intervals(spark, sf_dir):
    rows = timeline.reconcile(activity(prepare(spark), sf_dir)).where("type in ('IDLE_START', 'IDLE_END') and event_id <> ''")
    out = sessions.idle_intervals(rows.withColumn("host", F.col("source.identity")), ["host"])
    return out.select("host", *_ntz("idle_from", "idle_to"), "away_sec")


def privacy_pauses(spark, sf_dir):
    """Events outside the pauses; a host pauses for two hours after every sign-up."""
    rows = stream_rows(spark, sf_dir)
    pauses = rows.where("event_type = 'signup'").select("host", F.col("ts").alias("start"), (F.col("ts") + F.expr("INTERVAL 2 HOURS")).alias("end"))
    return sessions.suppress_paused(rows, pauses, ts="ts").groupBy("host").agg(F.count("*").alias("n_kept"), F.max("event_id").alias("last_event"))


def relabelled(spark, sf_dir):
    """Label events with a later note that reaches back three hours."""
    rows = stream_rows(spark, sf_dir).withColumnRenamed("ts", "effective_ts")
    notes = rows.where("event_type = 'signup'").select(
        "host", (F.col("effective_ts") - F.expr("INTERVAL 3 HOURS")).alias("since"), F.col("effective_ts").alias("noted_at"),
        F.concat(F.lit("note "), F.col("event_id").cast("string")).alias("note"))
    return sessions.relabel_since(notes, rows)


def spans_of_all_lengths(spark, sf_dir):
    """Pauses and notes from one second to ten years: events held back per host, and the note that labels each of the others."""
    rows = stream_rows(spark, sf_dir).withColumnRenamed("ts", "effective_ts")
    length = F.when(F.col("k") % 5 == 0, 1).when(F.col("k") % 5 == 1, 90).when(F.col("k") % 5 == 2, 7_200).when(F.col("k") % 5 == 3, 400_000).otherwise(315_360_000)
    span = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), length.cast("decimal(18,6)"))
    marks = rows.where("event_type = 'signup'").withColumn("length", length)
    pauses = marks.where("k % 5 < 3").select("host", F.col("effective_ts").alias("start"), (F.col("effective_ts") + span).alias("end"))
    notes = marks.where("k % 5 >= 3 and user_id % 3 = 0").select(
        "host", (F.col("effective_ts") - span).alias("since"), F.col("effective_ts").alias("noted_at"), F.concat(F.lit("note "), F.col("event_id").cast("string")).alias("note"))
    kept = sessions.suppress_paused(rows, pauses)
    labels = sessions.relabel_since(notes, kept)
    counts = sessions.suppressed_counts(rows, pauses)
    return kept.select("event_id", "host").join(labels, "event_id", "left").groupBy("host", "label").agg(F.count("*").alias("n_events")).join(counts, "host") \
        .select("host", F.coalesce("label", F.lit("")).alias("label"), "n_events", "n_kept", "n_suppressed")


def liveness(spark, sf_dir):
    rows = stream_rows(spark, sf_dir)
    beats = rows.select(F.col("user_id").alias("source"), F.col("ts").alias("heartbeat"), (F.col("k") % 7 != 0).alias("alive"),
                        (F.col("k") % 4 == 0).alias("paused"))
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    out = sessions.heartbeat_status(beats, now, 6 * 3600.0)
    return out.select("source", "status", *_ntz("heartbeat"))


FOCUS_RULES = focus.FocusRules(anchor_timeout=1800.0, idle_threshold=1500.0, periodic=14_400.0)


def window_samples(spark, sf_dir):
    """Window samples: the event type is the title, the number the keys; idle after quiet hours."""
    rows = stream_rows(spark, sf_dir)
    none = F.lit(None).cast("string")
    return rows.select(
        "host", "ts", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00")).alias("ts_wall"),
        F.col("event_id").alias("tick_seq"), F.concat(F.col("event_type"), F.lit(".py - editor")).alias("title"),
        F.lit("Code.exe").alias("process"), F.when(F.col("value") > 60, F.col("value") * 20).otherwise(F.lit(0.0)).alias("idle_seconds"),
        F.col("k").alias("keys"), (F.col("k") % 7).alias("mouse"), (F.col("k") % 2).alias("saves"),
        none.alias("uia_value"), none.alias("cmdline"), none.alias("cwd"), none.alias("saved_artifact"), none.alias("narration"))


def focus_rows(rows):
    p = F.col("payload")
    return focus.to_events(rows).select(
        F.col("source.identity").alias("host"), "type", "ts_wall", p["anchor"].alias("anchor"), p["mode"].alias("mode"),
        p["duration_sec"].cast("double").alias("duration_sec"), p["ended"].alias("ended"), F.coalesce(p["activity_score"].cast("bigint"), F.lit(-1)).alias("keys"),
        F.array_join(F.transform(p["satellites"], lambda x: x["title"]), ",").alias("satellites"),
        p["intent"]["label"].alias("intent"), F.coalesce(F.coalesce(p["away_sec"], p["idle_after_sec"]).cast("bigint"), F.lit(-1)).alias("seconds"))


def focus_sessions(spark, sf_dir):
    return focus_rows(focus.sessionize(window_samples(spark, sf_dir), FOCUS_RULES))


def _order_days(spark, sf_dir):
    prepare(spark)
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("project_id"), F.date_format("o_orderdate", "yyyyMMdd").alias("date_key")) \
        .agg((F.count("*") * 137 + 40).alias("tokens"))


def pack_days_adaptive(spark, sf_dir):
    return rollup.pack_days(_order_days(spark, sf_dir), mode="adaptive", budget=1500, max_days=7).select(
        "project_id", "date_key", "tokens", F.col("unit_no").cast("bigint").alias("unit_no"))


def pack_days_week(spark, sf_dir):
    return rollup.pack_days(_order_days(spark, sf_dir), mode="week", budget=0, max_days=5).select(
        "project_id", "date_key", "tokens", F.col("unit_no").cast("bigint").alias("unit_no"))


def order_rollup(spark, sf_dir):
    """Volume rollup: shipments by order priority and period, week and month in one pass."""
    prepare(spark)
    from ..functions.dates import period_key
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", F.date_format("l_shipdate", "yyyyMMdd").alias("date_key"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("project_id"))
    joined = li.join(o, li["l_orderkey"] == o["o_orderkey"])
    daily = joined.groupBy("project_id", "date_key").agg(F.count("*").alias("n"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("cents"))
    facets = F.explode(F.array(*[F.struct(F.lit(g).alias("granularity"), period_key("date_key", g).alias("period_key")) for g in ("week", "month")]))
    return daily.select("project_id", "n", "cents", facets.alias("p")).groupBy("project_id", "p.granularity", "p.period_key").agg(
        F.sum("n").alias("n_lines"), F.sum("cents").cast("bigint").alias("cents"))


def call_log(spark, sf_dir):
    """``events`` read as a model call log."""
    rows = stream_rows(spark, sf_dir)
    k = F.col("k")
    error = F.when(k % 12 == 0, F.lit("HTTP 429 too many requests")).when(k % 12 == 1, F.lit("No API key")) \
        .when(k % 12 == 2, F.lit("HTTP 401 denied")).when(k % 12 == 3, F.lit("HTTP 404")).when(k % 12 == 4, F.lit("connection refused")) \
        .when(k % 12 == 5, F.lit("odd failure"))
    return rows.select(
        F.col("event_id").alias("call_id"), F.date_format("ts", "yyyy-MM-dd").alias("run"), F.col("host").alias("account"), "ts",
        F.col("event_type").alias("label"), F.concat(F.lit("m"), (k % 3).cast("string")).alias("model"),
        F.col("user_id").cast("string").alias("prompt_tokens"), F.when(k % 8 == 0, F.lit("n/a")).otherwise(k.cast("string")).alias("completion_tokens"),
        F.when(k % 4 == 0, F.lit("0")).otherwise((F.col("user_id") + k).cast("string")).alias("total_tokens"),
        F.round("value", 2).alias("latency_sec"), (k % 10 == 0).alias("fallback_used"), error.isNull().alias("ok"), F.coalesce(error, F.lit("")).alias("error"))


def call_metrics(spark, sf_dir):
    return calls.summary(call_log(spark, sf_dir)).withColumn("latency_sec", F.round("latency_sec", 2))


def rate_window(spark, sf_dir):
    out = calls.over_rate(call_log(spark, sf_dir), 3, window_sec=7200.0, bucket_sec=43_200.0)
    return out.select("call_id", "account", F.col("in_window").cast("bigint").alias("in_window"), F.round("wait_sec", 3).alias("wait_sec"))


def breaker_misses(spark, sf_dir):
    return calls.after_breaker(call_log(spark, sf_dir)).groupBy("run", "model").agg(F.count("*").alias("n_calls"), F.min("call_id").alias("first_call"))


def error_classes(spark, sf_dir):
    log = call_log(spark, sf_dir).where(~F.col("ok"))
    return log.groupBy(calls.error_class(F.col("error")).alias("verdict")).agg(F.count("*").alias("n_calls"))


def run_exit_codes(spark, sf_dir):
    log = call_log(spark, sf_dir).withColumn("run", F.concat("run", F.lit("/"), "account", F.lit("/"), "model"))
    return calls.overall_exit(log)


QUERIES = {f.__name__: f for f in (
    churn_coalesce, burst_size, file_actors, clipboard_dedup, long_runs, session_gap, idle_intervals, privacy_pauses, relabelled, spans_of_all_lengths,
    liveness, focus_sessions, pack_days_adaptive, pack_days_week, order_rollup, call_metrics, rate_window, breaker_misses,
    error_classes, run_exit_codes)}
