"""Sessions out of raw signals: file churn, bursts, clips, long runs, gaps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import (
    AGENT_MARKERS, BURST_THRESHOLD, BURST_WINDOW, COALESCE, CPU_BUSY, LONG_RUN_MIN,
)
from ..functions.actors import file_actor
from ..functions.core import py_trim
from ..functions.paths import is_noise_path
from . import intervals, ordered

DAY, HOUR = 86_400.0, 3_600.0


def coalesce_changes(changes: DataFrame, keys: list[str], ts: str = "ts", *, arrival: str | None = None,
                     spacing_sec: float = COALESCE, bucket_sec: float = HOUR) -> DataFrame:
    """Keep a change only ``spacing_sec`` or more after the last *kept* one of its key.

    A gap of that length before a change settles it on its own, whatever was kept earlier;
    such changes cut a key into independent runs.  A run is folded in time slices.  A slice
    that goes on from the one before first says, for each change it could start with, where
    it would end; those small tables are chained per run, and every slice then knows its
    start.  A slice is a list of its distinct instants, eight bytes each; rows are joined back to the
    instants that are kept.  The result is the sequential one.
    """
    us = int(spacing_sec * 1_000_000)
    slice_sec = max(bucket_sec, spacing_sec)
    order = [F.col(ts), *([F.col(arrival)] if arrival else [])]
    bucket = ordered.time_bucket(F.col(ts), slice_sec)
    runs = ordered.runs(changes, keys, bucket, order, F.unix_micros(ts), lambda before, own: before.isNull() | (own - before >= us), "_run", "_start")
    by = [*keys, "_run", "_slice"]
    slices = runs.withColumn("_slice", bucket).groupBy(*by).agg(
        F.sort_array(F.collect_set(F.unix_micros(ts))).alias("l"), F.max("_start").alias("opens"))

    def step(acc: Column, x: Column) -> Column:
        far = (F.size(acc) == 0) | (x - F.element_at(acc, -1) >= us)
        return F.when(far, F.array_append(acc, x)).otherwise(acc)

    opening = slices.where("opens").withColumn("k", F.aggregate("l", F.array().cast("array<bigint>"), step))
    following = slices.where(~F.col("opens"))
    width = int(slice_sec * 1_000_000)
    entry = F.col("_slice") * width

    ends = opening.select(*by, F.element_at("k", -1).alias("out"), F.lit(None).cast(_EXITS).alias("exits"))
    tables = following.select(*by, F.lit(None).cast("bigint").alias("out"), _exit_table(F.col("l"), entry, F.lit(us)).alias("exits"))
    links = ends.unionByName(tables).groupBy(*keys, "_run").agg(
        F.sort_array(F.collect_list(F.struct("_slice", "out", "exits"))).alias("c")).where(F.size("c") > 1)

    def chain(acc: Column, x: Column) -> Column:
        first_ok = F.get(F.filter(x["exits"], lambda e: e["upto"] >= acc["last"] + us), F.lit(0))["exit"]
        return F.struct(
            F.when(x["out"].isNull(), F.array_append(acc["list"], F.struct(x["_slice"].alias("_slice"), (acc["last"] + us).alias("from"))))
            .otherwise(acc["list"]).alias("list"),
            F.coalesce(x["out"], first_ok, acc["last"]).alias("last"))

    zero = F.struct(F.array().cast("array<struct<_slice:bigint,from:bigint>>").alias("list"), F.lit(None).cast("bigint").alias("last"))
    entries = links.withColumn("e", F.aggregate("c", zero, chain, lambda acc: acc["list"])) \
        .select(*keys, "_run", F.explode("e").alias("e")).select(*keys, "_run", "e._slice", F.col("e.from").alias("from_us"))
    known = following.join(entries, by)
    places = _kept_places(F.col("l"), F.col("from_us"), F.lit(us))
    late = known.withColumn("at", places).select(*keys, F.explode(F.transform("at", lambda i: F.get("l", i))).alias("_us"))
    kept = opening.select(*keys, F.explode("k").alias("_us")).unionByName(late)
    # of the changes at a kept instant the first to arrive stands
    rest = [c for c in changes.columns if c not in (*keys, arrival)]
    first = F.min(F.struct(*([arrival] if arrival else []), *rest)).alias("_row")
    named = kept.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_us")
    same = F.unix_micros(changes[ts]) == named["_us"]
    for i, k in enumerate(keys):
        same = same & changes[k].eqNullSafe(named[f"_k{i}"])
    return changes.join(named, same).groupBy(*keys, "_us").agg(first).select(*keys, "_row.*").select(*changes.columns)


_EXITS = T.ArrayType(T.StructType([T.StructField("upto", T.LongType()), T.StructField("exit", T.LongType())]))


@F.pandas_udf(_EXITS)
def _exit_table(times: pd.Series, entry: pd.Series, spacing: pd.Series) -> pd.Series:
    """Where a slice ends for each change it can start with; equal ends are merged.

    Only changes up to ``spacing`` into the slice, and the first one after, can be first.
    """
    out = []
    for t, begin, c in zip(times, entry, spacing):
        t = np.asarray(t, dtype=np.int64)
        after = np.searchsorted(t, t + c)
        last = np.arange(len(t))
        for i in range(len(t) - 1, -1, -1):
            if after[i] < len(t):
                last[i] = last[after[i]]
        n = min(len(t), int(np.searchsorted(t, begin + c)) + 1)
        rows = []
        for i in range(n):
            end = int(t[last[i]])
            if rows and rows[-1]["exit"] == end:
                rows[-1]["upto"] = int(t[i])
            else:
                rows.append({"upto": int(t[i]), "exit": end})
        out.append(rows)
    return pd.Series(out, dtype=object)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _kept_places(times: pd.Series, start: pd.Series, spacing: pd.Series) -> pd.Series:
    """Places kept in a slice when nothing before ``start`` may be kept."""
    out = []
    for t, begin, c in zip(times, start, spacing):
        t = np.asarray(t, dtype=np.int64)
        kept, i = [], int(np.searchsorted(t, begin))
        while i < len(t):
            kept.append(i)
            i = int(np.searchsorted(t, t[i] + c))
        out.append(kept)
    return pd.Series(out, dtype=object)


def file_changes(raw: DataFrame, *, host: str = "host", humans=(), agents=AGENT_MARKERS, spacing_sec: float = COALESCE,
                 window_sec: float = BURST_WINDOW, threshold: int = BURST_THRESHOLD) -> DataFrame:
    """Raw file signals (``host, ts, arrival_seq, path, action, author, human_active``) to
    changes with burst size and actor: noise out, churn coalesced, then counted and judged."""
    real = raw.where(~is_noise_path("path"))
    kept = coalesce_changes(real, [host, "path"], arrival="arrival_seq", spacing_sec=spacing_sec)
    bursts = burst_size(kept, [host], window_sec=window_sec)
    who = file_actor("author", "human_active", "burst", humans=humans, agents=agents, threshold=threshold)
    return bursts.withColumn("actor", who)


def burst_size(changes: DataFrame, keys: list[str], ts: str = "ts", arrival: str = "arrival_seq", *,
               window_sec: float = BURST_WINDOW, bucket_sec: float = 600.0) -> DataFrame:
    """Changes of a host in the last seconds, this one included."""
    return ordered.trailing_count(changes, keys, F.col(ts), F.col(arrival), window_sec, "burst",
                                  bucket_sec=max(bucket_sec, window_sec), closed=True)


def changed_clips(clips: DataFrame, keys: list[str], order: list[Column], bucket: Column, text: str = "text") -> DataFrame:
    """Drop blank clips and clips equal to the one before."""
    trimmed = clips.withColumn(text, py_trim(F.coalesce(F.col(text), F.lit("")))).where(F.col(text) != "")
    prior = ordered.previous(trimmed, keys, bucket, order, F.col(text), "_p")
    return prior.where(~F.col("_p").eqNullSafe(F.col(text))).drop("_p")


def long_runs(ticks: DataFrame, *, cpu_min: float = CPU_BUSY, min_sec: float = LONG_RUN_MIN,
              bucket_sec: float = DAY) -> DataFrame:
    """Processes that stayed busy with nobody present.

    ``ticks``: ``host, ts, human_present, procs ARRAY<STRUCT<pid,name,cmdline,cpu_percent>>``,
    one row for each scan.  A run breaks at the first scan in which the process is not busy.
    """
    bucket = ordered.time_bucket(F.col("ts"), bucket_sec)
    seen = ordered.previous(ticks, ["host"], bucket, [F.col("ts")], F.col("ts"), "prev_tick")
    busy = seen.where(~F.coalesce("human_present", F.lit(False))).select(
        "host", "ts", "prev_tick", F.posexplode("procs").alias("pos", "p")).where(F.col("p.cpu_percent") >= cpu_min) \
        .select("host", F.col("p.pid").alias("pid"), "ts", F.struct(
            "prev_tick", F.col("p.name").alias("process"), F.col("p.cmdline").alias("cmdline"), F.col("p.cpu_percent").alias("cpu")).alias("row"), "pos")
    # A process listed twice in one scan counts once, its last entry stands.
    busy = busy.groupBy("host", "pid", "ts").agg(F.max_by("row", "pos").alias("row")).select("host", "pid", "ts", "row.*")
    chained = ordered.previous(busy, ["host", "pid"], bucket, [F.col("ts")], F.col("ts"), "prev_busy")
    starts = ~F.coalesce(F.col("prev_busy") == F.col("prev_tick"), F.lit(False))
    runs = ordered.islands(chained, ["host", "pid"], bucket, [F.col("ts")], starts, "run")
    seconds = (F.unix_micros("ended") - F.unix_micros("started")) / 1e6
    return runs.groupBy("host", "pid", "run").agg(
        F.min("ts").alias("started"), F.max("ts").alias("ended"), F.round(F.max("cpu"), 1).alias("cpu_peak"),
        F.max_by("process", "ts").alias("process"), F.max_by("cmdline", "ts").alias("cmdline")) \
        .withColumn("duration_sec", F.round(seconds, 1)).where(seconds >= min_sec).drop("run")


def gap_sessions(events: DataFrame, keys: list[str], gap_sec: float, ts: str = "ts", *,
                 tie: str, bucket_sec: float = DAY) -> DataFrame:
    """Sessions of a key: a new one starts after a pause longer than the gap."""
    order = [F.col(ts), F.col(tie)]
    bucket = ordered.time_bucket(F.col(ts), bucket_sec)
    prior = ordered.previous(events, keys, bucket, order, F.unix_micros(ts), "_p")
    starts = F.col("_p").isNull() | (F.unix_micros(ts) - F.col("_p") > int(gap_sec * 1_000_000))
    runs = ordered.islands(prior, keys, bucket, order, starts, "session_no")
    return runs.groupBy(*keys, "session_no").agg(
        F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("n_events"))


def idle_intervals(idle_events: DataFrame, keys: list[str]) -> DataFrame:
    """Pair each IDLE_START with the IDLE_END that follows: seconds away."""
    order = [F.col("effective_ts"), F.col("event_id")]
    bucket = ordered.time_bucket(F.col("effective_ts"), DAY)
    known = idle_events.where(F.col("effective_ts").isNotNull())
    prior = ordered.previous(known, keys, bucket, order, F.struct("type", "effective_ts"), "_p")
    ends = prior.where((F.col("type") == "IDLE_END") & (F.col("_p.type") == "IDLE_START"))
    return ends.select(*keys, F.col("_p.effective_ts").alias("idle_from"), F.col("effective_ts").alias("idle_to"),
                       ((F.unix_micros("effective_ts") - F.unix_micros("_p.effective_ts")) / 1e6).alias("away_sec"))


def suppress_paused(events: DataFrame, pauses: DataFrame, key: str = "host", ts: str = "effective_ts") -> DataFrame:
    """Drop events inside a privacy pause ``(host, start, end)``, ends included; nothing is buffered."""
    return intervals.outside(events, pauses, key, ts, "start", "end")


def suppressed_counts(events: DataFrame, pauses: DataFrame, key: str = "host", ts: str = "effective_ts") -> DataFrame:
    """``host, n_kept, n_suppressed``: how many events of a host its pauses held back."""
    total = events.groupBy(key).agg(F.count("*").alias("n_events"))
    kept = suppress_paused(events, pauses, key, ts).groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("n"))
    both = total.join(kept, F.col(key).eqNullSafe(F.col("_k")), "left")
    return both.select(key, F.coalesce("n", F.lit(0)).alias("n_kept"), (F.col("n_events") - F.coalesce("n", F.lit(0))).alias("n_suppressed"))


def relabel_since(notes: DataFrame, events: DataFrame, key: str = "host") -> DataFrame:
    """Give earlier events the label of a later "since …" note; the last note wins.

    ``notes``: ``host, since, noted_at, note``; a note covers ``since`` up to, but not at, ``noted_at``.
    """
    last = F.struct("noted_at", "note")
    held = intervals.bests(events.select("event_id", key, "effective_ts"), notes, key, "effective_ts", F.unix_micros("since"), F.unix_micros("noted_at") - 1, last, "_last")
    return held.groupBy("event_id").agg(F.max("_last").alias("_last")).select("event_id", F.col("_last.note").alias("label"))


def heartbeat_status(beats: DataFrame, now: Column, stale_sec: float) -> DataFrame:
    """``live``, ``paused`` or ``off`` of each source by its newest heartbeat."""
    newest = beats.groupBy("source").agg(F.max_by(F.struct("alive", "paused", "heartbeat"), "heartbeat").alias("b"))
    fresh = F.coalesce((F.unix_micros(now) - F.unix_micros("b.heartbeat")) / 1e6 <= stale_sec, F.lit(False))
    return newest.select("source", F.col("b.heartbeat").alias("heartbeat"), F.when(
        ~F.coalesce("b.alive", F.lit(False)) | ~fresh, F.lit("off")).when(
        F.coalesce("b.paused", F.lit(False)), F.lit("paused")).otherwise(F.lit("live")).alias("status"))
