"""Registered queries of state per key: live feeds that give the rows of the batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize, prepare, work_dir
from ..streaming import focus_stream, jobs, runs_stream
from .activity import activity
from .queries_sessions import FOCUS_RULES, focus_rows, process_ticks, stream_rows, window_samples

#: Longer than any quiet time of the tables: the batch forms know no silence.
SILENCE = 90 * 86_400.0


#: Rows of an arrival; a stream holds the rows of one arrival and reads them as one micro-batch.
ARRIVAL_ROWS = 1_000_000


def arrivals(rows: DataFrame, name: str, *, replay: bool = False, size: int = ARRIVAL_ROWS) -> DataFrame:
    """A stream of ``rows`` in two arrivals or more by the clock, the later half twice with ``replay``; then a beat that ends all hosts.

    An arrival has about ``size`` rows at most, as far as the clock tells them apart.  The beat is a row of a
    host of its own, long after the last one; it moves the clock on.
    """
    spark, src = rows.sparkSession, work_dir(rows.sparkSession, name)
    rows = materialize(rows.where("ts is not null"), "feed")
    turns = max(2, -(-rows.count() // size))
    cuts = rows.agg(F.percentile_approx(F.unix_micros("ts"), [k / turns for k in range(1, turns)], 100 * turns).alias("cuts")).first()["cuts"] or []
    turn = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda cut: cut <= F.unix_micros("ts"))) if cuts else F.lit(0)
    staged = work_dir(spark, "turns")
    rows.withColumn("_turn", turn).write.partitionBy("_turn").parquet(staged)
    beat = rows.groupBy().agg(F.max("ts").alias("last")).select(
        *(F.lit(f"beat of {name}").alias("host") if f.name == "host" else (F.col("last") + F.make_dt_interval(F.lit(int(2 * SILENCE / 86_400)))).alias("ts") if f.name == "ts"
          else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema))
    staged = spark.read.schema(T.StructType([*rows.schema, T.StructField("_turn", T.IntegerType())])).parquet(staged)
    for k in range(turns):
        for _ in range(2 if replay and 2 * k >= turns else 1):
            staged.where(F.col("_turn") == k).drop("_turn").coalesce(1).write.mode("append").parquet(src)
    beat.coalesce(1).write.mode("append").parquet(src)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(src).where("ts is not null")


def stream_focus(spark, sf_dir):
    """Focus sessions from a feed in two arrivals; the rows of ``focus_sessions``."""
    feed = arrivals(window_samples(prepare(spark), sf_dir), "samples")
    rows = jobs.collect_table(focus_stream.focus_stream(feed, FOCUS_RULES, delay="1 second", silence_sec=SILENCE), "focus-stream")
    return focus_rows(rows)


def stream_long_runs(spark, sf_dir):
    """Long runs from a feed of scans, one arrival replayed; the rows of ``long_runs``."""
    feed = arrivals(process_ticks(prepare(spark), sf_dir), "scans", replay=True)
    rows = jobs.collect_table(runs_stream.long_run_stream(feed, cpu_min=20.0, min_sec=21_600.0, delay="1 second", silence_sec=SILENCE), "run-stream")
    return rows.select("host", "pid", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("started", "ended")], "cpu_peak", "process", "cmdline", "duration_sec")


def stream_days(spark, sf_dir):
    """Two arrivals of the activity view through three streams; ids are looked up in state; the rows of the batch timeline."""
    src, root = work_dir(prepare(spark), "arrivals"), work_dir(spark, "days")
    rows = activity(spark, sf_dir)
    for turn in range(2):
        rows.where(F.col("arrival_seq") % 2 == turn).write.mode("append").parquet(src)
        jobs.timeline_pipeline(spark.readStream.schema(rows.schema).parquet(src), root)
    out = spark.read.parquet(f"{root}/silver")
    return out.select("event_id", "arrival_seq", "trust", F.col("date_key").cast("string").alias("date_key"))


def _windows(spark, sf_dir, name, *widths):
    feed = arrivals(stream_rows(prepare(spark), sf_dir).select("ts", "event_type"), name)
    rows = jobs.collect_table(jobs.tumbling_counts(feed, "ts", F.col("event_type"), *widths), name + "-out")
    return rows.where("key is not null").select("key", F.col("from_ts").cast("timestamp_ntz").alias("from_ts"), "n_events")


def stream_rollup(spark, sf_dir):
    return _windows(spark, sf_dir, "rollup", "1 day")


def stream_sliding(spark, sf_dir):
    return _windows(spark, sf_dir, "sliding", "6 hours", "3 hours")


QUERIES = {f.__name__: f for f in (stream_focus, stream_long_runs, stream_days, stream_rollup, stream_sliding)}
