"""Structured Streaming forms of the jobs.

Bounded-state operators use a watermark.  The timeline does not: an event may be late by any
time, so new rows are appended and only the days they touch are built again.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.dates import date_key, effective_ts
from ..operators import gate, timeline
from ..session import SPLIT_ROWS, materialize, shuffles_for, work_dir
from ..sinks.store import append_events, load_state, save_state
from ..sources.log import parse_lines, split_corrupt
from ..sources.reports import classify, report_texts
from .ordered_state import ROCKS


def run(query_of: Callable, *, once: bool, every: str = "5 seconds") -> StreamingQuery:
    """Start a writer: everything available now and stop, or keep polling."""
    writer = query_of.trigger(availableNow=True) if once else query_of.trigger(processingTime=every)
    return writer.start()


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings with these values; afterwards as they were."""
    own = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in own.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


#: Reading and writing of whole events: small splits, as packed bytes unfold to some thirty times as much and a day's files are small;
#: no generated method too large for the JVM to compile.
WHOLE_EVENTS = {"spark.sql.files.maxPartitionBytes": "8m", "spark.sql.files.openCostInBytes": "256k", "spark.sql.codegen.hugeMethodLimit": "8000"}


@contextlib.contextmanager
def state_partitions(spark: SparkSession) -> Iterator[None]:
    """Streams that start here keep their state in at most two partitions a core.

    A state partition is a store of its own that lives as long as the stream; more of them than the
    cluster can work on only cost time in every batch.
    """
    name, own = "spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set(name, min(int(own), 2 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(name, own)


def read_log_stream(spark: SparkSession, path: str) -> DataFrame:
    """Row log as a stream of events; lines that do not parse are left out."""
    return split_corrupt(parse_lines(spark.readStream.text(path)))[0]


def read_report_stream(spark: SparkSession, path: str, archive: str | None = None) -> DataFrame:
    """Drop folder of report files; processed files move to ``archive`` when it is given."""
    reader = spark.readStream.option("pathGlobFilter", "*.json")
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    files = reader.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file_name"))
    return report_texts(files)


def union_sources(*streams: DataFrame) -> DataFrame:
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def gate_stream(events: DataFrame, roots, root: str, checkpoint: str, *, passed_at: str, **options):
    """Gate every micro-batch and append to the stores; a batch that is repeated replaces its own rows.

    Its counts go to the table of metrics beside the stores, one row a batch.
    """
    def write(batch: DataFrame, number: int) -> None:
        gated = materialize(gate.gate(batch, roots, passed_at=passed_at, **options), "gated")
        append_events(gated, root, f"stream-{number}")
        counts = gated.agg(F.count("*").alias("rows"), F.count_if(F.col("drop_reason").isNotNull()).alias("dropped"), F.count_if(F.size("privacy.redactions") > 0).alias("redacted"))
        counts.withColumn("at", F.current_timestamp()).write.mode("overwrite").parquet(f"{root}/metrics/batch_id={number}")
    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def trust_stream(reports: DataFrame, root: str, checkpoint: str, *, now: str, trusted: list[str] | None = None):
    """Classify reports and file them by verdict; nothing is dropped."""
    judged = classify(reports, now=now, trusted=trusted)
    return judged.writeStream.format("parquet").partitionBy("trust").option("path", root).option("checkpointLocation", checkpoint)


def dedup_stream(events: DataFrame, delay: str = "1 day", ts: str = "effective_ts") -> DataFrame:
    """Drop retries of an event id inside the watermark.  The trust-aware choice is ``rebuild_days``."""
    return events.where(F.col(ts).isNotNull()).withWatermark(ts, delay).dropDuplicatesWithinWatermark(["event_id"])


def tumbling_counts(events: DataFrame, ts: str, key: Column, width: str = "1 day", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Counts per key and window (tumbling, or sliding with ``slide``).

    In append mode a window is out, once and for all, when the watermark has passed its end; only open windows are state.
    """
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.withWatermark(ts, delay).groupBy(w.alias("w"), key.alias("key")).agg(F.count("*").alias("n_events")) \
        .select("key", F.col("w.start").alias("from_ts"), "n_events")


def gap_session_stream(events: DataFrame, ts: str, key: str, gap: str, delay: str) -> DataFrame:
    """Gap sessions.  In append mode a session is out when the watermark has passed its end."""
    w = F.session_window(ts, gap)
    return events.withWatermark(ts, delay).groupBy(w.alias("w"), key).agg(
        F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("n_events")).drop("w")


def rebuild_days(bronze: str, silver: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch``: store raw rows, then rebuild the touched days of the timeline.

    An id can lie in several days (a retry with another clock), so every day that shares an
    id with the new rows is rebuilt as well.  A small table of ids and their days tells which
    days to read; it is grouped once, to the distinct sets of days that an id lies in.  A batch owns its
    folder, so one that runs twice after a failure stores its rows once, with or without ids.
    """
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession

        def put(rows: DataFrame, path: str, *by: str) -> None:
            rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*by).parquet(f"{path}/batch_id={number}")
        keyed = batch.withColumn("date_key", date_key("ts_wall"))
        put(keyed, f"{bronze}/rows", "date_key")
        # a stream switches the putting together of shuffle partitions off; none of these tables is state
        with settings(spark, {"spark.sql.adaptive.enabled": "true"}):
            stored = spark.read.schema(keyed.schema).parquet(f"{bronze}/rows/batch_id={number}")
            put(stored.where("event_id <> ''").select("event_id", "date_key").distinct(), f"{bronze}/days")
            known = spark.read.schema("event_id STRING, date_key STRING, batch_id BIGINT").parquet(f"{bronze}/days")
            shuffles_for(spark, -(-known.count() // SPLIT_ROWS))
            fresh = F.max(F.col("batch_id") == number).alias("fresh")
            sets = known.groupBy("event_id").agg(F.array_sort(F.collect_set("date_key")).alias("days"), fresh)
            sets = materialize(sets.groupBy("days").agg(F.max("fresh").alias("fresh")), "day-sets")
            sharing = sets.where("fresh").select(F.explode("days").alias("date_key"))
            days = materialize(stored.select("date_key").unionByName(sharing).distinct(), "days")
            linked = sets.select("days", F.explode("days").alias("date_key")).join(days, "date_key", "left_semi").select(F.explode("days").alias("date_key"))
            reach = materialize(linked.unionByName(days).distinct(), "reach")
            log = spark.read.schema(keyed.schema).parquet(f"{bronze}/rows").drop("batch_id").join(reach, "date_key", "left_semi")
            shuffles_for(spark, -(-log.count() // SPLIT_ROWS))
            rows = timeline.dedup_winners(timeline.drop_rejected(log)).join(days, "date_key", "left_semi")
            out = rows.withColumn("effective_ts", effective_ts("ts_wall", "clock_offset_sec"))
            out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date_key").parquet(silver)
    return write


def touched_days(log: DataFrame) -> DataFrame:
    """Stream of ``(day, hub)`` for update mode: the days whose timeline new rows can change, found by a look-up of their ids.

    State holds the days of each id, and one row a day for all rows without an id.  A batch looks up its own ids,
    however long the history, and gives every day of them with the first one as hub.  Days under one hub share an id.
    """
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    named = F.coalesce(F.col("event_id"), F.lit("")) != ""
    known = log.groupBy(named.alias("named"), F.when(named, F.col("event_id")).otherwise(F.col("date_key")).alias("id")).agg(F.collect_set("date_key").alias("days"))
    return known.select(F.explode("days").alias("day"), F.array_min("days").alias("hub"))


def rebuild_touched(bronze: str, schema: T.StructType, silver: str, links: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` over ``touched_days``: build these days again from the days that share an id with them.

    ``links`` holds the pairs of day and hub, at most a few for each day; a version is written when a pair is new.
    """
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        pairs = materialize(batch.distinct(), "touched")
        old = load_state(spark, links)
        fresh = pairs if old is None else pairs.join(old, ["day", "hub"], "left_anti")
        if not fresh.isEmpty():
            grown = materialize(fresh if old is None else old.unionByName(fresh), "links")
            # the number names the version: a batch that runs again adds nothing new
            save_state(grown, links, number)
        known = load_state(spark, links)
        if known is None:
            return
        days = materialize(pairs.select(F.col("day").alias("date_key")).distinct(), "days")
        hubs = known.join(days, known["day"] == days["date_key"], "left_semi").select("hub").distinct()
        reach = known.join(hubs, "hub", "left_semi").select(F.col("day").alias("date_key")).distinct()
        log = spark.read.schema(schema).parquet(bronze)
        rows = timeline.dedup_winners(timeline.drop_rejected(log.join(reach, "date_key", "left_semi"))).join(days, "date_key", "left_semi")
        out = materialize(rows.withColumn("effective_ts", effective_ts("ts_wall", "clock_offset_sec")), "silver")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date_key").parquet(silver)
    return write


def timeline_pipeline(events: DataFrame, root: str, *, once: bool = True) -> list[StreamingQuery]:
    """Three streams in a row: raw log by day, touched days by a look-up of ids, and the days built again.

    Each reads what the one before has committed; with ``once`` each ends before the next begins.
    """
    spark = events.sparkSession
    keyed = events.withColumn("date_key", date_key("ts_wall"))
    bronze, touched = f"{root}/bronze", f"{root}/touched"

    def start(writer, name: str) -> StreamingQuery:
        with state_partitions(spark):
            query = run(writer.option("checkpointLocation", f"{root}/state-{name}"), once=once)
            if once:
                query.awaitTermination()
        return query
    stored = start(keyed.writeStream.format("parquet").partitionBy("date_key").option("path", bronze), "bronze")
    # a folder is a partition of text, whatever its name looks like
    log = spark.readStream.schema(keyed.schema).parquet(bronze)

    def put(batch: DataFrame, number: int) -> None:
        # a batch that runs again writes its own folder again
        batch.distinct().write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{touched}/batch-{number}")
    found = start(touched_days(log).writeStream.outputMode("update").foreachBatch(put), "touched")
    pairs = spark.readStream.schema("day STRING, hub STRING").parquet(f"{touched}/batch-*")
    built = start(pairs.writeStream.foreachBatch(rebuild_touched(bronze, keyed.schema, f"{root}/silver", f"{root}/links")), "silver")
    return [stored, found, built]


def with_metrics(gated: DataFrame, name: str = "gate") -> DataFrame:
    """Count rows, drops and redacted rows while they pass; read back with ``progress_rows``."""
    return gated.observe(
        name, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("drop_reason").isNotNull()).alias("dropped"),
        F.count_if(F.size("privacy.redactions") > 0).alias("redacted"))


def metric_rows(spark: SparkSession, root: str) -> DataFrame:
    """``batch_id, rows, dropped, redacted, at`` of every batch that a gate stream has stored."""
    return spark.read.schema("rows bigint, dropped bigint, redacted bigint, at timestamp, batch_id bigint").parquet(f"{root}/metrics")


def progress_rows(query: StreamingQuery, name: str = "gate") -> list[tuple[str, int, dict]]:
    """``(heartbeat, batch, metrics)`` of the batches a query remembers, ready for a table."""
    out = []
    for p in query.recentProgress:
        seen = p["observedMetrics"].get(name)
        out.append((p["timestamp"], p["batchId"], seen.asDict() if seen is not None else {}))
    return out


# --- state per key -----------------------------------------------------------------

class KeepSpaced(StatefulProcessor):
    """Coalesce changes of a path: one number of state, the last kept instant.

    A path's changes of one micro-batch are held as two arrays of numbers; the fold jumps from one kept
    change to the next.
    """

    def __init__(self, spacing_us: int):
        self.spacing_us = spacing_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", T.StructType([T.StructField("us", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = [(part["us"].to_numpy(np.int64), part["arrival_seq"].to_numpy()) for part in rows]
        us, seq = (np.concatenate(column) for column in zip(*frames, strict=True))
        order = np.lexsort((seq, us))
        us, seq = us[order], seq[order]
        at = int(np.searchsorted(us, self.last.get()[0] + self.spacing_us)) if self.last.exists() else 0
        kept = []
        while at < len(us):
            kept.append(at)
            at = int(np.searchsorted(us, us[at] + self.spacing_us))
        if kept:
            self.last.update((int(us[kept[-1]]),))
        for low in range(0, len(kept), 10_000):
            some = kept[low:low + 10_000]
            yield pd.DataFrame({"path": key[0], "us": us[some], "arrival_seq": seq[some]})

    def close(self) -> None:
        pass


def coalesce_stream(changes: DataFrame, spacing_sec: float) -> DataFrame:
    """``path, us, arrival_seq`` in, the kept rows out."""
    rows = changes.select("path", "us", "arrival_seq")
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return rows.groupBy("path").transformWithStateInPandas(
        statefulProcessor=KeepSpaced(int(spacing_sec * 1_000_000)), outputStructType=rows.schema,
        outputMode="append", timeMode="none")


def collect_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is available and return the result as a table."""
    spark = stream.sparkSession
    path, checkpoint = work_dir(spark, name), work_dir(spark, name + "-state")
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", path)
    else:
        def write(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(path)
        writer = stream.writeStream.outputMode(mode).foreachBatch(write)
    with state_partitions(spark):
        run(writer.option("checkpointLocation", checkpoint), once=True).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
