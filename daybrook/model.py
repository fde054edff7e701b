"""The event: one nested row shape for every source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .constants import EVENT_TYPES, SCHEMA_VERSION, SOURCE_KINDS, TRUST_LEVELS
from .functions.core import col, has_text, non_null, once, to_double
from .functions.dates import date_key, effective_ts, instant

_TEXT, _TEXTS = T.StringType(), T.ArrayType(T.StringType())


def _record(*texts: str, **others: T.DataType) -> T.StructType:
    """A struct of text fields followed by fields of other types."""
    return T.StructType([*[T.StructField(t, _TEXT) for t in texts],
                         *[T.StructField(n, d) for n, d in others.items()]])


# Numbers from outside are read as text and cast with ``try_cast`` where they are used.
PAYLOAD = T.StructType([
    *_record("anchor", "process", "active_file", satellites=T.ArrayType(_record("title", "process"))).fields,
    *_record("duration_sec", "activity_score", "mouse_score", "saves", "kps", "mode",
             intent=_record("label", "method", "confidence")).fields,
    *_record("ended", "started", "idle_after_sec", "away_sec", "pid", "cmdline", "cwd", "command", "cpu_peak",
             "unattended", "path", "action", "actor", "repo", "author", "message", files=_TEXTS).fields,
    *_record("body", "diffstat", "diff", "diff_ref", "diff_lines", "diff_truncated", "note", "meaningful",
             "retroactive_since", "content", "kind", "length", "host", "preview", "summary", "tool",
             "project_hint", "status", "rejected", "claimed_type", trust_reasons=_TEXTS, reasons=_TEXTS).fields,
    *_record("sha", "pr_number", "state", "url", "conclusion", "kind_detail",
             "file_contents", "text_full", "snippet_full").fields,
])
EVENT = T.StructType([
    *_record("event_id", "schema_version", source=_record("kind", "adapter", "identity", "session_id")).fields,
    *_record("ts_wall", "recv_ts", "clock_offset_sec", "type", payload=PAYLOAD,
             extras=T.MapType(T.StringType(), T.StringType()),
             attribution=T.StructType([T.StructField("project_id", _TEXT), T.StructField("confidence", T.DoubleType()),
                                       T.StructField("method", _TEXT)]),
             privacy=T.StructType([T.StructField("gate_version", _TEXT), T.StructField("redactions", _TEXTS),
                                   T.StructField("passed_at", _TEXT)]),
             trust=_TEXT).fields,
])
PAYLOAD_TYPE: T.StructType = EVENT["payload"].dataType
PAYLOAD_FIELDS = tuple(PAYLOAD_TYPE.fieldNames())


def payload_of(**fields: Column) -> Column:
    """A payload with the given fields, every other field null."""
    return F.struct(*[
        (fields[f.name] if f.name in fields else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in PAYLOAD_TYPE.fields])


def source_of(kind, adapter, identity="", session_id="") -> Column:
    def c(v):
        return v if isinstance(v, Column) else F.lit(v)
    return F.struct(c(kind).alias("kind"), c(adapter).alias("adapter"),
                    c(identity).alias("identity"), c(session_id).alias("session_id"))


def make_events(df: DataFrame, *, type: Column, source: Column, ts_wall: Column, payload: Column,
                recv_ts: Column | None = None, event_id: Column | None = None,
                clock_offset_sec: Column | None = None, trust: Column | None = None,
                method: Column | None = None, confidence: Column | None = None,
                extras: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Project any table to events.  A missing id is a content hash: re-runs are stable."""
    none = F.lit(None)
    stable = F.sha2(F.to_json(F.struct(
        type.alias("type"), ts_wall.alias("ts"), source.alias("source"), payload.alias("payload"))), 256)
    values = {
        "event_id": stable if event_id is None else event_id,
        "schema_version": F.lit(SCHEMA_VERSION),
        "source": source,
        "ts_wall": ts_wall,
        "recv_ts": F.lit("") if recv_ts is None else recv_ts,
        "clock_offset_sec": F.lit(0) if clock_offset_sec is None else clock_offset_sec,
        "type": type,
        "payload": payload,
        "extras": none if extras is None else extras,
        "attribution": F.struct(
            F.lit(None).cast("string").alias("project_id"),
            (F.lit(0.0) if confidence is None else confidence).cast("double").alias("confidence"),
            (none if method is None else method).cast("string").alias("method")),
        "privacy": none,
        "trust": F.lit("validated") if trust is None else trust,
    }
    return df.select(*[values[f.name].cast(f.dataType).alias(f.name) for f in EVENT.fields],
                     *[F.col(k) for k in keep])


def with_keys(events: DataFrame) -> DataFrame:
    """Add ``effective_ts`` (ordering) and ``date_key`` (filing)."""
    return once(events, effective_ts=effective_ts("ts_wall", "clock_offset_sec"), date_key=date_key("ts_wall"))


def validation_messages(version="schema_version", type="type", kind="source.kind",
                        adapter="source.adapter", ts_wall="ts_wall", trust="trust",
                        is_object: Column | None = None, source_is_object: Column | None = None,
                        payload_is_object: Column | None = None) -> Column:
    """What is wrong with an envelope, as messages in a fixed order; empty when valid."""
    yes = F.lit(True)
    obj = yes if is_object is None else is_object
    src = col("source").isNotNull() if source_is_object is None else source_is_object
    pay = yes if payload_is_object is None else payload_is_object

    def unless(ok: Column, message: str) -> Column:
        return F.when(~F.coalesce(ok, F.lit(False)), F.lit(message))

    def one_of(values) -> str:
        return "[" + ", ".join(f"'{v}'" for v in sorted(values)) + "]"

    ts = col(ts_wall)
    checks = non_null(
        unless(col(version).try_cast("double") == SCHEMA_VERSION, f"schema_version must be {SCHEMA_VERSION}"),
        unless(col(type).isin(list(EVENT_TYPES)), f"type must be one of {one_of(EVENT_TYPES)}"),
        unless(src, "source must be an object"),
        F.when(src, unless(col(kind).isin(list(SOURCE_KINDS)), f"source.kind must be one of {one_of(SOURCE_KINDS)}")),
        F.when(src, unless(has_text(adapter), "source.adapter is required")),
        unless(has_text(ts), "ts_wall is required (ISO-8601 string)"),
        F.when(has_text(ts), unless(instant(ts).isNotNull(), "ts_wall is not a valid ISO-8601 timestamp")),
        unless(pay, "payload must be an object"),
        unless(F.coalesce(col(trust), F.lit("validated")).isin(list(TRUST_LEVELS)),
               f"trust must be one of {one_of(TRUST_LEVELS)}"),
    )
    return F.when(obj, checks).otherwise(F.array(F.lit("event must be an object")))


def to_log_json(events: DataFrame) -> DataFrame:
    """Serialise for the row log: null payload fields and transient ``_`` keys left out."""
    extras = F.map_filter("extras", lambda k, v: ~k.startswith("_"))
    cols = [F.coalesce(extras, F.create_map().cast("map<string,string>")).alias("extras")
            if f.name == "extras" else F.col(f.name) for f in EVENT.fields]
    return events.select(F.to_json(F.struct(*cols)).alias("value"))


__all__ = ["EVENT", "PAYLOAD_FIELDS", "PAYLOAD_TYPE", "payload_of", "source_of", "make_events",
           "with_keys", "validation_messages", "to_log_json", "to_double"]
