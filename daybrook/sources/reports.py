"""Reports of outside agents: parsing, validation and trust."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import FUTURE_TOLERANCE
from ..functions.core import bind, blank_to_null, non_null, once, strings
from ..functions.dates import instant
from ..model import EVENT, PAYLOAD_TYPE, make_events, payload_of, source_of, validation_messages
from .log import parse_lines, with_defaults

_SHAPE = T.MapType(T.StringType(), T.StringType())


def report_texts(files: DataFrame, value: str = "value", name: str = "file_name") -> DataFrame:
    """One JSON text per report.  A file holds one object or a list; ``unreadable`` marks junk."""
    named = files.select(F.col(name).alias("file_name"), F.col(value).alias("_value"))
    trimmed = once(named, _text=F.trim(F.regexp_replace("_value", r"^\s+|\s+$", "")))
    text = F.col("_text")
    checked = once(trimmed, _ok=F.try_parse_json(text).isNotNull())
    items = F.when(F.col("_ok") & text.startswith("["), F.from_json(text, "ARRAY<STRING>")).otherwise(F.array(text))
    return checked.select("file_name", (~F.col("_ok")).alias("unreadable"), F.explode(items).alias("report"))


def read_drop_folder(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
    return report_texts(files.select("value", F.col("_metadata.file_name").alias("file_name")))


def classify(reports: DataFrame, *, now: str, trusted: list[str] | None = None,
             future_sec: float = FUTURE_TOLERANCE) -> DataFrame:
    """Reports to events with a verdict: validated, low_trust or rejected; nothing is dropped.

    The sender's own ``trust`` and ``privacy`` are ignored.  A rejected report becomes a stub
    that carries the messages and none of the content.  ``trusted``: null or empty means the
    identity is not checked.
    """
    def kind_of(path: str) -> Column:
        return F.coalesce(F.schema_of_variant(F.try_variant_get("_v", path, "variant")), F.lit("VOID"))

    parsed = with_kinds(once(reports, _v=F.try_parse_json("report")), kind_of).drop("_v")
    lines = parse_lines(parsed.withColumn("value", F.col("report")))
    version = F.when(~F.coalesce(F.col("_has_version"), F.lit(False)), F.lit("2")).otherwise(F.col("schema_version"))
    messages = validation_messages(
        version, "type", "source.kind", "source.adapter", F.when(F.col("_ts_text"), F.col("ts_wall")), F.lit("validated"),
        is_object=F.col("_object"), source_is_object=F.col("_source_object"), payload_is_object=F.col("_payload_object"))
    checked = once(lines, _errors=F.when(F.col("unreadable"), F.array(F.lit("unreadable_report_file"))).otherwise(messages))
    now_at = instant(F.lit(now))
    zoned = F.col("ts_wall").rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    shift = F.regexp_extract(F.lit(now), r"(Z|[+-]\d{2}:?\d{2})$", 1)
    # A time without a zone is read in the zone of "now".
    at = instant(F.when(zoned | (shift == ""), F.col("ts_wall")).otherwise(F.concat("ts_wall", shift)))
    reasons = non_null(
        F.when(F.col("source.kind") != "agent", F.lit("source_kind_not_agent")),
        F.when(~F.col("source.identity").isin(trusted), F.lit("unknown_identity")) if trusted else F.lit(None).cast("string"),
        bind(at, lambda t: F.when(t.isNull(), F.lit("unparseable_ts_wall")).when(
            F.unix_micros(t) > F.unix_micros(now_at) + int(future_sec * 1e6), F.lit("future_timestamp"))))
    judged = once(with_defaults(checked), _reasons=reasons)
    bad = F.size("_errors") > 0
    suspect = F.size("_reasons") > 0
    ident = F.when(F.col("unreadable"), F.col("file_name")).when(
        F.col("_source_object"), F.substring(F.col("source.identity"), 1, 80)).otherwise(F.lit(""))
    stub_payload = payload_of(rejected=F.lit("true"), reasons=F.col("_errors"),
                              claimed_type=F.substring(F.when(F.col("_object"), F.col("type")).otherwise(F.lit("")), 1, 40))
    marked = F.col("payload").withField("trust_reasons", F.when(suspect, F.col("_reasons")).otherwise(F.col("payload.trust_reasons")))
    empty = F.lit(None).cast(PAYLOAD_TYPE)
    out = {
        "event_id": F.when(bad, F.sha2(F.concat_ws("|", F.lit("rejected"), "report"), 256)).otherwise(F.col("event_id")),
        "schema_version": F.lit("2"),
        "source": F.when(bad, source_of("agent", "agent_ingest", ident)).otherwise(F.col("source")),
        "ts_wall": F.when(bad, F.lit(now)).otherwise(F.col("ts_wall")),
        "recv_ts": F.lit(now),
        "type": F.when(bad, F.lit("AGENT_REPORT")).otherwise(F.col("type")),
        "payload": F.when(bad, stub_payload).otherwise(F.coalesce(marked, F.when(suspect, payload_of(
            trust_reasons=F.col("_reasons"))).otherwise(payload_of()), empty)),
        "extras": F.when(bad, F.lit(None)).otherwise(F.col("extras")),
        "attribution": F.lit(None).cast(EVENT["attribution"].dataType),
        "privacy": F.lit(None).cast(EVENT["privacy"].dataType),
        "trust": F.when(bad, F.lit("rejected")).when(suspect, F.lit("low_trust")).otherwise(F.lit("validated")),
    }
    keep = [c for c in reports.columns if c not in ("report", "unreadable")]
    return judged.select(*[out.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in EVENT.fields], *keep)


def with_kinds(reports: DataFrame, kind_of) -> DataFrame:
    """What the parts of a report are, read from the JSON itself."""
    def is_object(kind: Column) -> Column:
        return kind.startswith("OBJECT")
    kinds = once(reports, _k=F.struct(kind_of("$").alias("all"), kind_of("$.source").alias("source"),
                                      kind_of("$.payload").alias("payload"), kind_of("$.ts_wall").alias("ts"),
                                      kind_of("$.schema_version").alias("version")))
    k = F.col("_k")
    return kinds.withColumns({
        "_object": is_object(k["all"]), "_source_object": is_object(k["source"]),
        "_payload_object": is_object(k["payload"]) | ((k["payload"] == "VOID") & F.get_json_object("report", "$.payload").isNull()),
        "_ts_text": k["ts"] == "STRING", "_has_version": k["version"] != "VOID",
    }).drop("_k")


def build_reports(rows: DataFrame) -> DataFrame:
    """Report rows (``summary, tool, identity, session_id, repo, files, project, status,
    ts_wall``) to events, as an agent would send them."""
    payload = payload_of(summary=F.col("summary"), tool=F.col("tool"), files=F.when(F.size("files") > 0, F.col("files")),
                         repo=blank_to_null("repo"), project_hint=blank_to_null("project"), status=blank_to_null("status"))
    source = source_of(F.lit("agent"), F.coalesce(blank_to_null("tool"), F.lit("agent_sdk")), F.col("identity"),
                       F.coalesce("session_id", F.lit("")))
    return make_events(rows, type=F.lit("AGENT_REPORT"), source=source, ts_wall=F.col("ts_wall"), payload=payload)


__all__ = ["classify", "report_texts", "read_drop_folder", "build_reports", "strings"]
