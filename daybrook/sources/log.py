"""The row log: JSON lines, one event a line, filed by local date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import EVENT, PAYLOAD_FIELDS

_LINE = T.StructType([f for f in EVENT.fields if f.name != "extras"])


def parse_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Lines to events.  Adds ``_corrupt`` with the line when it is no JSON object.

    Unknown payload keys are kept as text in ``extras``.
    """
    schema = T.StructType([*_LINE.fields, T.StructField("_corrupt", T.StringType())])
    parsed = lines.where(F.trim(value) != "").select("*", F.from_json(
        value, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("e"))
    raw = F.from_json(F.get_json_object(value, "$.payload"), "MAP<STRING,STRING>")
    extras = F.map_filter(raw, lambda k, v: ~k.isin(list(PAYLOAD_FIELDS)) & ~k.startswith("_"))
    others = [c for c in lines.columns if c != value]
    shaped = [extras.alias("extras") if f.name == "extras" else F.col(f"e.{f.name}").alias(f.name) for f in EVENT.fields]
    return parsed.select(*others, *shaped, F.col("e._corrupt").alias("_corrupt"))


def with_defaults(events: DataFrame) -> DataFrame:
    """Fill what a loader fills: empty texts, default trust and version, a stable id."""
    blank = F.lit("")
    src = F.struct(*[F.coalesce(F.col(f"source.{n}"), blank).alias(n) for n in ("kind", "adapter", "identity", "session_id")])
    stable = F.sha2(F.to_json(F.struct("type", "ts_wall", "source", "payload")), 256)
    return events.withColumns({
        "type": F.coalesce("type", blank), "ts_wall": F.coalesce("ts_wall", blank), "recv_ts": F.coalesce("recv_ts", blank),
        "source": src, "trust": F.coalesce("trust", F.lit("validated")),
        "schema_version": F.coalesce("schema_version", F.lit("2")), "event_id": F.coalesce("event_id", stable),
    })


def read_log(spark: SparkSession, path: str, *, date_key: str | None = None) -> DataFrame:
    """Events of a log folder, of one date file, or of one file; bad lines have ``_corrupt``.

    ``arrival_seq`` is not stored in foreign files; the file name and a content hash stand
    in for it where order of arrival decides.
    """
    target = f"{path.rstrip('/')}/{date_key}.jsonl" if date_key else path
    lines = spark.read.text(target).select("value", F.col("_metadata.file_name").alias("file_name"))
    return parse_lines(lines)


def split_corrupt(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good events and the quarantine."""
    good = parsed.where(F.col("_corrupt").isNull()).drop("_corrupt")
    return good, parsed.where(F.col("_corrupt").isNotNull()).select("_corrupt")
