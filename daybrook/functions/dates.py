"""Instants, date keys, labels and periods.

Two rules of time live side by side: ordering uses the instant (a text without a zone is
UTC), filing uses the calendar date written in the text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import ColumnLike, bind, col, to_double

_ISO = (
    r"^\d{4}-\d{2}-\d{2}"
    r"(T\d{2}(:\d{2}(:\d{2}(\.\d+)?)?)?(Z|[+-]\d{2}(:?\d{2}(:?\d{2})?)?)?)?$"
)


def _canonical(ts: Column) -> Column:
    """Compact and blank-separated forms rewritten to ``yyyy-mm-ddThh:mm:ss``."""
    ts = F.regexp_replace(ts, r"^(\d{4})(\d{2})(\d{2})(?=\D|$)", "$1-$2-$3")
    ts = F.regexp_replace(ts, r"^(\d{4}-\d{2}-\d{2})[^\d](?=\d{2})", "$1T")
    ts = F.regexp_replace(ts, r"^(.{10}T\d{2})(\d{2})(?=\d|$|[Z+-])", "$1:$2")
    ts = F.regexp_replace(ts, r"^(.{10}T\d{2}:\d{2})(\d{2})(?=\D|$)", "$1:$2")
    return F.regexp_replace(ts, r"^(.{10}T\d{2}:\d{2}:\d{2}),(?=\d)", "$1.")


def instant(ts: ColumnLike) -> Column:
    """ISO-8601 text to an instant; no zone means UTC, junk means null."""
    def parse(c: Column) -> Column:
        full = F.regexp_replace(c, r"T(\d{2})(?=$|[Z+-])", "T$1:00")
        full = F.regexp_replace(full, r"T(\d{2}:\d{2})(?=$|[Z+-])", "T$1:00")
        zoned = F.when(full.rlike(r"T.*(Z|[+-]\d{2}(:?\d{2}(:?\d{2})?)?)$"), full) \
            .when(full.contains("T"), F.concat(full, F.lit("Z"))) \
            .otherwise(F.concat(full, F.lit("T00:00:00Z")))
        return F.when(c.rlike(_ISO), zoned.try_cast("timestamp"))
    return bind(_canonical(col(ts)), parse)


def effective_ts(ts: ColumnLike, offset_sec: ColumnLike) -> Column:
    """Instant corrected by the source's clock offset."""
    micros = F.round(to_double(offset_sec) * 1e6).cast("bigint")
    return F.timestamp_micros(F.unix_micros(instant(ts)) - micros)


def date_key(ts: ColumnLike) -> Column:
    """Local calendar date as ``yyyymmdd``; no zone shift, junk kept readable."""
    c = col(ts)
    compact = c.rlike(r"^\d{8}(\D|$)") & instant(c).isNotNull()
    head = F.replace(F.substring(c, 1, 10), F.lit("-"), F.lit(""))
    return F.when(compact, F.substring(c, 1, 8)) \
        .when(head != "", head).otherwise(F.lit("00000000"))


def _is_key(key: Column) -> Column:
    return key.rlike(r"^\d{8}$")


def date_of_key(key: ColumnLike) -> Column:
    k = col(key)
    text = F.concat_ws("-", F.substring(k, 1, 4), F.substring(k, 5, 2), F.substring(k, 7, 2))
    return F.when(_is_key(k), text.try_cast("date"))


def date_label(key: ColumnLike) -> Column:
    k = col(key)
    text = F.concat_ws("-", F.substring(k, 1, 4), F.substring(k, 5, 2), F.substring(k, 7, 2))
    return F.when(_is_key(k), text).otherwise(k)


def hhmm(ts: ColumnLike) -> Column:
    c = col(ts)
    return F.when(F.length(c) >= 16, F.substring(c, 12, 5)).otherwise(c)


def period_key(key: ColumnLike, granularity: str) -> Column:
    """``yyyy-mm`` for a month, ISO ``yyyy-Www`` for a week."""
    k = col(key)
    if granularity == "month":
        month = F.concat_ws("-", F.substring(k, 1, 4), F.substring(k, 5, 2))
        return F.when(_is_key(k), month).otherwise(F.lit("0000-00"))
    d = date_of_key(k)
    week = F.concat(
        F.lpad(F.extract(F.lit("YEAROFWEEK"), d).cast("string"), 4, "0"), F.lit("-W"),
        F.lpad(F.weekofyear(d).cast("string"), 2, "0"))
    return F.coalesce(week, F.lit("0000-W00"))


def span_days(first_key: ColumnLike, last_key: ColumnLike) -> Column:
    """Days from first to last, both counted; 1 when either is junk."""
    return F.coalesce(F.datediff(date_of_key(last_key), date_of_key(first_key)) + 1, F.lit(1))


def period_label(key: ColumnLike, granularity: str) -> Column:
    return F.concat(F.lit("week " if granularity == "week" else "month "), col(key))


def duration_text(seconds: ColumnLike) -> Column:
    """``1h35m``, ``40m``."""
    mins = F.floor(F.greatest(col(seconds).cast("bigint"), F.lit(0)) / 60)
    hours = F.floor(mins / 60)
    rest = (mins % 60).cast("int")
    return F.when(hours > 0, F.format_string("%dh%02dm", hours, rest)) \
        .otherwise(F.format_string("%dm", rest))


def since_ts(note: ColumnLike, ref_ts: ColumnLike) -> Column:
    """``since 2pm`` / ``since 14:30`` read against a reference time, as wall-clock text.

    A clock time later than the reference belongs to the day before.  The reference is an
    ISO text; its date, its zone suffix and its shape are kept.
    """
    def parts(raw: Column) -> Column:
        hour = F.regexp_extract(raw, r"^(\d{1,2})", 1).try_cast("int")
        minute = F.coalesce(F.regexp_extract(raw, r":(\d{2})", 1).try_cast("int"), F.lit(0))
        half = F.regexp_extract(raw, r"(am|pm)$", 1)
        h24 = F.when((half == "") & hour.between(0, 23), hour) \
            .when((half == "am") & hour.between(1, 12), hour % 12) \
            .when((half == "pm") & hour.between(1, 12), hour % 12 + 12)
        return F.when(h24.isNotNull() & minute.between(0, 59), h24 * 60 + minute)

    raw = F.lower(F.regexp_replace(
        F.regexp_extract(col(note), SINCE_PATTERN, 1), " ", ""))
    ref = _canonical(col(ref_ts))
    wall = F.substring(ref, 1, 19).try_cast("timestamp_ntz")
    zone = F.regexp_extract(ref, r"(Z|[+-]\d{2}:?\d{2})$", 1)
    suffix = F.when(zone == "Z", F.lit("+00:00")).otherwise(zone)

    def build(v: Column) -> Column:
        day = F.date_trunc("DAY", v["wall"]).cast("timestamp_ntz")
        at = day + F.make_dt_interval(F.lit(0), F.lit(0), v["minutes"], F.lit(0))
        later = F.when(at > v["wall"], at - F.expr("INTERVAL 1 DAY")).otherwise(at)
        return F.concat(F.date_format(later, "yyyy-MM-dd'T'HH:mm:ss"), v["suffix"])

    value = F.struct(parts(raw).alias("minutes"), wall.alias("wall"), suffix.alias("suffix"))
    return bind(value, lambda v: F.when(v["minutes"].isNotNull() & v["wall"].isNotNull(), build(v)))


# Fixed value: the phrase that moves a note back in time.
SINCE_PATTERN = r"(?i)\bsince[\s\x1c-\x1f\x85\p{Z}]+([0-9]{1,2}(?::[0-9]{2})?[\s\x1c-\x1f\x85\p{Z}]*(?:am|pm)?)\b"


def without_since(note: ColumnLike) -> Column:
    """The note without the phrase, cleaned at both ends."""
    c = col(note)
    cut = F.regexp_replace(c, SINCE_PATTERN, "")
    return F.when(c.rlike(SINCE_PATTERN), F.regexp_replace(cut, r"^[ \-,;]+|[ \-,;]+$", "")) \
        .otherwise(F.trim(c))
