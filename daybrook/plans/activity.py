"""Activity view over the warehouse tables: every row of ``events`` becomes one event or two.

Types, hosts, clocks, trust and payloads follow from the row's own columns, so the view
grows with the table.  About one row in seven was sent twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import make_events, payload_of, source_of
from ..session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Registry of the activity view: eight code roots, remotes, words and apps in four projects.
PROJECTS = [
    {"id": "atlas", "name": "Atlas", "description": "Map service",
     "signals": {"paths": ["/home/dev/code/p0", "C:\\Users\\dev\\code\\p1"], "git_remotes": ["github.com/acme/atlas"],
                 "jira_prefixes": ["ATL"], "keywords": ["atlas", "map"], "apps": ["qgis.exe"],
                 "domains": ["atlas.example.com"], "window_patterns": [".*atlas board.*"]}},
    {"id": "borealis", "name": "Borealis", "description": "Forecasts",
     "signals": {"paths": ["/home/dev/code/p2"], "git_remotes": ["github.com/acme/borealis"],
                 "jira_prefixes": ["BOR"], "keywords": ["forecast", "wind"], "apps": ["code.exe"],
                 "domains": ["borealis.example.com"], "window_patterns": ["(?P<x>bore)alis"]},
     "synthesis": {"day": "tue"}},
    {"id": "cobalt", "name": "Cobalt",
     "signals": {"paths": ["/home/dev/code/p3", "/home/dev/code/p4"], "keywords": ["cobalt", "map"],
                 "apps": ["code.exe"], "entry_extract": ["ore grades"]}},
    {"id": "dormant", "name": "Dormant", "status": "archived",
     "signals": {"paths": ["/home/dev/code/p5"], "keywords": ["dormant"]}},
]

RUN_TS = "2024-02-01T00:00:00+00:00"


def _two(v: Column) -> Column:
    return F.lpad(v.cast("string"), 2, "0")


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ungated events with ``arrival_seq``; see ``sql.ACTIVITY`` for the same in SQL."""
    raw = spread(table(spark, sf_dir, "events"))
    k = F.get_json_object("props", "$.k").try_cast("int")
    base = raw.select("event_id", "user_id", "event_type", "value", "ts", k.alias("k"))
    base = base.withColumn("copy", F.explode(F.when(
        F.col("event_id") % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    e, u, k, c = F.col("event_id"), F.col("user_id"), F.col("k"), F.col("copy")

    kind = F.when((F.col("event_type") == "click") & (k % 3 == 0), F.lit("FILE_CHANGE")) \
        .when(F.col("event_type") == "click", F.lit("FOCUS_SESSION")) \
        .when((F.col("event_type") == "view") & (k % 5 == 0), F.lit("CLIPBOARD")) \
        .when(F.col("event_type") == "view", F.lit("DEEP_WORK")) \
        .when((F.col("event_type") == "error") & (k % 2 == 0), F.lit("AGENT_REPORT")) \
        .when(F.col("event_type") == "error", F.lit("LONG_RUN")) \
        .when(F.col("event_type") == "purchase", F.lit("GIT_COMMIT")) \
        .when(k % 11 == 0, F.lit("IDLE_START")).when(k % 11 == 1, F.lit("IDLE_END")) \
        .otherwise(F.lit("NARRATION"))

    # Wall clocks: UTC without zone, UTC with Z, +03:00 and -05:00; a few rows carry junk.
    def wall(shift: int, tail: str) -> Column:
        at = F.col("ts") + F.expr(f"INTERVAL {shift} HOURS")
        return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(tail))
    ts_wall = F.when(e % 97 == 5, F.lit("not a time")).when(e % 4 == 0, F.replace(wall(0, ""), F.lit("T"), F.lit(" "))) \
        .when(e % 4 == 1, wall(0, "Z")).when(e % 4 == 2, wall(3, "+03:00")).otherwise(wall(-5, "-05:00"))
    delay = F.make_dt_interval(F.lit(0), F.lit(0), (k % 13) + c * 30, F.lit(0))
    recv = F.when(e % 29 == 3, F.lit("")).otherwise(
        F.concat(F.date_format(F.col("ts") + delay, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
    offset = F.when(k % 17 == 0, F.lit("junk")).when(k % 6 == 0, ((k - 50) * 60).cast("string")).otherwise(F.lit("0"))
    trust = F.when(c == 1, F.lit("validated")).when(k % 10 == 0, F.lit("rejected")) \
        .when(k % 10 == 1, F.lit("low_trust")).otherwise(F.lit("validated"))

    home = F.concat(F.lit("/home/u"), u.cast("string"))
    root = F.when(u % 2 == 0, F.lit("/home/dev")).otherwise(home)
    path = F.concat(root, F.lit("/code/p"), (k % 8).cast("string"), F.lit("/src/f"), (e % 50).cast("string"), F.lit(".py"))
    anchor = F.when(k % 9 == 0, F.concat(F.lit("ATL-"), e.cast("string"), F.lit(" wind map"))) \
        .when(k % 9 == 1, F.lit("Borealis overview")).when(k % 9 == 2, F.lit("Atlas board 7")) \
        .when(k % 9 == 3, F.concat(F.lit("f"), (e % 50).cast("string"), F.lit(".py - editor"))) \
        .otherwise(F.lit(""))
    process = F.when(k % 4 == 0, F.lit("Code.exe")).when(k % 4 == 1, F.lit("QGIS.exe")).otherwise(F.lit("term"))
    note = F.when(k % 7 == 0, F.lit("cobalt forecast notes")).when(k % 7 == 1, F.lit("ok stuff")) \
        .otherwise(F.concat(F.lit("token = s3cr3t"), e.cast("string"), F.lit(" for the map")))
    is_kind = {n: kind == n for n in ("FILE_CHANGE", "GIT_COMMIT", "NARRATION", "CLIPBOARD", "AGENT_REPORT")}
    session = kind.isin("FOCUS_SESSION", "DEEP_WORK", "LONG_RUN")
    satellites = F.array(
        F.struct(F.concat(F.lit("tab "), (k % 3).cast("string")).alias("title"), F.lit("chrome.exe").alias("process")),
        F.struct(F.lit("mail").alias("title"), F.lit("").alias("process")))

    def when(cond: Column, value: Column) -> Column:
        return F.when(cond, value)

    payload = payload_of(
        anchor=when(session, anchor), process=when(session, process),
        active_file=when(session & (k % 5 == 2), path),
        satellites=when(session & (k % 5 == 0), satellites),
        duration_sec=when(session, F.when(k % 19 == 0, F.lit("n/a")).otherwise(F.round("value", 2).cast("string"))),
        mode=when(kind == "DEEP_WORK", F.lit("DEEP_WORK")),
        intent=when(session & (k % 6 == 1), F.struct(
            F.lit("mapping").alias("label"), F.lit("title").alias("method"), F.lit("0.55").alias("confidence"))),
        cmdline=when((kind == "LONG_RUN") & (k % 3 == 1), F.concat(F.lit("python "), path)),
        path=when(is_kind["FILE_CHANGE"] & (e % 41 != 0), path), action=when(is_kind["FILE_CHANGE"], F.lit("modified")),
        content=when(is_kind["CLIPBOARD"], F.when(k % 3 == 0, F.concat(F.lit("see https://atlas.example.com/x/"), e.cast("string")))
                     .when(k % 3 == 1, F.concat(F.lit("password=pw"), e.cast("string"))).otherwise(F.lit("plain words"))),
        repo=F.when(is_kind["GIT_COMMIT"], F.concat(root, F.lit("/code/p"), (k % 8).cast("string")))
        .when(is_kind["AGENT_REPORT"] & (k % 3 == 0), F.lit("github.com/acme/Atlas")),
        author=when(is_kind["GIT_COMMIT"], F.when(k % 4 == 0, F.lit("dependabot[bot]")).otherwise(F.concat(F.lit("user"), u.cast("string")))),
        message=when(is_kind["GIT_COMMIT"], F.concat(F.lit("change "), e.cast("string"))),
        actor=when(is_kind["GIT_COMMIT"] & (k % 4 == 0), F.lit("agent")),
        files=when((is_kind["GIT_COMMIT"] & (k % 2 == 0)) | (is_kind["AGENT_REPORT"] & (k % 4 == 0)), F.array(
            F.concat(F.lit("src/f"), (e % 50).cast("string"), F.lit(".py")), F.lit("docs/readme.md"))),
        note=when(is_kind["NARRATION"], note),
        summary=when(is_kind["AGENT_REPORT"], F.concat(F.lit("report "), e.cast("string"))),
        tool=when(is_kind["AGENT_REPORT"], F.lit("helper")))
    source = source_of(
        F.when(is_kind["AGENT_REPORT"], F.lit("agent")).when(is_kind["FILE_CHANGE"], F.lit("fs"))
        .when(is_kind["GIT_COMMIT"], F.lit("git")).when(is_kind["NARRATION"] | is_kind["CLIPBOARD"], F.lit("intent"))
        .otherwise(F.lit("os")),
        F.when(k % 23 == 0, F.lit("")).otherwise(F.lit("adapter")),
        F.concat(F.lit("host:"), (u % 10).cast("string")))
    shaped = base.withColumn("arrival_seq", e * 2 + c)
    return make_events(
        shaped, type=kind, source=source, ts_wall=ts_wall, recv_ts=recv, payload=payload,
        event_id=F.when(e % 101 == 0, F.lit("")).otherwise(F.concat(F.lit("e"), e.cast("string"))),
        clock_offset_sec=offset, trust=trust, keep=("arrival_seq",))
