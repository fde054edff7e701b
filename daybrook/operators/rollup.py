"""Daily archive, period rollups, day packing, fingerprints and incremental state.

Documents are tables of lines.  A line knows its place through sort columns, so a project
day of any size is written by a range sort and never assembled in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CHUNK_EVENTS, SESSION_TYPES
from ..functions.core import blank_to_null, has_text, strings, to_int
from ..functions.dates import date_label, hhmm, period_key, span_days
from ..functions.paths import basename
from ..model import EVENT
from . import numbering
from .attribution import in_projects

# Sort columns of a line inside its (project, day).
PLACE = ("section_no", "o_class", "o_ts", "o_unparsed", "o_at", "o_recv", "o_id", "o_pos")
SECTIONS = {1: "### Sessions", 2: "### Commits", 3: "### Agent activity", 4: "### Files changed", 5: "### Narration"}


def _opt(prefix: str, value: Column, tail: str = "") -> Column:
    v = blank_to_null(value)
    return F.coalesce(F.concat(F.lit(prefix), v, F.lit(tail)), F.lit(""))


def satellite_titles(limit: int) -> Column:
    titles = F.transform(F.filter("payload.satellites", lambda s: has_text(s["title"])), lambda s: s["title"])
    return F.array_join(F.slice(titles, 1, limit), ", ")


def archive_text() -> Column:
    """The archive line of one event; null for types without a line of their own."""
    p, kind, at = F.col("payload"), F.col("type"), hhmm("ts_wall")
    dash = F.lit(" — ")
    head = F.concat(F.lit("- "), at, dash)
    what = F.coalesce(blank_to_null(p["anchor"]), blank_to_null(p["process"]), F.lit("session"))
    session = F.concat(
        head, what, F.lit(" ("), to_int(p["duration_sec"]).cast("string"), F.lit("s"), _opt(", ", p["mode"]),
        F.lit(")"), _opt(" — ", p["intent"]["label"]), _opt(" — also: ", satellite_titles(4)))
    commit = F.concat(head, F.coalesce(p["message"], F.lit("")), _opt(" [", p["actor"], "]"))
    who = F.coalesce(blank_to_null(F.col("source.identity")), p["tool"], F.lit("agent"))
    said = F.coalesce(blank_to_null(p["summary"]), blank_to_null(p["message"]), p["note"], F.lit(""))
    agent = F.concat(head, who, F.lit(": "), said)
    note = F.concat(F.lit("- ["), at, F.lit('] "'), F.coalesce(p["note"], F.lit("")), F.lit('"'))
    return F.when(kind.isin(list(SESSION_TYPES)), session).when(kind == "GIT_COMMIT", commit) \
        .when(kind == "AGENT_REPORT", agent).when(kind == "NARRATION", note)


def _section_no() -> Column:
    kind = F.col("type")
    return F.when(kind.isin(list(SESSION_TYPES)), 1).when(kind == "GIT_COMMIT", 2) \
        .when(kind == "AGENT_REPORT", 3).when(kind == "NARRATION", 5)


def _place(section: Column, klass: Column, pos: Column) -> dict[str, Column]:
    return {
        "section_no": section.cast("int"), "o_class": klass.cast("int"), "o_ts": F.col("ts_wall"),
        "o_unparsed": F.col("effective_ts").isNull(), "o_at": F.col("effective_ts"),
        "o_recv": F.coalesce("recv_ts", F.lit("")), "o_id": F.coalesce("event_id", F.lit("")), "o_pos": pos.cast("int"),
    }


def _owned(attributed: DataFrame) -> DataFrame:
    return in_projects(attributed).select(
        F.col("attribution.project_id").alias("project_id"), "date_key", "type", "source", "payload",
        "ts_wall", "recv_ts", "event_id", "effective_ts")


def changed_files(attributed: DataFrame) -> DataFrame:
    """Distinct file names of a project day with the place of their first mention.

    File changes come first, then commits, then agent reports.
    """
    kind = F.col("type")
    klass = F.when(kind == "FILE_CHANGE", 0).when(kind == "GIT_COMMIT", 1).otherwise(2)
    rows = _owned(attributed).withColumn("_class", klass)
    mentions = rows.select("*", F.posexplode(_file_names()).alias("_pos", "_file")).withColumn("file", basename("_file"))
    place = F.struct(*[v.alias(k) for k, v in _place(F.lit(4), F.col("_class"), F.col("_pos")).items()])
    return mentions.where(has_text("file")).groupBy("project_id", "date_key", "file").agg(F.min(place).alias("first"))


def _file_names() -> Column:
    kind = F.col("type")
    named = F.when(kind == "FILE_CHANGE", F.array(F.col("payload.path"))).when(
        kind.isin("GIT_COMMIT", "AGENT_REPORT"), F.col("payload.files"))
    return F.coalesce(named, strings([]))


def archive_lines(attributed: DataFrame, *, frame: bool = False) -> DataFrame:
    """Lines of the daily archive: ``project_id, date_key, date_label, <place>, text``.

    Every event offers its lines (and, with ``frame``, the headings and gaps around them) in
    one pass; one aggregation then keeps what may appear once per day.  It combines on the
    map side, so a project day of any size is fine.
    """
    rows = _owned(attributed).withColumn("date_label", date_label("date_key"))
    kind = F.col("type")
    klass = F.when(kind == "FILE_CHANGE", 0).when(kind == "GIT_COMMIT", 1).otherwise(2)
    order = {k: v for k, v in _place(F.lit(0), F.lit(0), F.lit(0)).items() if k not in ("section_no", "o_class", "o_pos")}
    blank = {"o_ts": F.lit(""), "o_unparsed": F.lit(False), "o_at": F.lit(None).cast("timestamp"),
             "o_recv": F.lit(""), "o_id": F.lit("")}

    def offer(section, o_class, pos, text: Column, own: bool, where: dict[str, Column]) -> Column:
        place = {"section_no": section, "o_class": o_class, **where, "o_pos": pos}
        place = {k: (v if isinstance(v, Column) else F.lit(v)) for k, v in place.items()}
        for k in ("section_no", "o_class", "o_pos"):
            place[k] = place[k].cast("int")
        return F.struct(F.struct(*[place[n].alias(n) for n in PLACE]).alias("place"), text.alias("text"), F.lit(own).alias("own"))

    files = F.filter(F.transform(_file_names(), lambda f, i: F.struct(i.alias("i"), basename(f).alias("name"))),
                     lambda x: has_text(x["name"]))
    section = _section_no()
    line = F.when(section.isNotNull(), offer(section, 0, 0, archive_text(), True, order))
    file_lines = F.transform(files, lambda x: offer(4, klass, x["i"], F.concat(F.lit("- "), x["name"]), False, order))
    clip = F.when(kind == "CLIPBOARD", offer(6, 0, 0, F.lit("### Clipboard captures: "), False, blank))
    offers = [F.array(line, clip), file_lines]
    if frame:
        has_files = F.size(files) > 0
        names = F.coalesce(*[F.when(section == n, F.lit(t)) for n, t in SECTIONS.items()])
        offers.append(F.array(
            offer(0, 0, 0, F.lit("---"), False, blank),
            offer(0, 0, 1, F.concat(F.lit("## "), F.col("date_label")), False, blank),
            offer(0, 0, 2, F.lit(""), False, blank), offer(7, 0, 0, F.lit("---"), False, blank),
            offer(7, 0, 1, F.lit(""), False, blank),
            F.when(section.isNotNull(), offer(section, -1, 0, names, False, blank)),
            F.when(section.isNotNull(), offer(section, 9, 0, F.lit(""), False, blank)),
            F.when(has_files, offer(4, -1, 0, F.lit(SECTIONS[4]), False, blank)),
            F.when(has_files, offer(4, 9, 0, F.lit(""), False, blank)),
            F.when(kind == "CLIPBOARD", offer(6, 9, 0, F.lit(""), False, blank))))
    spread = rows.select("project_id", "date_key", "date_label", F.explode(F.filter(
        F.concat(*offers), lambda o: o.isNotNull())).alias("o"))
    # Own lines are told apart by their full place; the others by what they say and where.
    slot = F.when(F.col("o.own"), F.to_json("o.place")).when(
        F.col("o.place.section_no") == 4, F.when(F.col("o.place.o_class") < 0, F.lit("head")).when(
            F.col("o.place.o_class") == 9, F.lit("gap")).otherwise(F.lit("file"))).otherwise(
        F.concat_ws("/", "o.place.o_class", "o.place.o_pos"))
    kept = spread.groupBy("project_id", "date_key", "date_label", F.col("o.place.section_no").alias("_s"),
                          slot.alias("_slot"), F.col("o.text").alias("text"), F.col("o.own").alias("_own")) \
        .agg(F.min("o.place").alias("p"), F.count("*").alias("_n"))
    text = F.when((F.col("_s") == 6) & (F.col("p.o_class") == 0),
                  F.concat("text", F.col("_n").cast("string"))).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("_own"), F.sequence(F.lit(1), F.col("_n").cast("int"))).otherwise(F.array(F.lit(1))))
    return kept.select("project_id", "date_key", "date_label", "p.*", text.alias("text"), copies.alias("_copy")).drop("_copy")


def numbered_lines(lines: DataFrame) -> DataFrame:
    """Add ``line_no`` inside the project day; a day of any size is numbered in parallel."""
    return numbering.within(lines, ["project_id", "date_key"], [F.col(c) for c in (*PLACE, "text")], "line_no")


def document_lines(attributed: DataFrame) -> DataFrame:
    """Archive lines with their frame: rules, date heading, section headings and gaps."""
    return archive_lines(attributed, frame=True)


def merge_sections(existing: DataFrame, incoming: DataFrame, keys: tuple[str, ...] = ("project_id", "date_label")) -> DataFrame:
    """Idempotent merge: a label that comes again replaces its old lines, others stay.

    ``label_pos`` keeps the order of first appearance; new labels follow in label order.
    """
    k = list(keys)
    fresh = incoming.select(*k).distinct()
    old = existing.select(*k, "label_pos").groupBy(*k).agg(F.min("label_pos").alias("_old"))
    last = old.groupBy(k[0]).agg(F.max("_old").alias("_last"))
    unseen = fresh.join(old, k, "left_anti")
    from pyspark.sql import Window
    nth = F.row_number().over(Window.partitionBy(k[0]).orderBy(*k[1:]))
    added = unseen.withColumn("_nth", nth).join(last, k[0], "left").select(
        *k, (F.coalesce("_last", F.lit(0)) + F.col("_nth")).cast("bigint").alias("label_pos"))
    place = old.select(*k, F.col("_old").cast("bigint").alias("label_pos")).unionByName(added)
    stay = existing.drop("label_pos").join(fresh, k, "left_anti")
    return stay.unionByName(incoming.drop("label_pos") if "label_pos" in incoming.columns else incoming,
                            allowMissingColumns=True).join(place, k)


# --- periods -----------------------------------------------------------------------

def in_period(lines: DataFrame, granularity: str) -> DataFrame:
    return lines.withColumn("period_key", period_key("date_key", granularity))


def period_lines(entries: DataFrame, archive: DataFrame, granularity: str) -> DataFrame:
    """Text of a project's period: its entries, or the archive where there are none."""
    e, a = in_period(entries, granularity), in_period(archive, granularity)
    written = e.where(F.trim("text") != "").select("project_id", "period_key").distinct()
    keep_e = e.join(written, ["project_id", "period_key"], "left_semi")
    keep_a = a.join(written, ["project_id", "period_key"], "left_anti")
    return keep_e.withColumn("origin", F.lit("entries")).unionByName(
        keep_a.withColumn("origin", F.lit("archive")), allowMissingColumns=True)


def affected_periods(attributed: DataFrame, granularity: str) -> DataFrame:
    return in_projects(attributed).select(period_key("date_key", granularity).alias("period_key")).distinct()


# --- sums -------------------------------------------------------------------------

def seconds() -> Column:
    return to_int(F.col("payload.duration_sec"))


def time_per_project(attributed: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Session seconds by project, busiest first; projects without time are left out."""
    rows = in_projects(attributed).where(F.col("type").isin(list(SESSION_TYPES)))
    sums = rows.groupBy(F.col("attribution.project_id").alias("project_id")).agg(F.sum(seconds()).alias("seconds")) \
        .where(F.col("seconds") > 0)
    if names is not None:
        sums = sums.join(names.select("project_id", F.col("name").alias("_n")), "project_id", "left") \
            .withColumn("name", F.coalesce("_n", "project_id")).drop("_n")
        return sums.orderBy(F.desc("seconds"), "name")
    return sums.orderBy(F.desc("seconds"), "project_id")


def counts_by_facet(events: DataFrame) -> DataFrame:
    """Counts by type, by actor and by trust in one pass."""
    rows = events.select("type", F.coalesce("payload.actor", F.lit("")).alias("actor"), "trust")
    facets = F.explode(F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).alias("value")) for f in ("type", "actor", "trust")]))
    return rows.select(facets.alias("f")).groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))


# --- change detection ------------------------------------------------------------

_LANES = ((1, 15), (16, 15), (31, 15), (46, 15))


def event_text(*fields: str) -> Column:
    """Everything an event says, as JSON: absent and empty values differ and no value can run into the next.

    Without names the whole event; a change in any field changes the text.
    """
    if fields:
        return F.to_json(F.array(*[F.col(f).cast("string") for f in fields]))
    return F.to_json(F.struct(*[f for f in EVENT.fieldNames()]), {"ignoreNullFields": "false"})


def fingerprint(df: DataFrame, keys: list[str], row_text: Column, out: str = "fingerprint") -> DataFrame:
    """Content hash of a group's rows that does not depend on their order.

    Four 60-bit lanes of every row's sha256 are summed and the sums hashed with the row
    count.  Sums combine on the map side, so a group of any size costs one small row per
    task; adding, changing, removing or repeating a row changes the result.
    """
    hashed = df.withColumn("_h", F.sha2(row_text, 256))
    lanes = [F.sum(F.conv(F.substring("_h", at, n), 16, 10).cast("decimal(20,0)").cast("decimal(28,0)")).alias(f"_l{i}")
             for i, (at, n) in enumerate(_LANES)]
    sums = hashed.groupBy(*keys).agg(F.count("*").alias("n_rows"), *lanes)
    text = F.concat_ws("|", F.col("n_rows").cast("string"), *[F.col(f"_l{i}").cast("string") for i in range(len(_LANES))])
    return sums.select(*keys, "n_rows", F.sha2(text, 256).alias(out))


def changed_projects(prints: DataFrame, state: DataFrame) -> DataFrame:
    """Projects whose fingerprint differs from the stored one, or that are new."""
    old = state.select("project_id", F.col("fingerprint").alias("_old"))
    return prints.join(old, "project_id", "left").where(~F.col("fingerprint").eqNullSafe(F.col("_old"))).drop("_old")


def new_days(days: DataFrame, done: DataFrame) -> DataFrame:
    """``(project_id, date_key)`` pairs not yet written up."""
    return days.select("project_id", "date_key").distinct().join(
        done.select("project_id", "date_key").distinct(), ["project_id", "date_key"], "left_anti")


def merge_done_days(state: DataFrame, fresh: DataFrame) -> DataFrame:
    """State with the new days added, sorted; ``synth_days ARRAY<STRING>`` per project."""
    both = state.select("project_id", F.explode("synth_days").alias("date_key")).unionByName(
        fresh.select("project_id", "date_key")).distinct()
    return both.groupBy("project_id").agg(F.array_sort(F.collect_list("date_key")).alias("synth_days"))


def is_due(day_setting: Column, today: Column) -> Column:
    """A project is due on its weekday; without one, or with an unknown one, every day."""
    weekday = F.array_position(strings(["mon", "tue", "wed", "thu", "fri", "sat", "sun"]),
                               F.lower(F.trim(F.coalesce(day_setting, F.lit("")))))
    return (weekday == 0) | (weekday - 1 == F.weekday(today))


def run_is_due(target: Column, now: Column, last_run: Column) -> Column:
    """At or after HH:MM, once a date; a bad target is never due."""
    ok = target.rlike(r"^\s*[+]?\d+\s*:\s*[+]?\d+\s*$")
    hour = F.trim(F.split(target, ":")[0]).try_cast("int")
    minute = F.trim(F.get(F.split(target, ":"), F.lit(1))).try_cast("int")
    in_range = hour.between(0, 23) & minute.between(0, 59)
    reached = F.hour(now) * 60 + F.minute(now) >= hour * 60 + minute
    return F.coalesce(ok & in_range & reached & ~F.coalesce(last_run == F.to_date(now), F.lit(False)), F.lit(False))


# --- packing ------------------------------------------------------------------------

def pack_days(days: DataFrame, *, mode: str = "day", budget: int = 0, max_days: int = 7) -> DataFrame:
    """Group whole days into units for one batch call each: adds ``unit_no`` (from 1).

    A unit is closed when the next day would pass the token budget, the span of calendar
    days, or (``week``) the ISO week.  One row per project day goes in, so the list folded
    for a project is bounded by the calendar.
    """
    if mode not in ("day", "week", "adaptive"):
        raise ValueError(f"unknown packing mode {mode!r}")
    span_cap = max(1, max_days)
    item = F.struct("date_key", F.col("tokens").cast("bigint").alias("tokens"), period_key("date_key", "week").alias("week"))
    grouped = days.groupBy("project_id").agg(F.array_sort(F.collect_list(item)).alias("d"))
    out_type = "array<struct<date_key:string,tokens:bigint,unit_no:int>>"
    zero = F.struct(F.array().cast(out_type).alias("out"), F.lit(0).alias("unit"), F.lit("").alias("first"),
                    F.lit("").alias("week"), F.lit(0).cast("bigint").alias("used"))

    def step(acc: Column, d: Column) -> Column:
        fresh = acc["unit"] == 0
        if mode == "day":
            cut = F.lit(True)
        else:
            cut = span_days(acc["first"], d["date_key"]) > span_cap
            if budget > 0:
                cut = cut | (acc["used"] + d["tokens"] > budget)
            if mode == "week":
                cut = cut | (acc["week"] != d["week"])
        opened = fresh | cut
        unit = F.when(opened, acc["unit"] + 1).otherwise(acc["unit"])
        return F.struct(
            F.array_append(acc["out"], F.struct(d["date_key"].alias("date_key"), d["tokens"].alias("tokens"),
                                                unit.alias("unit_no"))).alias("out"),
            unit.alias("unit"), F.when(opened, d["date_key"]).otherwise(acc["first"]).alias("first"),
            F.when(opened, d["week"]).otherwise(acc["week"]).alias("week"),
            F.when(opened, d["tokens"]).otherwise(acc["used"] + d["tokens"]).alias("used"))

    folded = grouped.withColumn("u", F.aggregate("d", zero, step, lambda acc: acc["out"]))
    return folded.select("project_id", F.explode("u").alias("u")).select("project_id", "u.date_key", "u.tokens", "u.unit_no")


def with_chunks(attributed: DataFrame, size: int = CHUNK_EVENTS) -> DataFrame:
    """Number a project's events in journal order and cut them into chunks of ``size``."""
    rows = _owned(attributed)
    order = [F.col("ts_wall"), F.col("effective_ts").isNull(), F.col("effective_ts"),
             F.coalesce("recv_ts", F.lit("")), F.coalesce("event_id", F.lit(""))]
    n = numbering.within(rows, ["project_id"], order, "event_no")
    return n.withColumn("chunk_no", F.floor((F.col("event_no") - 1) / size).cast("bigint"))
