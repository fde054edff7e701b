"""Model-assisted steps as tables.

No model is called here.  A job builds a prompt table, an outside batch fills a response
table, and a second job applies it; without a response the rule-based text stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CHUNK_EVENTS
from ..functions.core import blank_to_null, est_tokens, has_text, non_null, py_trim, strings
from ..functions.dates import date_label, period_label
from ..operators import attribution, numbering, refresh
from ..operators.digest import digest, review_digest
from ..operators.rollup import pack_days
from ..sources.journal import batched_reply

# Fixed value: the line that parts an overview from its daily paragraph.
DAILY_SEPARATOR = "---DAILY SUMMARY---"

INSTRUCTIONS = {
    "categorize": "Assign every event to exactly one listed project id or to null. Answer with one JSON object: "
                  '{"assignments": [{"index": 0, "project_id": "id or null", "confidence": 0.0, "reason": "short"}]}.',
    "entry": "Write the day's detailed journal entry from the events below. Keep every number, name and decision. No heading.",
    "entry_batch": "Write one detailed journal entry for each day below, each under a line `## YYYY-MM-DD`. Keep every number.",
    "overview": "Rewrite the project overview with the new activity, then the line " + DAILY_SEPARATOR + ", then a short daily summary.",
    "chunk": "Summarise this part of the activity in three to six sentences.",
    "exec": "Write a short summary of the day across projects from the notes below.",
    "period": "Write a retrospective of the period from the notes below.",
    "ask": "Answer from the passages below only and name their sources.",
    "init_enrich": "Propose a description and identifying signals for the project as one JSON object.",
}


def _prompt(label: str, user: Column) -> list[Column]:
    return [F.lit(label).alias("label"), F.lit(INSTRUCTIONS[label]).alias("system"), user.alias("user"),
            est_tokens(F.concat(F.lit(INSTRUCTIONS[label]), user)).alias("prompt_tokens")]


def projects_block(projects: list[dict]) -> str:
    return "\n".join(
        f"- id: {p['id']}\n  name: {p.get('name', '')}\n  description: {p.get('description', '')}\n"
        f"  keywords: {', '.join((p.get('signals') or {}).get('keywords') or [])}" for p in projects)


def output_budget(n: Column) -> Column:
    return F.least(F.lit(8000), F.greatest(F.lit(1500), n * 80)).cast("int")


def categorize_prompts(attributed: DataFrame, projects: list[dict], batch: int = CHUNK_EVENTS) -> DataFrame:
    """Review queue in batches of bounded size: ``batch_no, n_events, max_tokens, label, system, user``.

    Batches follow time; the index inside a prompt is the event's place in its batch.
    """
    indexed = review_index(attributed, batch)
    item = F.struct("idx", review_digest(F.col("idx")).alias("block"))
    gathered = indexed.groupBy("batch_no").agg(F.count("*").alias("n_events"), F.array_sort(F.collect_list(item)).alias("b"))
    user = F.concat(F.lit("ACTIVE PROJECTS:\n" + projects_block(attribution.active_projects(projects)) + "\n\nEVENTS:\n"),
                    F.array_join(F.transform("b", lambda x: x["block"]), "\n"))
    return gathered.select("batch_no", "n_events", output_budget(F.col("n_events")).alias("max_tokens"), *_prompt("categorize", user))


def review_index(attributed: DataFrame, batch: int = CHUNK_EVENTS) -> DataFrame:
    """Review queue with ``batch_no`` and ``idx`` (from 0)."""
    queue = attribution.residue(attributed).withColumn("_said", F.sha2(F.to_json(F.struct(*attributed.columns)), 256))
    order = [F.col("ts_wall"), F.coalesce("recv_ts", F.lit("")), F.coalesce("event_id", F.lit("")), F.col("_said")]
    numbered = numbering.numbered(queue, order, "_n").drop("_said")
    at = F.col("_n") - 1
    return numbered.withColumn("batch_no", F.floor(at / batch).cast("bigint")).withColumn("idx", (at % batch).cast("int")).drop("_n")


_ASSIGNMENTS = "STRUCT<assignments: ARRAY<STRUCT<index: STRING, project_id: STRING, confidence: STRING, reason: STRING>>>"


def parse_assignments(responses: DataFrame, project_ids: list[str]) -> DataFrame:
    """``batch_no, reply`` to ``batch_no, idx, project_id, confidence, reason``.

    Bad indexes are skipped, invented ids become null, reasons are cut at 200 characters;
    an index given twice keeps its last answer.
    """
    from ..functions.text import json_object_text
    obj = F.from_json(json_object_text("reply"), _ASSIGNMENTS)
    rows = responses.select("batch_no", F.posexplode(obj["assignments"]).alias("pos", "a"))
    idx = F.col("a.index").try_cast("double").try_cast("int")
    return rows.where(idx.isNotNull()).groupBy("batch_no", idx.alias("idx")).agg(F.max_by("a", "pos").alias("a")).select(
        "batch_no", "idx", F.when(F.col("a.project_id").isin(project_ids), F.col("a.project_id")).alias("project_id"),
        F.coalesce(F.col("a.confidence").try_cast("double"), F.lit(0.0)).alias("confidence"),
        F.substring(F.coalesce("a.reason", F.lit("")), 1, 200).alias("reason"))


def apply_answers(attributed: DataFrame, assignments: DataFrame, project_ids: list[str], batch: int = CHUNK_EVENTS) -> DataFrame:
    """Answers go to the event at their place in the review queue; ids do not matter, so events without one get theirs too."""
    placed = review_index(attributed, batch).join(assignments.select("batch_no", "idx", F.col("project_id").alias("_pid"), F.col("confidence").alias("_conf")),
                                                  ["batch_no", "idx"], "left")
    answered = placed.withColumn("attribution", attribution.answered(F.col("_conf").isNotNull(), F.col("_pid"), F.col("_conf"), project_ids))
    return attribution.settled(attributed).unionByName(answered.select(*attributed.columns))


def entry_hints(registry: DataFrame) -> DataFrame:
    """``project_id, hints``: what an entry should capture, as a list; explicit hints, else description and keywords."""
    explicit = F.filter(F.coalesce("signals.entry_extract", strings([])), lambda h: py_trim(h) != "")
    words = F.array_join("signals.keywords", ", ")
    implied = non_null(blank_to_null("description"), F.when(words != "", F.concat(F.lit("keywords: "), words)))
    said = F.when(F.size(explicit) > 0, explicit).otherwise(implied)
    return registry.select(F.col("id").alias("project_id"), F.array_join(F.transform(said, lambda h: F.concat(F.lit("- "), h)), "\n").alias("hints"))


def digests(attributed: DataFrame) -> DataFrame:
    """Owned events with their journal digest and their order."""
    rows = attribution.in_projects(attributed)
    return rows.select(
        F.col("attribution.project_id").alias("project_id"), "date_key", "ts_wall", "effective_ts",
        F.coalesce("recv_ts", F.lit("")).alias("recv_ts"), F.coalesce("event_id", F.lit("")).alias("event_id"),
        digest().alias("digest"))


def day_tokens(attributed: DataFrame) -> DataFrame:
    """Size of each project day's raw block, without building it: ``project_id, date_key, tokens``."""
    rows = digests(attributed)
    said = F.when(F.col("digest") != "", F.length("digest"))
    sums = rows.groupBy("project_id", "date_key").agg(F.sum(said).alias("chars"), F.count(said).alias("n"))
    total = F.coalesce("chars", F.lit(0)) + F.greatest((F.col("n") - 1) * 2, F.lit(0))
    return sums.select("project_id", "date_key", F.greatest(F.lit(1), F.floor(total / 4)).cast("bigint").alias("tokens"))


def activity_chunks(attributed: DataFrame, size: int = CHUNK_EVENTS) -> DataFrame:
    """Digest blocks of at most ``size`` events: ``project_id, date_key, chunk_no, n_events, block``.

    A day of any size becomes many bounded blocks; nothing grows with the day.
    """
    rows = digests(attributed)
    order = [F.col(c) for c in ("ts_wall",)] + [F.col("effective_ts").isNull(), *[F.col(c) for c in ("effective_ts", "recv_ts", "event_id")]]
    n = numbering.within(rows, ["project_id", "date_key"], order, "_no")
    chunked = n.withColumn("chunk_no", F.floor((F.col("_no") - 1) / size).cast("bigint"))
    item = F.struct("_no", "digest")
    spoken = F.filter(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["digest"]), lambda t: t != "")
    return chunked.groupBy("project_id", "date_key", "chunk_no").agg(
        F.count("*").alias("n_events"), F.array_join(spoken, "\n\n").alias("block"))


def entry_prompts(chunks: DataFrame, registry: DataFrame) -> DataFrame:
    """One entry prompt for each block of a project day."""
    rows = chunks.join(entry_hints(registry), "project_id", "left")
    user = F.concat(F.lit("PROJECT: "), "project_id", F.lit("\nDATE: "), date_label("date_key"), F.lit("\nCAPTURE:\n"), F.coalesce("hints", F.lit("")),
                    F.lit("\n\nACTIVITY:\n"), "block")
    return rows.select("project_id", "date_key", "chunk_no", "n_events", *_prompt("entry", user))


def due_entry_prompts(attributed: DataFrame, changed: DataFrame, registry: DataFrame) -> DataFrame:
    """Entry prompts of the project days that a refresh wrote again; none where nothing changed."""
    return entry_prompts(activity_chunks(refresh.day_rows(attributed, changed)), registry)


def entry_units(attributed: DataFrame, *, mode: str, budget: int, max_days: int = 7) -> DataFrame:
    """Units of whole days for batched entry calls: ``project_id, unit_no, days, tokens``."""
    packed = pack_days(day_tokens(attributed), mode=mode, budget=budget, max_days=max_days)
    return packed.groupBy("project_id", "unit_no").agg(
        F.array_sort(F.collect_list("date_key")).alias("days"), F.sum("tokens").alias("tokens"))


def apply_entries(days: DataFrame, responses: DataFrame) -> DataFrame:
    """Replies to entry text per project day; null where the archive has to stand in.

    ``days``: ``project_id, date_key``; ``responses``: ``project_id, reply, date_key`` (null
    for a reply that covers several days under dated headings) and, where a day was cut into
    blocks, ``chunk_no``.  The replies of a day follow one another in block order; a dated
    section of a longer reply comes after them.
    """
    place = F.col("chunk_no").cast("bigint") if "chunk_no" in responses.columns else F.lit(0).cast("bigint")
    single = responses.where(F.col("date_key").isNotNull()).select("project_id", "date_key", place.alias("place"), py_trim("reply").alias("entry"))
    batch = responses.where(F.col("date_key").isNull()).select("project_id", F.explode(batched_reply(F.col("reply"))).alias("b"))
    many = batch.select("project_id", F.replace("b.date_label", F.lit("-"), F.lit("")).alias("date_key"),
                        F.lit(None).cast("bigint").alias("place"), F.col("b.body").alias("entry"))
    part = F.struct(F.col("place").isNull().alias("late"), "place", "entry")
    said = single.unionByName(many).where(has_text("entry")).groupBy("project_id", "date_key").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["entry"]), "\n\n").alias("entry"))
    return days.join(said, ["project_id", "date_key"], "left")


def entry_lines(entries: DataFrame) -> DataFrame:
    """Written entries as framed lines, like archive lines."""
    label = date_label("date_key")
    frame = F.concat(F.array(F.lit("---"), F.concat(F.lit("## "), label), F.lit("")), F.split(py_trim("entry"), "\n"),
                     F.array(F.lit(""), F.lit("---"), F.lit("")))
    rows = entries.where(has_text("entry"))
    return rows.select("project_id", "date_key", label.alias("date_label"), F.posexplode(frame).alias("pos", "text"))


def split_overview(reply: Column, current: Column) -> Column:
    """``struct<overview, daily>`` of an overview reply; no reply keeps the current text."""
    head = F.substring_index(reply, DAILY_SEPARATOR, 1)
    parted = reply.contains(DAILY_SEPARATOR)
    tail = F.substr(reply, F.length(head) + len(DAILY_SEPARATOR) + 1)
    return F.when(reply.isNull(), F.struct(current.alias("overview"), F.lit("").alias("daily"))).otherwise(F.struct(
        F.concat(py_trim(head), F.lit("\n")).alias("overview"),
        F.when(parted, py_trim(tail)).otherwise(F.lit("")).alias("daily")))


def overview_stub(name: Column, today: str) -> Column:
    return F.concat(F.lit("# "), name, F.lit(
        f"\n**Status:** active | **Last Updated:** {today}\n\n## Current State\n(No history yet)\n\n"
        "## Ongoing Threads\n\n## Chronological Narrative\n\n## Key Artifacts\n"))


def overview_prompts(blocks: DataFrame, overviews: DataFrame) -> DataFrame:
    """One prompt per project block; the current overview leads."""
    joined = blocks.join(overviews.select("project_id", "overview"), "project_id", "left")
    user = F.concat(F.lit("CURRENT OVERVIEW:\n"), F.coalesce("overview", F.lit("")), F.lit("\n\nNEW ACTIVITY:\n"), "block")
    return joined.select("project_id", *_prompt("overview", user))


def exec_body(paragraphs: DataFrame) -> DataFrame:
    """Summary lines without a model: ``pos, text`` per project, in project order."""
    rows = paragraphs.select("project_id", F.explode(F.array(
        F.struct(F.lit(0).alias("pos"), F.concat(F.lit("## "), "project_id").alias("text")),
        F.struct(F.lit(1).alias("pos"), F.coalesce(blank_to_null("paragraph"), F.lit("(no daily summary produced)")).alias("text")),
        F.struct(F.lit(2).alias("pos"), F.lit("").alias("text")))).alias("x"))
    return rows.select("project_id", "x.pos", "x.text").orderBy("project_id", "pos")


def period_prompts(period_lines: DataFrame, granularity: str) -> DataFrame:
    """One prompt row per period and project note block (archive or entry lines of that period).

    Blocks are bounded: lines are gathered per project day.
    """
    item = F.struct("section_no", "o_class", "o_ts", "o_id", "o_pos", "text")
    notes = period_lines.groupBy("period_key", "project_id", "date_key", F.substring("o_ts", 1, 13).alias("hour")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["text"]), "\n").alias("note"))
    user = F.concat(F.lit("PERIOD: "), period_label("period_key", granularity), F.lit("\n\n### "), "project_id", F.lit("\n"), "note")
    return notes.select("period_key", "project_id", "date_key", "hour", *_prompt("period", user))


def ask_prompts(selected: DataFrame, questions: DataFrame, qid: str = "qid") -> DataFrame:
    """One prompt per question over its few selected passages."""
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] source: "), "source", F.lit("\n"), "text")
    rows = selected.groupBy(qid).agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("p"))
    text = F.coalesce(F.array_join(F.transform("p", lambda x: x["b"]), "\n"), F.lit("(none)"))
    user = F.concat(F.lit("QUESTION:\n"), "question", F.lit("\n\nPASSAGES:\n"), text)
    return questions.join(rows, qid, "left").select(qid, *_prompt("ask", user))


def enrich_prompts(registry: DataFrame, folders: DataFrame) -> DataFrame:
    """Metadata digests (``project_id, readme, markers, tree``) to enrichment prompts."""
    def part(title: str, value: Column) -> Column:
        return F.when(has_text(value), F.concat(F.lit(title), value))
    text = F.substring(F.concat_ws("\n\n", part("README (excerpt):\n", F.substring("readme", 1, 3200)),
                                   part("Language/build markers: ", F.array_join(F.array_sort("markers"), ", ")),
                                   part("File tree (names only):\n", F.col("tree"))), 1, 4000)
    joined = registry.join(folders.withColumn("digest", text), registry["id"] == folders["project_id"])
    user = F.concat(F.lit("PROJECT NAME: "), F.coalesce("name", "id"), F.lit("\nGIT REMOTES: "),
                    F.coalesce(blank_to_null(F.array_join("signals.git_remotes", ", ")), F.lit("(none)")),
                    F.lit("\n\nFOLDER METADATA:\n"), "digest")
    return joined.where(has_text("digest")).select(F.col("id").alias("project_id"), *_prompt("init_enrich", user))
