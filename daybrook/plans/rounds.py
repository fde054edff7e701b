"""Prompts in rounds: a tree of pieces, where each round reads the replies of the one before.

A scope (a project, a project's week, a day over all projects) has ordered pieces of text.  A round
gathers at most ``fan`` neighbouring pieces a prompt.  A scope that fits one prompt gets its last one
(overview, period, summary); the others get prompts for parts, and the replies are the pieces of the
next round.  A part without a reply goes on as its own text, so nothing is lost when a model fails.
No model is called here: a round's prompts are a table, and so are the replies to it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import est_tokens, has_text, py_trim
from ..functions.dates import date_label, period_label
from ..operators import numbering
from ..session import materialize
from .prompts import INSTRUCTIONS, activity_chunks, entry_hints, entry_units, split_overview

FAN = 8


def gathered(pieces: DataFrame, keys: list[str], place: list[str], fan: int = FAN) -> DataFrame:
    """``keys…, node_no, n_pieces, n_nodes, material``: at most ``fan`` pieces (column ``text``) a node, in order of ``place``."""
    placed = numbering.within(pieces, keys, [F.col(c) for c in (*place, "text")], "_n")
    nodes = placed.withColumn("node_no", F.floor((F.col("_n") - 1) / fan)).groupBy(*keys, "node_no").agg(
        F.count("*").alias("n_pieces"), F.array_sort(F.collect_list(F.struct("_n", "text"))).alias("_p"))
    nodes = materialize(nodes.withColumn("material", F.array_join(F.transform("_p", lambda x: x["text"]), "\n\n")).drop("_p"), "nodes")
    many = nodes.groupBy(*keys).agg(F.count("*").alias("n_nodes"))
    return nodes.join(many, keys)


def prompt_rows(rows: DataFrame, keep: list[str], label: Column, user: Column) -> DataFrame:
    """``keep…, label, system, user, prompt_tokens, prompt_sha256``; the hash names the whole prompt."""
    system = F.coalesce(*(F.when(label == name, F.lit(text)) for name, text in INSTRUCTIONS.items()))
    told = rows.withColumns({"label": label, "system": system, "user": user})
    whole = F.concat("system", F.lit("\n"), "user")
    return told.select(*keep, "label", "system", "user", est_tokens(F.concat("system", "user")).alias("prompt_tokens"), F.sha2(whole, 256).alias("prompt_sha256"))


def next_round(pieces: DataFrame, keys: list[str], place: list[str], last: str, head: Column, fan: int = FAN) -> DataFrame:
    """Prompts of one round with the material they hold; ``head`` says what the scope is.  ``label`` is ``last`` where a scope is done."""
    nodes = gathered(pieces, keys, place, fan)
    done = F.col("n_nodes") == 1
    user = F.concat(head, F.when(done, F.lit("")).otherwise(F.concat(F.lit("\nPART: "), (F.col("node_no") + 1).cast("string"))), F.lit("\n\n"), F.col("material"))
    return prompt_rows(nodes, [*keys, "node_no", "n_pieces", "material"], F.when(done, last).otherwise("chunk"), user)


def with_replies(prompts: DataFrame, replies: DataFrame) -> DataFrame:
    """Prompts with their ``reply`` out of ``(prompt_sha256, reply)``; blank is none, of several the largest stands."""
    said = replies.where(py_trim("reply") != "").groupBy("prompt_sha256").agg(F.max("reply").alias("reply"))
    return prompts.join(said, "prompt_sha256", "left")


def staged(pieces: DataFrame, keys: list[str], place: list[str], last: str, head: Column, answer: Callable[[DataFrame, int], DataFrame], fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """All rounds; ``answer`` takes a round's prompts and its number and gives the replies.

    Gives the prompts of all rounds (with ``round``) and, per scope, its last prompt with ``reply``
    (null if there is none).  Each round has at most a ``fan``-th of the pieces of the one before.
    """
    every = finished = None
    number, rest = 0, pieces
    while True:
        asked = materialize(next_round(rest, keys, place, last, head, fan).withColumn("round", F.lit(number)), "round")
        heard = materialize(with_replies(asked, answer(asked, number)), "replies")
        done = heard.where(F.col("label") == last)
        every = asked if every is None else every.unionByName(asked)
        finished = done if finished is None else finished.unionByName(done)
        more = heard.where(F.col("label") != last)
        if more.isEmpty():
            return every, finished
        rest, place, number = more.select(*keys, "node_no", F.coalesce(py_trim("reply"), "material").alias("text")), ["node_no"], number + 1


def overview_rounds(attributed: DataFrame, overviews: DataFrame, answer, *, size: int = 150, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """One overview prompt a project over its activity, condensed in rounds where it is long.

    Gives all prompts, and ``project_id, overview, daily``: without a reply the current overview stays.
    ``overviews``: ``project_id, overview``.
    """
    blocks = activity_chunks(attributed, size).where("block <> ''").select("project_id", "date_key", "chunk_no", F.col("block").alias("text"))
    current = overviews.select(F.col("project_id").alias("_p"), "overview")
    pieces = blocks.join(current, F.col("project_id") == F.col("_p"), "left").select("project_id", F.coalesce("overview", F.lit("")).alias("overview"), "date_key", "chunk_no", "text")
    head = F.concat(F.lit("PROJECT: "), "project_id", F.lit("\nCURRENT OVERVIEW:\n"), "overview", F.lit("\n\nNEW ACTIVITY:"))
    prompts, done = staged(pieces, ["project_id", "overview"], ["date_key", "chunk_no"], "overview", head, answer, fan)
    parts = split_overview(F.col("reply"), F.col("overview"))
    return prompts.drop("overview"), done.select("project_id", parts.alias("x")).select("project_id", "x.overview", "x.daily")


def period_rounds(period_lines: DataFrame, granularity: str, answer, *, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """One period prompt a project and period over its days' lines; ``period_key, project_id, body`` of those answered.

    The other periods keep the body without a model (``operators.refresh.period_body``).
    """
    order = ["date_key", "section_no", "o_class", "o_ts", "o_id", "o_pos"]
    pieces = period_lines.select("period_key", "project_id", *order, "text")
    head = F.concat(F.lit("PERIOD: "), period_label("period_key", granularity), F.lit("\nPROJECT: "), "project_id")
    prompts, done = staged(pieces, ["period_key", "project_id"], order, "period", head, answer, fan)
    return prompts, done.where("reply is not null").select("period_key", "project_id", F.concat(py_trim("reply"), F.lit("\n")).alias("body"))


def summary_rounds(paragraphs: DataFrame, answer, *, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """One summary prompt a day over the paragraphs of all projects (``run_date, project_id, paragraph``).

    Gives ``run_date, body``; a day without a reply keeps a body of the paragraphs under their headings.
    """
    told = F.coalesce(F.when(has_text("paragraph"), F.col("paragraph")), F.lit("(no daily summary produced)"))
    pieces = paragraphs.select("run_date", "project_id", F.concat(F.lit("## "), "project_id", F.lit("\n"), told).alias("text"))
    prompts, done = staged(pieces, ["run_date"], ["project_id"], "exec", F.concat(F.lit("DATE: "), F.col("run_date")), answer, fan)
    return prompts, done.select("run_date", F.coalesce(F.concat(py_trim("reply"), F.lit("\n")), F.concat("material", F.lit("\n"))).alias("body"))


def unit_prompts(attributed: DataFrame, registry: DataFrame, *, mode: str, budget: int, max_days: int = 7, size: int = 150) -> DataFrame:
    """One prompt for each packed unit of days: ``project_id, unit_no, n_days, label, system, user, …``.

    A unit's days follow one another under ``## date``; the packing bounds their tokens, a single day over
    the budget is a unit of its own.
    """
    units = entry_units(attributed, mode=mode, budget=budget, max_days=max_days).select("project_id", "unit_no", F.size("days").alias("n_days"), F.explode("days").alias("date_key"))
    blocks = activity_chunks(attributed, size).where("block <> ''").join(units, ["project_id", "date_key"])
    piece = F.struct("date_key", "chunk_no", "block")
    days = blocks.groupBy("project_id", "unit_no", "n_days", "date_key").agg(F.array_sort(F.collect_list(piece)).alias("b"))
    text = F.concat(F.lit("## "), date_label("date_key"), F.lit("\n"), F.array_join(F.transform("b", lambda x: x["block"]), "\n\n"))
    whole = days.select("project_id", "unit_no", "n_days", F.struct("date_key", text.alias("text")).alias("d")).groupBy("project_id", "unit_no", "n_days").agg(F.array_sort(F.collect_list("d")).alias("d"))
    rows = whole.join(entry_hints(registry), "project_id", "left")
    user = F.concat(F.lit("PROJECT: "), "project_id", F.lit("\nCAPTURE:\n"), F.coalesce("hints", F.lit("")), F.lit("\n\nACTIVITY:\n"), F.array_join(F.transform("d", lambda x: x["text"]), "\n\n"))
    return prompt_rows(rows, ["project_id", "unit_no", "n_days"], F.when(F.col("n_days") > 1, "entry_batch").otherwise("entry"), user)


def journal_lines(entries: DataFrame, archive: DataFrame) -> DataFrame:
    """Lines of the journal: the written entry of a day, or its archive where no entry came.

    ``entries``: ``project_id, date_key, entry``; ``archive``: framed archive lines.  ``origin`` says which.
    """
    from ..operators.rollup import PLACE
    from .prompts import entry_lines
    entries = entries.withColumn("entry", F.when(py_trim("entry") != "", F.col("entry")))
    written = entry_lines(entries).withColumn("origin", F.lit("entry"))
    silent = entries.where("entry is null").select("project_id", "date_key")
    stands = archive.join(silent, ["project_id", "date_key"], "left_semi").select("project_id", "date_key", "date_label", *PLACE, "text").withColumn("origin", F.lit("archive"))
    return stands.unionByName(written, allowMissingColumns=True)
