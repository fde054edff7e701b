"""Tokens, entropy, titles and small markdown helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import (
    FILLER_WORDS, GENERIC_TITLES, KPS_PRODUCING, STOP_WORDS, TITLE_SEPARATORS,
)
from .core import ColumnLike, bind, blank_to_null, col, has_text, py_trim, splitlines, strings
from .paths import basename, parent_name


def entropy(value: ColumnLike) -> Column:
    """Shannon entropy in bits per character; 0 for an empty text."""
    def of(t: Column) -> Column:
        n = F.length(t)
        counts = F.transform(
            F.array_distinct(F.split(t, "")),
            lambda c: (n - F.length(F.replace(t, c, F.lit("")))).cast("double"))
        return F.aggregate(counts, F.lit(0.0), lambda acc, v: F.when(
            v > 0, acc - (v / n) * F.log2(v / n)).otherwise(acc))
    return bind(col(value), lambda t: F.when(t == "", F.lit(0.0)).otherwise(of(t)))


def tokens(value: ColumnLike) -> Column:
    """Content words: lower case, two characters or more, no stop words."""
    words = F.regexp_extract_all(F.lower(col(value)), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(list(STOP_WORDS)))


def is_meaningful_note(value: ColumnLike) -> Column:
    """Two tokens or more, one of them a real word."""
    words = F.regexp_extract_all(F.lower(F.coalesce(col(value), F.lit(""))), F.lit("[a-z0-9']+"), F.lit(0))
    return bind(words, lambda w: (F.size(w) >= 2) & F.exists(
        w, lambda t: (F.length(t) >= 3) & ~t.isin(list(FILLER_WORDS))))


def active_file(title: ColumnLike) -> Column:
    """File named in a window title: a drive path with suffix, else a bare file name."""
    parts = F.transform(F.split(col(title), " [-—|–] ", -1), lambda p: py_trim(p))

    def is_file(p: Column) -> Column:
        drive = p.rlike(r"^[A-Za-z]:") & p.rlike(r"[^\\/.][^\\/]*\.[^\\/.]+[\\/]*$")
        bare = p.rlike(r"\.[A-Za-z0-9]{1,6}$") & ~p.rlike(r"[\\/]")
        return (p != "") & (drive | bare)

    hit = F.get(F.filter(parts, is_file), F.lit(0))
    return F.when(hit.rlike("^[A-Za-z]:"), F.regexp_replace(
        F.regexp_replace(F.replace(hit, F.lit("/"), F.lit("\\")), r"(?<=.)\\{2,}", r"\\"),
        r"\\$", "")).otherwise(hit)


def document_title(title: ColumnLike) -> Column:
    """Left part of a ``document - app`` title."""
    t = col(title)

    def left(sep: str) -> Column:
        part = py_trim(F.substring_index(t, sep, 1))
        ok = t.contains(sep) & (F.length(part) >= 2) & ~F.lower(part).isin(list(GENERIC_TITLES))
        return F.when(ok, part)

    return F.coalesce(*[left(s) for s in TITLE_SEPARATORS])


def place_label(cwd: ColumnLike, cmdline: ColumnLike) -> Column:
    """Folder a process works in, else the folder of the first path on its command line."""
    words = F.filter(
        F.split(F.replace(col(cmdline), F.lit('"'), F.lit(" ")), r"[\s\x1c-\x1f\x85\p{Z}]+"),
        lambda w: has_text(parent_name(w)))
    from_cmd = F.transform(words, lambda w: parent_name(w))
    return F.coalesce(blank_to_null(basename(cwd, drive=True)), F.get(from_cmd, F.lit(0)))


def intent(uia: ColumnLike, title: ColumnLike, cwd: ColumnLike, cmdline: ColumnLike,
           saved: ColumnLike, note: ColumnLike, keys: ColumnLike, seconds: ColumnLike) -> Column:
    """Best intent descriptor: the first rung that says something wins."""
    def rung(label: Column, method: str, confidence: float, artifact: Column) -> Column:
        return F.struct(label.alias("label"), F.lit(method).alias("method"),
                        F.lit(confidence).alias("confidence"), artifact.alias("artifact"))

    nothing = F.lit(None).cast("string")
    u, n = py_trim(F.coalesce(col(uia), F.lit(""))), py_trim(F.coalesce(col(note), F.lit("")))
    file, doc, place = active_file(title), document_title(title), place_label(cwd, cmdline)
    looks_like_path = u.rlike(r"[\\/]") & (F.length(u) > 3)
    kps = F.try_divide(col(keys).cast("double"), col(seconds).cast("double"))
    return F.when(~F.lower(u).isin(list(GENERIC_TITLES)),
                  rung(u, "uia", 0.9, F.when(looks_like_path, u))) \
        .when(file.isNotNull(), rung(file, "title", 0.8, file)) \
        .when(doc.isNotNull(), rung(doc, "title", 0.55, nothing)) \
        .when(place.isNotNull(), rung(place, "proc_cmdline_cwd", 0.6, blank_to_null(cwd))) \
        .when(has_text(saved), rung(col(saved), "saved_artifact", 0.7, col(saved))) \
        .when((n != "") & is_meaningful_note(n), rung(n, "narration", 0.5, nothing)) \
        .when((col(seconds) > 0) & (col(keys) > 0),
              rung(F.when(kps >= KPS_PRODUCING, F.lit("producing")).otherwise(F.lit("reading")),
                   "input", 0.3, nothing)) \
        .otherwise(rung(F.lit(""), "needs_review", 0.0, nothing))


def slug_words(name: ColumnLike) -> Column:
    """Lower-case words of a name, also split where the case changes."""
    words = F.regexp_extract_all(
        col(name), F.lit("[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+"), F.lit(0))
    return F.transform(words, lambda w: F.lower(w))


def chat_markup(md: ColumnLike) -> Column:
    """Markdown to chat markup: headings and bold to ``*b*``, bullets to a dot."""
    lines = F.transform(splitlines(col(md)), lambda s: F.regexp_replace(
        F.regexp_replace(F.regexp_replace(s, r"^#{1,6}\s*(.+)$", r"*$1*"), r"^\s*[-*]\s+", "• "),
        r"\*\*(.+?)\*\*", r"*$1*"))
    return py_trim(F.array_join(lines, "\n"))


def body_without_title(md: ColumnLike) -> Column:
    """A document minus its first heading line."""
    t = py_trim(F.coalesce(col(md), F.lit("")))
    return F.when(t.startswith("#"), py_trim(F.regexp_replace(t, r"\A#[^\n]*\n?", ""))).otherwise(t)


def _paragraph(lines: Column, start: Column) -> Column:
    """Trimmed prose lines after ``start`` up to the first gap or heading, joined."""
    def step(acc: Column, line: Column) -> Column:
        t = py_trim(line)
        text = (t != "") & ~line.startswith("#")
        return F.when(acc["done"], acc).when(text, F.struct(
            F.concat_ws(" ", F.when(acc["text"] != "", acc["text"]), t).alias("text"),
            F.lit(False).alias("done"))).otherwise(F.struct(
                acc["text"].alias("text"), (acc["text"] != "").alias("done")))
    zero = F.struct(F.lit("").alias("text"), F.lit(False).alias("done"))
    tail = F.slice(lines, start, F.greatest(F.size(lines) - start + 1, F.lit(0)))
    return F.aggregate(tail, zero, step, lambda acc: acc["text"])


def excerpt(md: ColumnLike, limit: int = 240) -> Column:
    """First paragraph under "Current State", else the first paragraph, cut at ``limit``."""
    def of(lines: Column) -> Column:
        is_state = F.transform(lines, lambda s: s.startswith("## ") & F.lower(s).contains("current state"))
        at = F.array_position(is_state, F.lit(True)).cast("int")
        state = F.when(at > 0, _paragraph(lines, at + 1)).otherwise(F.lit(""))
        first = _paragraph(lines, F.lit(1))
        text = py_trim(F.regexp_replace(F.coalesce(blank_to_null(state), first), "[*`#]", ""))
        return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))).otherwise(text)
    return bind(splitlines(col(md)), of)


def passage_base(path: ColumnLike) -> Column:
    """``project_checkout/overview.md`` -> ``checkout/overview``."""
    return F.regexp_replace(F.regexp_replace(col(path), r"\.[^./]+$", ""), r"(^|/)project_", "$1")


def matches_project(path: ColumnLike, project: str) -> Column:
    base = F.lower(F.substring_index(passage_base(path), "/", 1))
    return (base == project.lower()) | F.lower(col(path)).contains(project.lower())


def json_object_text(reply: ColumnLike) -> Column:
    """Outermost ``{…}`` of a reply after traces and code fences are taken away."""
    t = py_trim(F.regexp_replace(F.coalesce(col(reply), F.lit("")), r"(?is)<think>.*?</think>", ""))
    fenced = F.regexp_extract(t, r"(?s)```(?:json)?\s*(.*?)```", 1)
    inner = F.when(t.rlike(r"(?s)```(?:json)?\s*(.*?)```"), py_trim(fenced)).otherwise(t)
    return blank_to_null(F.regexp_extract(inner, r"(?s)\{.*\}", 0))


def budget_for_model(model: ColumnLike) -> Column:
    """Input budget of a model tier in estimated tokens."""
    from ..constants import BUDGET_FREE, BUDGET_FRONTIER, BUDGET_OTHER, FRONTIER_MARKERS
    m = F.lower(F.coalesce(col(model), F.lit("")))
    frontier = F.exists(strings(FRONTIER_MARKERS), lambda k: F.contains(m, k))
    return F.when(m.contains(":free"), F.lit(BUDGET_FREE)).when(frontier, F.lit(BUDGET_FRONTIER)) \
        .otherwise(F.lit(BUDGET_OTHER))
