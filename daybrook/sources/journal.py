"""Journal documents as tables: corpus, dated sections, batched replies, daily log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import py_trim, splitlines


def read_corpus(spark: SparkSession, root: str) -> DataFrame:
    """``path, text`` of every markdown file below a folder; paths are relative to it."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(root, wholetext=True)
    base = root.rstrip("/") + "/"
    at = F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/")
    return files.select(F.replace(at, F.lit(base), F.lit("")).alias("path"), F.col("value").alias("text"))


def dated_sections(text: Column) -> Column:
    """``array<struct<label, chunk>>`` of a framed document (``---`` then ``## label``)."""
    chunks = F.filter(F.split(F.coalesce(text, F.lit("")), "(?m)(?=^---\n## )", -1), lambda c: py_trim(c) != "")
    return F.transform(chunks, lambda c: F.struct(
        F.when(c.rlike(r"\A---\n## .+"), py_trim(F.regexp_extract(c, r"\A---\n## (.+)", 1)))
        .otherwise(F.substring(c, 1, 60)).alias("label"), c.alias("chunk")))


_DATE_HEAD = r"^\s{0,3}#{1,3}\s*(\d{4}-\d{2}-\d{2})\s*$"


def batched_reply(reply: Column) -> Column:
    """``array<struct<date_label, body>>`` of a reply with one dated heading per day; a date
    given twice keeps its last body, empty bodies are left out."""
    chunks = F.split(F.coalesce(reply, F.lit("")), "(?m)(?=" + _DATE_HEAD + ")", -1)
    dated = F.filter(chunks, lambda c: c.rlike("(?m)\\A" + _DATE_HEAD[1:]))
    parts = F.transform(dated, lambda c: F.struct(
        F.regexp_extract(c, "(?m)\\A" + _DATE_HEAD[1:], 1).alias("date_label"),
        py_trim(F.regexp_replace(c, "(?m)\\A" + _DATE_HEAD[1:], "")).alias("body")))
    full = F.filter(parts, lambda p: p["body"] != "")
    last = F.transform(full, lambda p, i: F.struct(p.alias("p"), F.exists(
        F.slice(full, i + 2, F.size(full)), lambda o: o["date_label"] == p["date_label"]).alias("again")))
    return F.transform(F.filter(last, lambda x: ~x["again"]), lambda x: x["p"])


_PARAGRAPH = r"\*\*(.+?)\*\*\s*[—–-]\s*(.*)"


def daily_rows(documents: DataFrame, text: str = "text") -> DataFrame:
    """Daily log to ``section_no, date, project, paragraph``, newest section first (1).

    A section opens at ``## DATE`` and closes at ``---``; a project named twice in a section
    keeps its first place and its last paragraph.  A log is one small document.
    """
    def step(acc: Column, line: Column) -> Column:
        s = py_trim(line)
        opens = s.startswith("## ")
        number = F.when(opens, acc["n"] + 1).otherwise(acc["n"])
        date = F.when(opens, py_trim(F.substr(s, F.lit(4)))).when(s == "---", F.lit(None)).otherwise(acc["date"])
        hit = acc["date"].isNotNull() & ~opens & s.rlike("^" + _PARAGRAPH)
        row = F.struct(acc["n"].alias("section_no"), acc["date"].alias("date"), F.regexp_extract(s, _PARAGRAPH, 1).alias("project"),
                       py_trim(F.regexp_extract(s, _PARAGRAPH, 2)).alias("paragraph"))
        return F.struct(number.alias("n"), date.alias("date"), F.when(hit, F.array_append(acc["rows"], row)).otherwise(acc["rows"]).alias("rows"))

    empty = F.array().cast("array<struct<section_no:int,date:string,project:string,paragraph:string>>")
    zero = F.struct(F.lit(0).alias("n"), F.lit(None).cast("string").alias("date"), empty.alias("rows"))
    rows = F.aggregate(splitlines(F.coalesce(F.col(text), F.lit(""))), zero, step, lambda acc: acc["rows"])
    others = [c for c in documents.columns if c != text]
    spread = documents.select(*others, F.posexplode(rows).alias("_at", "r")).select(*others, "_at", "r.*")
    return spread.groupBy(*others, "section_no", "date", "project").agg(
        F.min("_at").alias("line_no"), F.max_by("paragraph", "_at").alias("paragraph"))
