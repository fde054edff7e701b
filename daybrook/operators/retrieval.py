"""Keyword retrieval over journal passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import ASK_CHARS, TOP_K
from ..functions.core import py_trim
from ..functions.text import matches_project, passage_base, tokens

_HEAD = r"^[ \t\x0b\x0c\r\x1c-\x1f\x85\p{Z}]*#"


def markdown_passages(text: Column) -> Column:
    """``array<struct<heading, body>>`` of a markdown text, preamble included, empties left out."""
    chunks = F.split(F.coalesce(text, F.lit("")), "(?m)(?=" + _HEAD + ")", -1)

    def entry(c: Column) -> Column:
        headed = c.rlike(r"\A" + _HEAD[1:])
        first = F.substring_index(c, "\n", 1)
        head = py_trim(F.regexp_replace(py_trim(first), "^#+", ""))
        rest = F.when(c.contains("\n"), F.substr(c, F.length(first) + 2)).otherwise(F.lit(""))
        return F.struct(F.when(headed, head).otherwise(F.lit("")).alias("heading"),
                        py_trim(F.when(headed, rest).otherwise(c)).alias("body"))
    return F.filter(F.transform(chunks, entry), lambda e: (e["heading"] != "") | (e["body"] != ""))


def passages(documents: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Rows ``path, passage_no, source, text`` out of markdown documents."""
    split = documents.select(F.col(path).alias("path"), F.posexplode(markdown_passages(F.col(text))).alias("passage_no", "e"))
    base, heading = passage_base("path"), F.col("e.heading")
    return split.select(
        "path", "passage_no", F.when(heading != "", F.concat(base, F.lit(" › "), heading)).otherwise(base).alias("source"),
        py_trim(F.when(heading != "", F.concat(heading, F.lit("\n"), "e.body")).otherwise(F.col("e.body"))).alias("text")) \
        .where(F.col("text") != "")


def of_project(corpus: DataFrame, project: str) -> DataFrame:
    return corpus.where(matches_project("path", project))


def term_frequencies(corpus: DataFrame, key: str = "pid", text: str = "text") -> DataFrame:
    return corpus.select(key, F.explode(tokens(text)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def score(corpus: DataFrame, questions: DataFrame, *, pid: str = "pid", qid: str = "qid") -> DataFrame:
    """``qid, pid, score`` of every passage that shares a word with a question.

    Ten points for each distinct question word found, plus its uses (five at most per word,
    fifty in all).  Words no question asks for are dropped before anything is shuffled.
    """
    asked = questions.select(qid, F.explode(F.array_distinct(tokens("question"))).alias("term"))
    vocabulary = asked.select("term").distinct()
    words = corpus.select(pid, F.explode(tokens("text")).alias("term")).join(vocabulary, "term", "left_semi")
    tf = words.groupBy(pid, "term").agg(F.least(F.count("*"), F.lit(5)).alias("tf"))
    return tf.join(asked, "term").groupBy(qid, pid).agg(
        (F.count("*") * 10 + F.least(F.sum("tf"), F.lit(50))).cast("double").alias("score"))


def top_passages(scored: DataFrame, corpus: DataFrame, *, k: int = TOP_K, pid: str = "pid", qid: str = "qid") -> DataFrame:
    """Best ``k`` passages of each question: score, then source.

    Every task first keeps its own best ``k`` per question by score, with ties (the rank filter is
    pushed below the shuffle); only those meet their passages, where the source decides ties.
    """
    tied = F.rank().over(Window.partitionBy(qid).orderBy(F.desc("score")))
    near = scored.withColumn("_tied", tied).where(F.col("_tied") <= k).drop("_tied")
    sourced = near.join(corpus.select(pid, "source", "text"), pid)
    rank = F.row_number().over(Window.partitionBy(qid).orderBy(F.desc("score"), "source", pid))
    return sourced.withColumn("rank", rank).where(F.col("rank") <= k)


def within_budget(ranked: DataFrame, max_chars: int = ASK_CHARS, qid: str = "qid") -> DataFrame:
    """Passages in rank order while their total length fits; always one at least."""
    used = F.sum(F.length("text")).over(Window.partitionBy(qid).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("chars_used", used).where((F.col("chars_used") <= max_chars) | (F.col("rank") == 1))


NO_MATCH = "I couldn't find anything in your journal about that."


def answers(selected: DataFrame, questions: DataFrame, qid: str = "qid") -> DataFrame:
    """Answer text without a model: the selected passages (at most ``k``) under their sources."""
    block = F.concat(F.lit("### "), "source", F.lit("\n"), "text", F.lit("\n"))
    rows = selected.groupBy(qid).agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b"), "source"))).alias("p"))
    text = py_trim(F.concat(F.lit("(No model — here are the most relevant journal sections.)\n\n"),
                            F.array_join(F.transform("p", lambda x: x["b"]), "\n")))
    return questions.select(qid).join(rows, qid, "left").select(
        qid, F.coalesce(text, F.lit(NO_MATCH)).alias("answer"),
        F.coalesce(F.transform("p", lambda x: x["source"]), F.array().cast("array<string>")).alias("sources"))
