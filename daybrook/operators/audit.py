"""Leak audit: prove that nothing in a store would be changed by another scrub."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import once, strings
from ..functions.secrets import scrub
from .digest import payload_json


def residual(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key, codes, text`` of texts that scrubbing still changes.

    A placeholder that matches a pattern again is no leak: the text stays the same.
    """
    done = once(texts.select(key, text), _s=scrub(F.coalesce(F.col(text), F.lit(""))))
    return done.where(F.col("_s.text") != F.coalesce(F.col(text), F.lit(""))).select(key, F.col("_s.names").alias("codes"), text)


def stored_texts(events: DataFrame) -> DataFrame:
    """The payload of every event as one text; content addresses are left out."""
    bare = events.withColumn("payload", F.col("payload").withField("diff_ref", F.lit(None).cast("string")))
    return bare.select("event_id", payload_json().alias("text"))


def leaks(events: DataFrame, diffs: DataFrame | None = None) -> DataFrame:
    found = residual(stored_texts(events), "event_id", "text").select(F.col("event_id").alias("name"), "codes", "text")
    if diffs is not None:
        bodies = residual(diffs, "diff_ref", "body").select(F.col("diff_ref").alias("name"), "codes", F.col("body").alias("text"))
        found = found.unionByName(bodies)
    return found


def leak_report(events: DataFrame, diffs: DataFrame | None = None) -> DataFrame:
    """``measure, name, n``: audited rows, leaks, leaks by code, redactions by code."""
    none = strings([])
    marked = once(stored_texts(events.select("event_id", "payload")), _s=scrub("text"))
    audited = marked.select(F.lit("audited").alias("measure"), F.when(
        F.col("_s.text") != F.col("text"), F.col("_s.names")).alias("codes"))
    if diffs is not None:
        more = once(diffs.select("body"), _s=scrub("body"))
        audited = audited.unionByName(more.select(F.lit("audited_diff").alias("measure"), F.when(
            F.col("_s.text") != F.col("body"), F.col("_s.names")).alias("codes")))
    facts = F.concat(
        F.array(F.struct(F.col("measure"), F.lit("").alias("name"))),
        F.when(F.col("codes").isNotNull(), F.array(F.struct(F.lit("leaks").alias("measure"), F.lit("").alias("name"))))
        .otherwise(F.array().cast("array<struct<measure:string,name:string>>")),
        F.transform(F.coalesce("codes", none), lambda c: F.struct(F.lit("leak_type").alias("measure"), c.alias("name"))))
    stamps = events.select(F.explode(F.coalesce("privacy.redactions", none)).alias("name")) \
        .select(F.lit("redaction").alias("measure"), "name")
    return audited.select(F.explode(facts).alias("f")).select("f.measure", "f.name").unionByName(stamps) \
        .groupBy("measure", "name").agg(F.count("*").alias("n"))


def leak_samples(found: DataFrame, n: int, key: str = "name") -> DataFrame:
    """At most ``n`` leaks of each code, the same on every run: ``code, <key>, text``.

    The smallest hashes of code and name are taken.  A task keeps its own smallest before the shuffle, so a
    code of any size sends ``n`` rows a task.
    """
    rows = found.select(F.explode("codes").alias("code"), key, "text")
    place = Window.partitionBy("code").orderBy(F.sha2(F.concat_ws("/", "code", F.col(key).cast("string")), 256), key)
    return rows.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= n).drop("_n")


def is_clean(events: DataFrame, diffs: DataFrame | None = None) -> bool:
    return leaks(events, diffs).isEmpty()
