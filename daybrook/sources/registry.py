"""Project registry: reading, unpivoting, discovery and enrichment."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import MARKER_APPS
from ..functions.core import blank_to_null, has_text, non_null, py_trim, strings
from ..functions.paths import basename, lexical, plain_remote, remote_address
from ..functions.text import json_object_text, slug_words
from ..operators import ordered

SIGNALS = ("paths", "git_remotes", "jira_prefixes", "keywords", "apps", "domains",
           "window_patterns", "ignore_globs", "entry_extract")
_TEXTS = T.ArrayType(T.StringType())
PROJECT = T.StructType([
    *[T.StructField(n, T.StringType()) for n in ("id", "name", "status", "description", "created", "last_updated")],
    T.StructField("signals", T.StructType([T.StructField(s, _TEXTS) for s in SIGNALS])),
    T.StructField("synthesis", T.StructType([T.StructField("day", T.StringType())])),
])


def read_registry(spark: SparkSession, path: str, template: list[dict] | None = None) -> DataFrame:
    """Registry file (``{"projects": […]}``) as rows; the template stands in when it is missing."""
    wrapper = T.StructType([T.StructField("projects", T.ArrayType(PROJECT))])
    try:
        raw = spark.read.option("multiLine", True).schema(wrapper).json(path)
        return raw.select(F.explode("projects").alias("p")).select("p.*")
    except AnalysisException as error:
        if template is None or error.getCondition() != "PATH_NOT_FOUND":
            raise
    return from_dicts(spark, template)


def from_dicts(spark: SparkSession, projects: list[dict]) -> DataFrame:
    """Inline registry rows."""
    text = spark.createDataFrame([(json.dumps(p),) for p in projects], "v STRING")
    return text.select(F.from_json("v", PROJECT).alias("p")).select("p.*")


def to_dicts(registry: DataFrame) -> list[dict]:
    """The registry as a list on the driver, for a registry that is kept by hand; every operator takes the table as well."""
    return [r.asDict(recursive=True) for r in registry.toLocalIterator()]


def names_of(spark: SparkSession, projects: list[dict]) -> DataFrame:
    return spark.createDataFrame([(p["id"], p.get("name") or p["id"]) for p in projects], "project_id STRING, name STRING")


def signal_rows(registry: DataFrame) -> DataFrame:
    """Lists to rows: ``project_id, kind, ord, value``."""
    kinds = F.explode(F.array(*[F.struct(F.lit(s).alias("kind"), F.col(f"signals.{s}").alias("vals")) for s in SIGNALS]))
    return registry.select(F.col("id").alias("project_id"), kinds.alias("k")) \
        .select("project_id", "k.kind", F.posexplode("k.vals").alias("ord", "value"))


def allowlist_roots(registry: DataFrame, extra: list[str] = ()) -> DataFrame:
    """Every project path plus the extra folders, each once."""
    roots = registry.select(F.explode("signals.paths").alias("root"))
    if extra:
        roots = roots.unionByName(roots.sparkSession.createDataFrame([(e,) for e in extra], "root STRING"))
    return roots.groupBy(lexical("root").alias("_k")).agg(F.min("root").alias("root")).drop("_k")


def new_roots(folders: DataFrame, registry: DataFrame) -> DataFrame:
    """Folders that would become visible: those not registered yet."""
    known = registry.select(F.explode("signals.paths").alias("p")).select(lexical("p").alias("_k")).distinct()
    return folders.withColumn("_k", lexical("folder")).join(known, "_k", "left_anti").drop("_k")


def tracked_remotes(registry: DataFrame) -> DataFrame:
    """``remote, project_id, owner_repo`` of every registered remote; the last entry wins."""
    from ..functions.paths import owner_repo
    rows = registry.select("id", F.posexplode("signals.git_remotes").alias("ord", "r")).where(has_text("r"))
    return rows.groupBy(plain_remote("r").alias("remote")).agg(F.max("id").alias("project_id")) \
        .withColumn("owner_repo", owner_repo("remote"))


def parse_remotes(config_text: Column) -> Column:
    """Addresses out of a git configuration text, origin first, each once."""
    sections = F.filter(F.split(config_text, r"(?m)(?=^\s*\[)", -1), lambda s: s.rlike(r'^\s*\[remote\s+"[^"]+"\]'))

    def urls(section: Column) -> Column:
        found = F.regexp_extract_all(section, F.lit(r"(?m)^[ \t]*url[ \t]*=[ \t]*(.+?)[ \t\r]*$"), F.lit(1))
        return F.filter(F.transform(found, lambda u: remote_address(u)), lambda v: v.isNotNull())

    def of(origin: bool) -> Column:
        return F.flatten(F.transform(F.filter(
            sections, lambda s: s.rlike(r'^\s*\[remote\s+"origin"\]') == F.lit(origin)), urls))
    return F.array_distinct(F.concat(of(True), of(False)))


def read_git_configs(spark: SparkSession, root: str, max_depth: int = 4) -> DataFrame:
    """``path, remotes`` of every ``.git/config`` at most ``max_depth`` folders down.

    Recursive listing skips hidden folders, so the levels are named in one glob.
    """
    levels = ",".join("*/" * d + ".git" for d in range(max_depth + 1))
    raw = spark.read.text(f"{root.rstrip('/')}/{{{levels}}}/config", wholetext=True)
    at = F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/")
    return raw.select(F.regexp_replace(at, "/\\.git/config$", "").alias("path"), parse_remotes(F.col("value")).alias("remotes"))


def slug_id(name: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(blank_to_null(s), F.lit("project"))


def keywords_of(name: Column, title: Column) -> Column:
    words = slug_words(name)
    forms = non_null(F.when(F.size(words) > 0, F.array_join(words, " ")),
                     F.lower(F.replace(name, F.lit("_"), F.lit("-"))), F.lower(name), F.lower(py_trim(title)))
    return F.array_distinct(F.filter(F.transform(forms, lambda v: py_trim(v)), lambda v: v != ""))


def _escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([^A-Za-z0-9_\x80-\uffff])", r"\\$1")


def window_patterns_of(name: Column) -> Column:
    words = slug_words(name)
    spaced = F.when(F.size(words) > 0, F.concat(F.lit(".*"), F.array_join(F.transform(words, _escaped), r"\W*"), F.lit(".*")))
    slug = F.concat(F.lit(".*"), _escaped(F.lower(name)), F.lit(".*"))
    return F.array_distinct(non_null(spaced, slug))


def apps_of(markers: Column) -> Column:
    """Apps suggested by the marker files present."""
    lists = [F.when(F.array_contains(markers, m), strings(apps)).otherwise(strings([])) for m, apps in MARKER_APPS]
    return F.array_distinct(F.concat(*lists))


def discover(repos: DataFrame, registry: DataFrame, today: str) -> DataFrame:
    """New registry rows for repositories not tracked yet.

    ``repos``: ``path, title, remotes ARRAY<STRING>, markers ARRAY<STRING>``.  Ids are made
    unique with ``-2``, ``-3`` …, skipping ids that are taken; a slug that a new row of its
    own claims literally is skipped as well.
    """
    known = registry.select(F.explode("signals.paths").alias("p")).select(lexical("p").alias("_k")).distinct()
    fresh = repos.withColumn("_k", lexical("path")).join(known, "_k", "left_anti").dropDuplicates(["_k"]).drop("_k")
    named = fresh.withColumn("_n", basename("path")).withColumn("_slug", slug_id(F.col("_n")))
    def suffixed(name: str) -> Column:
        return F.struct(F.regexp_replace(name, "-[0-9]+$", "").alias("_slug"), F.regexp_extract(name, "-([0-9]+)$", 1).try_cast("int").alias("n"))
    # Numbers that a slug may not take: those of registered ids ("x" itself is number 1) and of names that new rows claim literally.
    taken = registry.select(F.explode(F.array(F.struct(F.col("id").alias("_slug"), F.lit(1).alias("n")), suffixed("id"))).alias("u"))
    claimed = named.select("_slug").distinct().select(suffixed("_slug").alias("u"))
    stems = taken.unionByName(claimed).select("u.*").where(F.col("n").isNotNull()).groupBy("_slug").agg(F.sort_array(F.collect_set("n")).alias("_used"))
    numbered = ordered.numbered(named, ["_slug"], F.substring("path", 1, 48), [F.col("path")], "_rank")
    ranked = numbered.withColumn("_nth", F.col("_rank").cast("int")).drop("_rank").join(stems, "_slug", "left")
    # The nth free number counted from 1 with the used ones left out.
    free = F.aggregate(F.coalesce("_used", F.array().cast("array<int>")), F.col("_nth"),
                       lambda n, u: F.when(u <= n, n + 1).otherwise(n))
    pid = F.when(free == 1, F.col("_slug")).otherwise(F.concat_ws("-", F.col("_slug"), free.cast("string")))
    remotes = F.coalesce("remotes", strings([]))
    signals = {
        "paths": F.array("path"), "git_remotes": remotes, "jira_prefixes": strings([]),
        "keywords": keywords_of(F.col("_n"), F.col("title")), "apps": apps_of(F.col("markers")),
        "domains": remotes, "window_patterns": window_patterns_of(F.col("_n")),
    }
    sig = F.struct(*[signals.get(s, F.lit(None).cast("array<string>")).alias(s) for s in SIGNALS])
    return ranked.select(
        pid.alias("id"), F.coalesce(blank_to_null("title"), F.col("_n")).alias("name"), F.lit("active").alias("status"),
        F.concat(F.lit("Auto-discovered git repo at "), F.col("path"),
                 F.lit(". Edit this description and tune the signals below.")).alias("description"),
        F.lit(today).alias("created"), F.lit(today).alias("last_updated"), sig.alias("signals"),
        F.lit(None).cast("struct<day:string>").alias("synthesis"))


# Lists an enrichment reply may extend.  Paths and remotes are never among them.
ENRICH_LISTS = ("keywords", "window_patterns", "entry_extract", "domains", "jira_prefixes")


def enrich(registry: DataFrame, replies: DataFrame) -> DataFrame:
    """Merge ``(project_id, reply)`` proposals: description replaced, lists extended, each value once."""
    reply = T.StructType([T.StructField("description", T.StringType()),
                          *[T.StructField(f, T.ArrayType(T.StringType())) for f in ENRICH_LISTS]])
    parsed = replies.select(F.col("project_id").alias("_pid"), F.from_json(json_object_text("reply"), reply).alias("_r")) \
        .groupBy("_pid").agg(F.first("_r").alias("_r"))
    joined = registry.join(parsed, F.col("id") == F.col("_pid"), "left")

    def merged(name: str) -> Column:
        old = F.col(f"signals.{name}")
        if name not in ENRICH_LISTS:
            return old
        said = F.filter(F.transform(F.coalesce(F.col(f"_r.{name}"), strings([])), lambda v: py_trim(v)), lambda v: v != "")
        return F.when(F.size(said) > 0, F.array_distinct(F.concat(F.coalesce(old, strings([])), said))).otherwise(old)

    text = py_trim("_r.description")
    return joined.withColumn("description", F.coalesce(blank_to_null(text), "description")) \
        .withColumn("signals", F.struct(*[merged(s).alias(s) for s in SIGNALS])).drop("_pid", "_r")
