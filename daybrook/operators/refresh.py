"""Change-driven rebuild: a versioned table of what depends on what, and writing only what changed.

The nodes are project days, their weeks and months, and one report a project.  A day's fingerprint
comes from its events, every other one from the fingerprints below it, so a change moves up exactly
the path it touches.  A version writes only changed nodes, into a folder of its own; the node table
says for each node which version holds it, and is written last.  A run that dies before that leaves
the old state untouched, a run without changes writes nothing at all.

    root/nodes/v=…                                  the dependency table
    root/lines/v=…/project_id=…/date_key=…          archive lines of a day
    root/periods/v=…/granularity=…/period_key=…     lines of a project's week or month
    root/reports/v=…                                lines of a project's report
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import period_key, period_label
from ..session import materialize
from ..sinks import store
from . import rollup
from .attribution import in_projects

_KEY = ["project_id", "level", "key"]
PERIODS = ("week", "month")
_LINE = "section_no int, o_class int, o_ts string, o_unparsed boolean, o_at timestamp, o_recv string, o_id string, o_pos int, text string"
#: Keys are text, whatever they look like.
_STORED = {"lines": f"date_label string, {_LINE}, v bigint, project_id string, date_key string",
           "periods": f"date_key string, date_label string, {_LINE}, v bigint, granularity string, project_id string, period_key string",
           "reports": "project_id string, period_key string, text string, v bigint"}


def graph(attributed: DataFrame) -> DataFrame:
    """``project_id, level, key, n_events, n_days, fingerprint`` per day, week, month and project."""
    rows = in_projects(attributed).withColumn("project_id", F.col("attribution.project_id"))
    days = rollup.fingerprint(rows, ["project_id", "date_key"], rollup.event_text())
    days = days.select("project_id", F.lit("day").alias("level"), F.col("date_key").alias("key"), F.col("n_rows").alias("n_events"), F.lit(1).cast("bigint").alias("n_days"), "fingerprint")
    days = materialize(days, "day-nodes")
    facet = F.explode(F.array(*(F.struct(F.lit(g).alias("level"), period_key("key", g).alias("key")) for g in PERIODS), F.struct(F.lit("project").alias("level"), F.lit("").alias("key"))))
    below = days.select("project_id", facet.alias("up"), F.concat_ws(" ", "key", "fingerprint").alias("said"), "n_events")
    below = below.select("project_id", "up.level", "up.key", "said", "n_events")
    sums = below.groupBy(*_KEY).agg(F.sum("n_events").alias("n_events"))
    upper = rollup.fingerprint(below, _KEY, F.col("said")).withColumnRenamed("n_rows", "n_days").join(sums, _KEY)
    return days.unionByName(upper)


def newest(spark: SparkSession, root: str) -> int:
    """The version that stands; 0 before the first."""
    if store.load_state(spark, f"{root}/nodes") is None:
        return 0
    return spark.read.parquet(f"{root}/nodes").agg(F.max("v")).first()[0]


def nodes(spark: SparkSession, root: str) -> DataFrame:
    """The dependency table that stands."""
    return store.load_state(spark, f"{root}/nodes").where("level <> 'root'")


def changes(fresh: DataFrame, old: DataFrame | None) -> DataFrame:
    """Nodes with ``action``: ``written``, ``removed`` or ``kept``; kept nodes know the version that holds them."""
    if old is None:
        return fresh.withColumns({"action": F.lit("written"), "held": F.lit(None).cast("bigint")})
    before = old.select(*_KEY, *(F.col(c).alias(f"old_{c}") for c in ("n_events", "n_days", "fingerprint", "held")))
    both = fresh.join(before, _KEY, "full")
    action = F.when(F.col("fingerprint").isNull(), "removed").when(F.col("fingerprint").eqNullSafe(F.col("old_fingerprint")), "kept").otherwise("written")
    return both.select(*_KEY, *(F.coalesce(c, f"old_{c}").alias(c) for c in ("n_events", "n_days", "fingerprint")), action.alias("action"), F.col("old_held").alias("held"))


def day_rows(attributed: DataFrame, changed: DataFrame) -> DataFrame:
    """Events of the project days that have to be written again."""
    days = changed.where("level = 'day' and action = 'written'").select(F.col("project_id").alias("_p"), F.col("key").alias("_d"))
    mine = in_projects(attributed)
    return mine.join(days, (mine["attribution.project_id"] == F.col("_p")) & (mine["date_key"] == F.col("_d")), "left_semi")


def _held(root: str, kind: str, wanted: DataFrame, on: dict[str, str]) -> DataFrame:
    """Stored rows of the nodes in ``wanted`` with its further columns; only the partitions that it names are read."""
    rows = wanted.sparkSession.read.schema(_STORED[kind]).parquet(f"{root}/{kind}")
    match = rows["v"] == wanted["held"]
    for name, key in on.items():
        match = match & (rows[name] == wanted[key])
    return rows.join(wanted, match).drop("v", "held", *on.values())


def read_lines(spark: SparkSession, root: str) -> DataFrame:
    """Archive lines of all days that stand."""
    days = nodes(spark, root).where("level = 'day'").select(F.col("project_id").alias("_p"), F.col("key").alias("_d"), "held")
    return _held(root, "lines", days, {"project_id": "_p", "date_key": "_d"})


def read_periods(spark: SparkSession, root: str, granularity: str) -> DataFrame:
    """Lines of all weeks or months that stand: ``project_id, granularity, period_key, <place>, text``."""
    mine = nodes(spark, root).where(F.col("level") == granularity).select(F.col("project_id").alias("_p"), F.col("key").alias("_k"), F.col("level").alias("_g"), "held")
    return _held(root, "periods", mine, {"granularity": "_g", "project_id": "_p", "period_key": "_k"})


def read_reports(spark: SparkSession, root: str) -> DataFrame:
    mine = nodes(spark, root).where("level = 'project'").select(F.col("project_id").alias("_p"), "held")
    return _held(root, "reports", mine, {"project_id": "_p"})


def period_body(period_lines: DataFrame) -> DataFrame:
    """Body of a period without a model: ``## project``, the project's lines and a gap, projects in order.

    ``part`` sorts heading, lines and gap; lines keep their day and place.
    """
    place = [c for c in rollup.PLACE if c in period_lines.columns]
    keys = ["granularity", "period_key", "project_id"]
    body = period_lines.select(*keys, F.lit(1).alias("part"), "date_key", *place, "text")
    heads = period_lines.select(*keys).distinct().withColumn("x", F.explode(F.array(
        F.struct(F.lit(0).alias("part"), F.concat(F.lit("## "), "project_id").alias("text")), F.struct(F.lit(2).alias("part"), F.lit("").alias("text")))))
    return body.unionByName(heads.select(*keys, "x.part", "x.text"), allowMissingColumns=True)


def period_title(granularity: str, key: Column) -> Column:
    """Heading of a period document."""
    return F.concat(F.lit("# Weekly summary — " if granularity == "week" else "# Monthly summary — "), key)


def refresh(attributed: DataFrame, root: str) -> DataFrame:
    """Bring ``root`` up to date; ``project_id, level, key, action`` of the nodes written or removed.

    Two runs over one root must not overlap.  Nothing is written when no fingerprint changed.
    """
    spark = attributed.sparkSession
    last = newest(spark, root)
    found = materialize(changes(graph(attributed), nodes(spark, root) if last else None), "changes")
    changed = found.where("action <> 'kept'").select(*_KEY, "action")
    if changed.isEmpty():
        return changed
    version = last + 1
    standing = found.where("action <> 'removed'").withColumn("held", F.when(F.col("action") == "written", version).otherwise(F.col("held")).cast("bigint"))
    standing = standing.drop("action")
    order = ["project_id", "date_key", *rollup.PLACE]
    lines = rollup.archive_lines(day_rows(attributed, found))
    # a day of any size is spread by its place
    lines.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("project_id", "date_key").parquet(f"{root}/lines/v={version}")
    days = standing.where("level = 'day'")
    facet = F.explode(F.array(*(F.struct(F.lit(g).alias("g"), period_key("key", g).alias("k")) for g in PERIODS)))
    due = found.where("action = 'written'").where(F.col("level").isin(*PERIODS)).select(F.col("project_id").alias("_p"), F.col("level").alias("granularity"), F.col("key").alias("period_key"))
    wanted = days.select("project_id", "key", "held", facet.alias("f")).select(F.col("project_id").alias("_q"), F.col("key").alias("_d"), "held", F.col("f.g").alias("_g"), F.col("f.k").alias("_k"))
    wanted = wanted.join(due, (F.col("_q") == F.col("_p")) & (F.col("_g") == F.col("granularity")) & (F.col("_k") == F.col("period_key"))).select("_q", "_d", "held", "granularity", "period_key")
    told = _held(root, "lines", wanted, {"project_id": "_q", "date_key": "_d"})
    order = ["granularity", "period_key", *order]
    told = told.repartitionByRange(*order).sortWithinPartitions(*order)
    told.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("granularity", "project_id", "period_key").parquet(f"{root}/periods/v={version}")
    projects = found.where("action = 'written' and level = 'project'").select("project_id")
    months = standing.where("level = 'month'").join(projects, "project_id", "left_semi")
    said = F.concat(F.lit("- "), period_label("key", "month"), F.lit(": "), F.col("n_days").cast("string"), F.lit(" days, "), F.col("n_events").cast("string"), F.lit(" events"))
    months.select("project_id", F.col("key").alias("period_key"), said.alias("text")).write.mode("overwrite").parquet(f"{root}/reports/v={version}")
    # one row that every version has, so that a version without nodes is seen as well
    top = spark.range(1).select(F.lit("").alias("project_id"), F.lit("root").alias("level"), F.lit("").alias("key"))
    store.save_state(standing.unionByName(top, allowMissingColumns=True), f"{root}/nodes", version)
    return changed
