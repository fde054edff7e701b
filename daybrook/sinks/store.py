"""Partitioned stores: gated log, diff bodies, accounts, journal tables, run state."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import once
from ..functions.dates import date_key
from ..functions.paths import safe_segment
from ..operators import gate
from ..session import materialize, work_dir


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path).schema
        return True
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise


def append_events(gated: DataFrame, root: str, batch: str | None = None) -> None:
    """Kept rows under ``events/batch_id=…/date_key=…``, drop facts under ``drops``, new diff bodies once.

    A batch owns its folders: one that runs again after a failure replaces what it wrote.
    Without a name the batch is a new one.  The gate's output is written once and read back:
    the three sinks share one evaluation.
    """
    batch = batch or uuid.uuid4().hex
    spark = gated.sparkSession
    stage = work_dir(spark, "gate")
    gated.write.mode("overwrite").parquet(stage)
    rows = spark.read.schema(gated.schema).parquet(stage)
    kept = gate.kept(rows)
    events = kept.drop("diff_clean")
    if "date_key" not in events.columns:
        events = events.withColumn("date_key", date_key("ts_wall"))
    events.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("date_key").parquet(f"{root}/events/batch_id={batch}")
    gate.dropped(rows).write.mode("overwrite").parquet(f"{root}/drops/batch_id={batch}")
    append_diffs(kept, f"{root}/diffs", batch)


_BODY = "diff_ref string, body string, shard string, batch_id string"


def append_diffs(kept: DataFrame, path: str, batch: str | None = None) -> None:
    """Insert bodies that are not there yet, by content hash, below ``shard=…/batch_id=…``.

    A shard is the first two digits of the hash.  A batch opens only the shards that its hashes name, and
    not what it wrote itself: one that runs again replaces its own files.
    """
    from ..operators.diffs import sidecars
    spark, batch = kept.sparkSession, batch or uuid.uuid4().hex
    fresh = materialize(sidecars(kept).withColumn("shard", F.substring("diff_ref", 1, 2)), "sidecars")
    # 256 shards at most
    shards = [row["shard"] for row in fresh.select("shard").distinct().collect()]
    if shards and _exists(spark, path):
        stored = spark.read.schema(_BODY).parquet(path).where(F.col("shard").isin(shards) & (F.col("batch_id") != batch))
        fresh = fresh.join(stored.select("diff_ref"), "diff_ref", "left_anti")
    overwrite_partitions(fresh.withColumn("batch_id", F.lit(batch)).repartition("shard"), path, "shard", "batch_id")


def read_diffs(spark: SparkSession, path: str) -> DataFrame:
    """``diff_ref, body``, each once: where two writers stored a body at the same time, either copy is the same."""
    return spark.read.schema(_BODY).parquet(path).groupBy("diff_ref").agg(F.min_by("body", "batch_id").alias("body"))


def read_events(spark: SparkSession, root: str, date: str | None = None) -> DataFrame:
    """Stored events; one date reads one partition."""
    rows = spark.read.parquet(f"{root}/events").drop("batch_id")
    return rows.where(F.col("date_key") == date) if date else rows


def route_accounts(rows: DataFrame, tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a ``token`` to their account; unknown tokens are set apart.

    ``tokens`` holds ``token_sha256, account``: the token itself is never stored.
    """
    keyed = rows.withColumn("_t", F.when(F.col("token") != "", F.sha2("token", 256)))
    joined = keyed.join(tokens.select(F.col("token_sha256").alias("_t"), "account"), "_t", "left").drop("_t", "token")
    return joined.where(F.col("account").isNotNull()), joined.where(F.col("account").isNull()).drop("account")


def account_rows(rows: DataFrame) -> DataFrame:
    """Rows with the safe account folder name and the date they are filed under."""
    return once(rows, account=safe_segment("account"), date_key=date_key("ts_wall"))


def append_accounts(rows: DataFrame, root: str) -> None:
    account_rows(rows).write.mode("append").partitionBy("account", "date_key").parquet(root)


def read_since(store: DataFrame, account: str, since: str | None = None) -> DataFrame:
    """Rows of one account; ``since`` compares as text, as the wall clock is text."""
    mine = store.where(F.col("account") == account)
    return mine.where(F.coalesce("ts_wall", F.lit("")) >= since) if since else mine


def intake(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Device sync: rows with a privacy stamp are accepted and scrubbed again, others blocked."""
    return gate.sendable(rows), gate.blocked(rows)


def overwrite_partitions(df: DataFrame, path: str, *partition: str) -> None:
    """Replace only the partitions present in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


def append_daily(df: DataFrame, path: str, run_seq: int) -> None:
    """Daily paragraphs of a run (``run_date, project_id, paragraph``).  A re-run appends
    again; readers take the newest run first."""
    df.withColumn("run_seq", F.lit(run_seq).cast("bigint")).write.mode("append").parquet(path)


def latest_daily(daily: DataFrame) -> DataFrame:
    """Each date's newest run only."""
    newest = daily.groupBy("run_date").agg(F.max("run_seq").alias("run_seq"))
    return daily.join(newest, ["run_date", "run_seq"])


def save_state(state: DataFrame, root: str, version: int) -> None:
    """Run state as a new version folder; a version becomes visible when it is complete."""
    state.write.mode("errorifexists").parquet(f"{root}/v={version}")


def load_state(spark: SparkSession, root: str) -> DataFrame | None:
    """Newest complete version, or null before the first run."""
    if not _exists(spark, root):
        return None
    rows = spark.read.parquet(root)
    newest = rows.agg(F.max("v")).first()[0]
    return rows.where(F.col("v") == newest).drop("v")


def export_lines(lines: DataFrame, path: str, keys: list[str], order: list[str]) -> None:
    """Markdown export: lines sorted by a range shuffle, one folder per project."""
    placed = lines.repartitionByRange(*[F.col(c) for c in (*keys, *order)]).sortWithinPartitions(*keys, *order)
    placed.select(keys[0], F.col("text").alias("value")).write.mode("overwrite").partitionBy(keys[0]).text(path)
