"""Session defaults, the shared work folder and size checks."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Shuffled bytes that one task reads where small partitions are put together; events and keys unfold to eight times as much in memory.
TASK_BYTES = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16m")


def prepare(spark: SparkSession) -> SparkSession:
    """Settings results depend on: instants are UTC, untrusted casts go through ``try_cast``.

    Where the session names no size for the tasks behind a shuffle, they get a quarter of Spark's own: up to
    that size a task, its sorts and its row-wise work would grow with the table.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    name, size = TASK_BYTES
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, size)
    return spark


def build_session(app: str = "daybrook", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@functools.cache
def _own_folder(master: str) -> str:
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="daybrook-")


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder.

    The folder comes from ``spark.checkpoint.dir``.  Only where it is unset and Spark runs in
    one local process one is chosen; a cluster without a shared folder is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or _own_folder(spark.sparkContext.master)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def rows_within(df: DataFrame, limit: int) -> list | None:
    """The rows when there are at most ``limit`` of them, else null; never fetches more."""
    rows = df.take(limit + 1)
    return rows if len(rows) <= limit else None


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several branches read to the shared work folder and read it back.

    A written table is computed once and outlives lost executors.
    """
    path = work_dir(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffles_for(spark: SparkSession, parts: int) -> None:
    """Shuffles start with at least ``parts`` partitions; Spark puts small ones together again.

    A partition is never cut for an aggregate, so with a number that does not follow the table each of them,
    and the memory of the task that sorts it, would grow with the table.
    """
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    spark.conf.set(name, max(parts, int(spark.conf.get(name, None) or spark.conf.get("spark.sql.shuffle.partitions"))))


#: Rows of a split that row-wise work starts from; a narrow row can become a kilobyte and more of events or texts.
SPLIT_ROWS = 100_000


def spread(df: DataFrame, rows: int = SPLIT_ROWS) -> DataFrame:
    """Spread a scan with few or large splits over all cores, with about ``rows`` rows in a split at most.

    Row-wise text work is heavy, and a small single file would run in one task.  Splits of a file grow with
    the table until they have the size that Spark reads at once; a packed file of that size holds millions of
    rows.  A table with enough splits is returned as it is, without a shuffle.
    """
    # counted from the files' footers
    wanted = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    shuffles_for(df.sparkSession, wanted)
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df
