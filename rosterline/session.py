"""Session settings, how tables that grow are joined, and the two places where an operator may touch the
cluster eagerly."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app_name: str = "rosterline", **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and skew-join splitting switched on."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Streamed sessions of a busy client are merged before they are shuffled.
        .config("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def pin_utc(spark: SparkSession) -> None:
    """Durations, windows and day boundaries are defined in UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named in ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a temporary folder of this machine.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir"
    )
    current = context._jsc.sc().getCheckpointDir()
    if named is None and current.isDefined():
        named = current.get()
    if named is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="rosterline-")
    if not current.isDefined():
        context.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: computed once, kept in the shared folder, survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_few(df: DataFrame, limit: int = 200_000) -> DataFrame:
    """Mark a checkpointed table for broadcast only after counting at most ``limit`` rows.

    Past the limit it is returned unmarked, and Spark joins it by shuffle.
    """
    few = df.limit(limit + 1).count() <= limit
    return F.broadcast(df) if few else df


def by_shuffle(df: DataFrame) -> DataFrame:
    """Mark a side that grows with the input for a sorted join, never a broadcast.

    Spark reckons the size of a table from its compressed files, and of one with exploded or built columns
    from that: it can take hundreds of megabytes for a few and collect them on the driver.
    """
    return df.hint("merge")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows out by their keys before a step that multiplies them.

    A small compressed file is one or two tasks whatever its number of rows.
    """
    return df.repartition(*keys)
