"""Release ingestion: every arriving snapshot is compared with the one before it."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.checks import GateFailure, enforce
from ..operators.release import release_diff

Gates = Mapping[str, Callable[[DataFrame], DataFrame]]


def ingest_releases(
    spark: SparkSession,
    in_dir: str,
    target: str,
    schema: str,
    release: str = "release",
    gates: Gates | None = None,
    diff: Callable[[DataFrame, DataFrame], DataFrame] = release_diff,
    size: str | None = None,
) -> None:
    """Process all snapshots under ``in_dir`` that were not seen before, then stop.

    Each row names its ``release``; releases sort by name.  For each one, in order, the gates
    run first, then the snapshot is written below ``target/snapshots`` and the changes against
    the previous snapshot below ``target/changes``.  A failed gate stops the stream before
    anything of that release is written.

    A release may arrive in several batches: every batch keeps its rows in a folder of its own,
    which a repeated batch overwrites, and the snapshot is all of them. Where a column ``size`` tells how
    many rows the row's release has, a release waits below ``target/arriving`` until so many are there:
    then the gates see the whole of it, it becomes a snapshot, and its changes are computed, once. More rows
    than announced are refused. Without ``size`` every batch stands for itself, and the changes of its
    release, and of the release after it, are computed anew.
    """
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(in_dir)

    def handle(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        names = [r[0] for r in batch.select(release).distinct().orderBy(release).collect()]
        for name in names:
            rows = batch.filter(F.col(release) == name)
            if size is None:
                snapshot, part = _with_earlier(session, rows.drop(release), f"{target}/snapshots/{release}={name}", number)
            else:
                whole = _gathered(session, rows, f"{target}/arriving/{release}={name}", number)
                there, due = whole.agg(F.count(F.lit(1)), F.max(size)).first()
                if there < due:
                    continue
                if there > due:
                    raise GateFailure(f"release {name}: {there} rows, {due} were announced")
                snapshot, part = whole.drop(release, size), "whole"
            arrived = rows.drop(release) if size is None else snapshot
            enforce({gate: check(snapshot) for gate, check in (gates or {}).items()})
            arrived.write.mode("overwrite").parquet(f"{target}/snapshots/{release}={name}/{part}")
            known = sorted(f.split("=", 1)[1] for f in _folders(session, f"{target}/snapshots") if "=" in f)
            at = known.index(name)
            for old, new in zip(known[max(0, at - 1) : at + 1], known[max(1, at) : at + 2], strict=False):
                both = [
                    session.read.schema(arrived.schema).option("recursiveFileLookup", "true").parquet(
                        f"{target}/snapshots/{release}={n}"
                    )
                    for n in (old, new)
                ]
                diff(*both).write.mode("overwrite").parquet(f"{target}/changes/{release}={new}")

    query = (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", f"{target}/_checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _with_earlier(spark: SparkSession, arrived: DataFrame, folder: str, number: int) -> tuple[DataFrame, str]:
    """The rows of a release that came in other batches and in this one, and the folder of this batch."""
    own = f"batch-{number}"
    earlier = [f"{folder}/{p}" for p in _folders(spark, folder) if p != own]
    if not earlier:
        return arrived, own
    return spark.read.schema(arrived.schema).parquet(*earlier).unionByName(arrived), own


def _gathered(spark: SparkSession, rows: DataFrame, folder: str, number: int) -> DataFrame:
    """All rows of a release that have arrived, after writing those of this batch."""
    rows.write.mode("overwrite").parquet(f"{folder}/batch-{number}")
    return spark.read.schema(rows.schema).option("recursiveFileLookup", "true").parquet(folder)


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path``, none where it does not exist."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    return [s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory()]
