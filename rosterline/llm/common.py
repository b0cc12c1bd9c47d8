"""Written tables in the shared folder, and small helpers that several operators use."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import rosterline
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterline.session import shared_dir

#: Arrow batches hold this many rows at most, so that a batch of long texts stays small.
BATCH_ROWS = 256


_recorded: list[str] | None = None


@contextmanager
def recording(paths: list[str]) -> Iterator[None]:
    """Enter the paths of all tables stored inside the block into ``paths``."""
    global _recorded
    outer, _recorded = _recorded, paths
    try:
        yield
    finally:
        _recorded = outer


def drop_stored(spark: SparkSession, paths: list[str]) -> None:
    """Delete stored tables that nothing reads any more, and empty the list."""
    context = spark.sparkContext
    while paths:
        path = context._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and return the reread table.

    The written table cuts the lineage: a lost executor costs no recomputation, and values that
    depend on the evaluation (row ids, hash partitions) are fixed from here on.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _recorded is not None:
        _recorded.append(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per Spark application."""
    context = spark.sparkContext
    if getattr(context, "_rosterline_shipped", False):
        return
    root = Path(rosterline.__file__).resolve().parent.parent
    archive = shutil.make_archive(
        str(Path(tempfile.mkdtemp()) / "rosterline_package"), "zip", root, "rosterline"
    )
    context.addPyFile(archive)
    context._rosterline_shipped = True


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Ready the session for Python stages, and bound the rows of an Arrow batch.

    All texts of a batch are in a worker's memory at once.
    """
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def text_of(column: str = "text") -> Column:
    """The text, null counted as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; all other characters stay as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bit_filter(keys: DataFrame, columns: list[str], bits: int) -> DataFrame:
    """The keys as a filter of ``bits`` bits: rows (_word, _mask), at most bits / 64 of them."""
    slot = F.pmod(F.xxhash64(*columns), F.lit(bits))
    one = F.call_function(
        "shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int")
    )
    return keys.select(F.shiftright(slot, 6).alias("_word"), one.alias("_bit")).groupBy(
        "_word"
    ).agg(F.bit_or("_bit").alias("_mask"))


def maybe_in(df: DataFrame, columns: list[str], words: DataFrame, bits: int) -> DataFrame:
    """``df`` with a boolean ``_maybe``: false only where the filter surely lacks the key.

    The filter has a fixed largest size and is broadcast; ``df`` is not moved. A true value may be
    mistaken, so callers use it only where a needless row costs time and nothing else.
    """
    slot = F.pmod(F.xxhash64(*columns), F.lit(bits))
    marked = df.withColumn("_word", F.shiftright(slot, 6)).join(F.broadcast(words), "_word", "left")
    hit = F.call_function("getbit", F.col("_mask"), slot.bitwiseAND(F.lit(63)).cast("int"))
    return marked.withColumn("_maybe", F.coalesce(hit, F.lit(0)) == 1).drop("_word", "_mask")
