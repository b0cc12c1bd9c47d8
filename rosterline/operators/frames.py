"""Generic frame operators: cleaning, keys, precedence, argmax and ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import WINDOW_DAYS
from ..functions.numeric import null_if_nan
from ..session import by_shuffle, cut_lineage

FLOATS = (T.DoubleType, T.FloatType)
DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def drop_nan(df: DataFrame) -> DataFrame:
    """Turn NaN into null in every floating-point column."""
    return df.select(
        *[
            null_if_nan(f.name).alias(f.name) if isinstance(f.dataType, FLOATS) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def clean(df: DataFrame) -> DataFrame:
    """NaN as null, and dates as ``YYYY-MM-DD`` text."""
    plain = drop_nan(df)
    return plain.select(
        *[
            F.date_format(f.name, "yyyy-MM-dd").alias(f.name)
            if isinstance(f.dataType, DATES)
            else F.col(f.name)
            for f in plain.schema.fields
        ]
    )


def explode_rows(
    df: DataFrame, columns: Sequence[str | Column], values: Column, name: str, position: str | None = None
) -> DataFrame:
    """``columns`` and one row per non-null element of a computed array.

    A plain ``explode`` makes Spark filter on the array first, which evaluates a computed one
    twice more; the outer form with a filter after it evaluates it once.
    """
    each = F.explode_outer(values).alias(name)
    if position is not None:
        each = F.posexplode_outer(values).alias(position, name)
    return df.select(*columns, each).filter(F.col(name).isNotNull())


def trailing_window(
    df: DataFrame, ts: str, days: int = WINDOW_DAYS, align: str = "day"
) -> DataFrame:
    """Rows of the last ``days`` days up to the newest ``ts`` in the data itself.

    The bound is a scalar subquery, so it reaches the parquet scan as a pushed filter.
    ``day`` starts at midnight of the first day, ``instant`` at the same time of day.  The
    start is inclusive and there is no upper bound.
    """
    kind = df.schema[ts].dataType
    newest = F.max(ts)
    if align == "day":
        start = F.date_sub(newest.cast("date"), days).cast(kind)
    elif align == "instant":
        start = (newest - F.make_dt_interval(F.lit(days))).cast(kind)
    else:
        raise ValueError(f"unknown alignment {align!r}")
    return df.filter(F.col(ts) >= df.select(start.alias("start")).scalar())


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """One row: how many rows repeat a key that was already there."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def union_prefer(first: DataFrame, second: DataFrame, key: Sequence[str]) -> DataFrame:
    """All of ``first``, and from ``second`` only the keys that ``first`` lacks."""
    fill = second.join(by_shuffle(first.select(*key)), list(key), "left_anti")
    return first.unionByName(fill)


def argmax_by(df: DataFrame, keys: Sequence[str], by: str, row_id: str) -> DataFrame:
    """The row with the largest ``by`` of each key; the earliest row wins a tie.

    A struct minimum combines on the map side, so a hot key costs no more than others.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.min(F.struct((-F.col(by)).alias("_rank"), F.col(row_id).alias("_row"), F.struct(*rest).alias("_kept")))
    return df.groupBy(*keys).agg(best.alias("_best")).select(*keys, "_best._kept.*")


def first_in_order(df: DataFrame, keys: Sequence[str], row_id: str) -> DataFrame:
    """The first row of each key in source order."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min(F.struct(F.col(row_id).alias("_row"), F.struct(*rest).alias("_kept")))
    return df.groupBy(*keys).agg(first.alias("_first")).select(*keys, "_first._kept.*")


def strict_winner(df: DataFrame, keys: Sequence[str], score: str, item: str) -> DataFrame:
    """The item with the top score of each key, only where no other item shares that score."""
    per_score = df.groupBy(*keys, score).agg(
        F.count(F.lit(1)).alias("n"), F.min(item).alias(item)
    )
    top = F.max(F.struct(score, "n", item)).alias("_top")
    return per_score.groupBy(*keys).agg(top).filter("_top.n = 1").select(
        *keys, F.col(f"_top.{item}").alias(item), F.col(f"_top.{score}").alias(score)
    )


def extremes(df: DataFrame, by: str, tie: Sequence[str], k: int = 3) -> DataFrame:
    """The k lowest and the k highest rows; with fewer than 2k rows some appear twice.

    Both ends are bounded top-k plans, not a sort of the whole table.
    """
    low = df.orderBy(F.col(by).asc(), *tie).limit(k).withColumn("end", F.lit("low"))
    high = df.orderBy(F.col(by).desc(), *[F.col(t).desc() for t in tie]).limit(k)
    return low.unionByName(high.withColumn("end", F.lit("high")))


def top_n(
    df: DataFrame, by: str, row_id: str, n: int = 300, null_as: float = 0
) -> DataFrame:
    """The n largest rows with null counted as ``null_as``; ties stay in load order."""
    return df.orderBy(F.coalesce(F.col(by), F.lit(null_as)).desc(), F.col(row_id)).limit(n)


def sort_missing_last(
    df: DataFrame, key: str, direction: str = "asc", tie: Sequence[str] = ()
) -> DataFrame:
    """Sort with null and empty values last whichever way; text ignores case."""
    if direction not in ("asc", "desc"):
        raise ValueError(f"unknown direction {direction!r}")
    value = F.col(key)
    if isinstance(df.schema[key].dataType, T.StringType):
        value = F.collate(F.when(value != "", F.lower(value)), "UNICODE_CI")
    order = value.asc_nulls_last() if direction == "asc" else value.desc_nulls_last()
    return df.orderBy(order, *tie)


def with_place(df: DataFrame) -> DataFrame:
    """``df`` with ``place``, the position from 1 of every row in the table's own order.

    Rows are numbered inside their partitions and the sizes of the partitions before are added, so a
    sorted table of any size keeps its order as a column without going through one task.
    """
    kept = cut_lineage(df.withColumn("_at", F.monotonically_increasing_id())).withColumn(
        "_part", F.shiftright("_at", 33)
    )
    sizes = kept.groupBy("_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return kept.join(F.broadcast(sizes), "_part").select(
        *df.columns, (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("place")
    )


def ranked_histogram(df: DataFrame, column: str) -> DataFrame:
    """Value counts, most frequent first."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), column)


def key_sets(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Each key once with where it occurs: ``added``, ``removed`` or ``kept``."""
    old = before.select(key).distinct().withColumn("_old", F.lit(True))
    new = after.select(key).distinct().withColumn("_new", F.lit(True))
    place = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed")
    return old.join(new, key, "full_outer").select(key, place.otherwise("kept").alias("membership"))


def top_rows_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each key.  Spark prunes to k per task before it shuffles."""
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("_rank", F.row_number().over(window))
    return ranked.filter(F.col("_rank") <= k).drop("_rank")
