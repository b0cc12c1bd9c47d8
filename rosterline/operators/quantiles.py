"""Exact quantiles per group without bringing a group into one task.

The distinct values of a group are counted, and each wanted rank is then looked for in three steps,
the same for groups of every size: counts of coarse buckets of values tell the bucket that holds
the rank, counts of its fine buckets tell the fine one, and only the distinct values inside that
one are put in order.  A bucket is a fixed, order-keeping function of the value, so no step depends
on a sample or a sketch and none can miss.  Counting combines on the map side; what a task orders is
the buckets of a group, the fine buckets of a bucket, or the values of a fine bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Coarse buckets to a doubling of 1 + |value|, and fine buckets to a coarse one.
COARSE, FINE = 64, 4096


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    measures: Sequence[str],
    quantiles: Sequence[float],
    method: str = "linear",
) -> DataFrame:
    """Rows ``(keys..., measure, n, q_0, q_1, ...)``, one per group and measure with a value.

    ``linear`` interpolates between the two neighbouring values, ``upper`` takes the value at
    rank ``floor(q * n)``.  Rows with a null key or value are left out.
    """
    if method not in ("linear", "upper"):
        raise ValueError(f"unknown method {method!r}")
    ids = [*keys, "measure"]
    given = F.col("v").isNotNull() & ~F.isnan("v")
    for key in keys:
        given &= F.col(key).isNotNull()
    values = (
        df.select(*keys, *[F.col(m).cast("double").alias(m) for m in measures])
        .unpivot(list(keys), list(measures), "measure", "v")
        .filter(given)
        .groupBy(*ids, "v")
        .agg(F.count(F.lit(1)).alias("weight"))
    )
    scaled = F.signum("v") * F.log2(1 + F.abs("v")) * COARSE
    # Always true. The joins below would infer it for themselves, and then count the values again
    # instead of reading the one shuffle of them three times.
    tagged = (
        values.withColumn("coarse", F.floor(scaled))
        .withColumn("fine", F.floor((scaled - F.col("coarse")) * FINE))
        .filter("coarse is not null and fine is not null")
    )

    wanted = _any_rank([_position(q, method) for q in quantiles])
    coarse = tagged.groupBy(*ids, "coarse").agg(F.sum("weight").alias("weight")).select(
        "*", F.sum("weight").over(Window.partitionBy(*ids)).alias("n"), F.lit(0).alias("base")
    )
    coarse = _ranked(coarse, ids, "coarse").filter(wanted).select(
        *ids, "coarse", "n", F.col("before").alias("base")
    )
    fine = tagged.join(coarse, [*ids, "coarse"]).groupBy(*ids, "coarse", "n", "base", "fine").agg(
        F.sum("weight").alias("weight")
    )
    fine = _ranked(fine, [*ids, "coarse"], "fine").filter(wanted).select(
        *ids, "coarse", "fine", "n", F.col("before").alias("base")
    )
    ranked = _ranked(
        tagged.join(fine, [*ids, "coarse", "fine"]), [*ids, "coarse", "fine"], "v"
    )
    picked = ranked.groupBy(*ids, "n").agg(
        *[p for i, q in enumerate(quantiles) for p in _neighbours(i, q, method)]
    )
    return picked.select(
        *ids, "n", *[_value(i, q, method).alias(f"q_{i}") for i, q in enumerate(quantiles)]
    )


def _ranked(counts: DataFrame, part: Sequence[str], order: str) -> DataFrame:
    """Add ``before`` and ``upto``: values of the group up to this row, without and with it.

    ``base`` is the number of values of the group before this part of it.
    """
    in_order = Window.partitionBy(*part).orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    summed = counts.withColumn("upto", F.col("base") + F.sum("weight").over(in_order))
    return summed.withColumn("before", F.col("upto") - F.col("weight"))


def _any_rank(positions: Sequence[Column]) -> Column:
    """Whether a row of ``_ranked`` holds one of the ranks next to the positions."""
    hits = [_holds(rank(p)) for p in positions for rank in (F.floor, F.ceil)]
    wanted = hits[0]
    for hit in hits[1:]:
        wanted |= hit
    return wanted


def _holds(rank: Column) -> Column:
    return (F.col("before") <= rank) & (rank < F.col("upto"))


def _position(q: float, method: str) -> Column:
    return F.lit(q) * (F.col("n") - 1) if method == "linear" else F.least(
        F.floor(F.lit(q) * F.col("n")), F.col("n") - 1
    )


def _neighbours(index: int, q: float, method: str) -> list[Column]:
    """The values at the ranks just below and just above the wanted position."""
    position = _position(q, method)
    return [
        F.max(F.when(_holds(F.floor(position)), F.col("v"))).alias(f"_low_{index}"),
        F.max(F.when(_holds(F.ceil(position)), F.col("v"))).alias(f"_high_{index}"),
    ]


def _value(index: int, q: float, method: str) -> Column:
    low, high = F.col(f"_low_{index}"), F.col(f"_high_{index}")
    position = _position(q, method)
    return low + (high - low) * (position - F.floor(position))
