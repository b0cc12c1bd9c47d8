"""What a reader of the published records asks for: search, facets, shares and map cells."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import DISTRIBUTION_LIMIT
from ..functions.text import matches_text
from .frames import top_rows_per_key

NO_RATING = "__none"


def filter_registry(
    df: DataFrame,
    text: str = "",
    state: str = "",
    contract: str = "",
    rating: str = "",
    exact_only: bool = False,
    text_columns: Sequence[str] = ("name", "city", "county", "state", "code"),
) -> DataFrame:
    """Placed rows that meet every given criterion; an empty criterion does not filter.

    ``rating`` is part of the rating text with exact case, or ``__none`` for rows without one.
    """
    wanted: list[Column] = [F.col("latitude").isNotNull() & F.col("longitude").isNotNull()]
    if text.strip():
        wanted.append(matches_text(text, *text_columns))
    if state:
        wanted.append(F.col("state") == state)
    if contract:
        wanted.append(F.col("contract") == contract)
    if rating == NO_RATING:
        wanted.append(F.coalesce(F.col("rating"), F.lit("")) == "")
    elif rating:
        wanted.append(F.col("rating").contains(rating))
    if exact_only:
        wanted.append(F.col("approx") == 0)
    return df.filter(reduce(and_, wanted))


def facets(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(facet, value)``: the distinct non-empty values of each column, sorted."""
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    long = texts.unpivot([], list(columns), "facet", "value")
    return long.filter(F.coalesce("value", F.lit("")) != "").distinct().orderBy("facet", "value")


def display_distribution(
    cells: DataFrame, keys: Sequence[str], limit: int = DISTRIBUTION_LIMIT
) -> DataFrame:
    """The largest visible values of each distribution with their share of what is shown.

    A suppressed cell counts as zero; the base is at least one.
    """
    visible = cells.withColumn("shown", F.coalesce("n.n", F.lit(0)))
    kept = top_rows_per_key(visible, keys, [F.col("shown").desc(), F.col("value")], limit)
    base = F.greatest(F.sum("shown").over(Window.partitionBy(*keys)), F.lit(1))
    return kept.withColumn("share", F.col("shown") / base)


def grid_rollup(
    df: DataFrame, lat: str = "latitude", lon: str = "longitude", cell: float = 1.0,
    value: str = "adp", rating: str = "rating",
) -> DataFrame:
    """Points, summed average (null as zero) and failed inspections per map cell."""
    placed = df.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    return placed.groupBy(
        F.floor(F.col(lat) / cell).alias("cell_lat"), F.floor(F.col(lon) / cell).alias("cell_lon")
    ).agg(
        F.count(F.lit(1)).alias("points"),
        F.sum(F.coalesce(F.col(value), F.lit(0)).cast("decimal(28,6)")).cast("double").alias("adp_sum"),
        F.count_if(F.col(rating).contains("Fail")).alias("fail_count"),
    )
