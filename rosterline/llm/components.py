"""Connected components of a link table by alternating stars, all in joins and groupings.

Every round connects the larger neighbours of a node to its smallest one (large star), then its
smaller neighbours (small star); the links end as stars around the smallest node of a component
after a number of rounds that grows with the logarithm of the longest chain. Rounds are written to
the shared folder. Minima combine before the shuffle; a node with very many links is one row of the
unique side of a join, whose other side adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star step over links (a, b), a > b."""
    if large:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = links
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    return out.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b) of longs; component is its least node.

    Null nodes and links of a node to itself are ignored. An empty table gives an empty result.
    """
    sign = (F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    now = store(
        links.filter("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "links",
    )
    seen = now.agg(*sign).first()
    while seen[0]:
        now = store(_star(_star(now, True), False), "links")
        new = now.agg(*sign).first()
        if tuple(new) == tuple(seen):
            break
        seen = new
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
