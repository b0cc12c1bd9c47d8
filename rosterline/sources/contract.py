"""Source contracts, provenance and content fingerprints."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_contract(df: DataFrame, columns: Iterable[str], min_rows: int = 0) -> DataFrame:
    """Return ``df`` when it has the columns and at least ``min_rows`` rows; raise otherwise.

    The row check stops reading as soon as the floor is reached.
    """
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    if min_rows:
        seen = df.limit(min_rows).count()
        if seen < min_rows:
            raise ValueError(f"only {seen} rows, at least {min_rows} are needed")
    return df


def provenance(
    df: DataFrame,
    source: str,
    url: str | None = None,
    as_of: Column | str | None = None,
    retrieved_at: str | None = None,
    local_file: str | None = None,
) -> DataFrame:
    """One row telling where a table came from, what date it speaks to and how big it is."""

    def text(value: Column | str | None) -> Column:
        return value.cast("string") if isinstance(value, Column) else F.lit(value).cast("string")

    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        text(source).alias("source"),
        text(url).alias("url"),
        text(as_of).alias("as_of"),
        text(retrieved_at).alias("retrieved_at"),
        text(local_file).alias("local_file"),
        "rows",
    )


def fingerprint_figures(columns: Iterable[str], algorithm: str = "xxhash64", prefix: str = "") -> list[Column]:
    """Aggregates ``rows`` and ``fingerprint``: the hashes of the rows added up."""
    columns = [F.col(f"{prefix}`{name}`") for name in sorted(columns)]
    if algorithm == "xxhash64":
        row_hash = F.xxhash64(*[c for column in columns for c in (column.isNull(), column)])
    elif algorithm == "md5":
        # Values carry a mark, so that no text looks like a null.
        texts = [F.coalesce(F.concat(F.lit("v"), column.cast("string")), F.lit("n")) for column in columns]
        row_hash = F.conv(F.substring(F.md5(F.concat_ws("\x1f", *texts)), 1, 15), 16, 10).cast("bigint")
    else:
        raise ValueError(f"unknown algorithm {algorithm!r}")
    total = F.coalesce(F.sum(row_hash.cast("decimal(20,0)")), F.lit(0))
    return [F.count(F.lit(1)).alias("rows"), total.cast("decimal(38,0)").cast("string").alias("fingerprint")]


def table_fingerprint(df: DataFrame, algorithm: str = "xxhash64") -> DataFrame:
    """One row ``(rows, fingerprint)`` that does not depend on row order or partitioning.

    Each row is hashed and the hashes are added up, so only two numbers per task are
    shuffled.  ``md5`` gives a value other engines can recompute.
    """
    return df.agg(*fingerprint_figures(df.columns, algorithm))


def fingerprint_table(sources: dict[str, DataFrame], algorithm: str = "xxhash64") -> DataFrame:
    """Fingerprints of several tables, one row per source name."""
    rows = [
        table_fingerprint(df, algorithm).select(F.lit(name).alias("source"), "rows", "fingerprint")
        for name, df in sources.items()
    ]
    return reduce(DataFrame.unionByName, rows)


def changed_sources(old: DataFrame, new: DataFrame) -> DataFrame:
    """Compare two tables of sources: added, removed, changed or unchanged, and what has changed.

    A source is changed by its content (rows and fingerprint) and, where the tables have these columns,
    by its address or its publication date.
    """
    def facts(df: DataFrame, side: str) -> DataFrame:
        said = {c: F.col(c) if c in df.columns else F.lit(None).cast("string") for c in ("url", "published")}
        return df.select("source", F.struct(
            F.struct("rows", "fingerprint").alias("content"), *[v.alias(c) for c, v in said.items()]
        ).alias(side))

    both = facts(old, "before").join(facts(new, "after"), "source", "full_outer")
    known = F.col("before").isNotNull() & F.col("after").isNotNull()
    reasons = F.concat_ws(",", *[
        F.when(known & ~F.col(f"before.{c}").eqNullSafe(F.col(f"after.{c}")), F.lit(c))
        for c in ("content", "url", "published")
    ])
    state = (
        F.when(F.col("before").isNull(), "added")
        .when(F.col("after").isNull(), "removed")
        .when(F.col("reasons") != "", "changed")
        .otherwise("unchanged")
    )
    return both.withColumn("reasons", reasons).select(
        "source",
        state.alias("state"),
        "reasons",
        F.col("before.content.rows").alias("rows_before"),
        F.col("after.content.rows").alias("rows_after"),
    )


def needs_build(old: DataFrame, new: DataFrame, force: bool = False, outputs_exist: bool = True) -> bool:
    """Rebuild when forced, when outputs are missing, or when any source differs."""
    if force or not outputs_exist:
        return True
    return not changed_sources(old, new).filter("state <> 'unchanged'").isEmpty()
