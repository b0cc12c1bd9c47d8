"""Privacy-safe profiles: events rolled up per entity with small cells suppressed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import AGE_BANDS, SUPPRESSION_THRESHOLD, TOP_VALUES, WINDOW_DAYS
from ..functions.base import as_col
from ..functions.dates import age_at, band, duration_days
from ..functions.numeric import gated_ratio, suppress
from ..session import by_shuffle, cut_lineage
from .frames import top_rows_per_key, trailing_window
from .quantiles import group_quantiles

BASIS_COLUMNS = {
    "longest": "detention_facility_code_longest",
    "first": "detention_facility_code_first",
    "last": "detention_facility_code_last",
}


def suppressed_count(
    column: Column | str | None = None, threshold: int = SUPPRESSION_THRESHOLD
) -> Column:
    """Aggregate: the publishable number of non-null values (of rows when no column is given)."""
    return suppress(F.count(F.lit(1) if column is None else as_col(column)), threshold)


def gated_median(
    column: Column | str, threshold: int = SUPPRESSION_THRESHOLD, digits: int = 1
) -> Column:
    """Aggregate: exact median, null below ``threshold`` values.

    For columns with a bounded number of distinct values; ``group_quantiles`` is for the rest.
    """
    return gated_quantile(column, 0.5, threshold, digits)


def gated_quantile(
    column: Column | str, q: float, threshold: int = SUPPRESSION_THRESHOLD, digits: int = 1
) -> Column:
    """Aggregate: exact interpolated quantile of a bounded-domain column, gated by count."""
    col = as_col(column)
    return F.when(F.count(col) >= threshold, F.bround(F.percentile(col, q), digits))


def with_known_key(df: DataFrame, key: str) -> DataFrame:
    col = F.col(key)
    return df.filter(col.isNotNull() & (col.cast("string") != ""))


def value_counts(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Raw ``(key, dim, value, n)`` for several columns in one shuffle; nulls are left out.

    Raw counts are for further ranking only: suppress before they leave the pipeline.
    """
    texts = df.select(key, *[F.col(c).cast("string").alias(c) for c in columns])
    long = texts.unpivot([key], list(columns), "dim", "value")
    return long.filter("value is not null").groupBy(key, "dim", "value").agg(F.count(F.lit(1)).alias("n"))


def suppress_counts(counts: DataFrame, threshold: int = SUPPRESSION_THRESHOLD) -> DataFrame:
    """Replace the raw count by its publishable form."""
    return counts.withColumn("n", suppress("n", threshold))


def band_histogram(
    df: DataFrame, key: str, band_column: str, threshold: int = SUPPRESSION_THRESHOLD
) -> DataFrame:
    """Non-empty bands per entity, suppressed."""
    return suppress_counts(value_counts(df, key, [band_column]), threshold)


def top_values(
    df: DataFrame, key: str, column: str, k: int = TOP_VALUES, threshold: int = SUPPRESSION_THRESHOLD
) -> DataFrame:
    """The k most frequent values per entity, ranked on true counts and suppressed after."""
    counts = value_counts(df, key, [column])
    best = top_rows_per_key(counts, [key], [F.col("n").desc(), F.col("value")], k)
    return suppress_counts(best, threshold)


def distinct_people(df: DataFrame, key: str, person: str) -> DataFrame:
    """Exact number of people per entity; a sketch could cross the threshold."""
    pairs = df.filter(F.col(person).isNotNull()).groupBy(key, person).agg(F.lit(1).alias("one"))
    return pairs.groupBy(key).agg(F.count("one").alias("unique_people"))


def person_amounts(df: DataFrame, key: str, person: str, amount: str) -> DataFrame:
    """One row per entity and person with the person's lowest amount (null if none is known)."""
    known = df.filter(F.col(person).isNotNull())
    return known.groupBy(key, person).agg(F.min(amount).alias(amount))


def person_level_median(
    df: DataFrame,
    key: str,
    person: str,
    amount: str,
    threshold: int = SUPPRESSION_THRESHOLD,
    digits: int = 2,
) -> DataFrame:
    """Median over people of each one's lowest amount, gated, with how many people have one."""
    lowest = person_amounts(df, key, person, amount)
    medians = group_quantiles(lowest, [key], [amount], [0.5])
    return medians.select(
        key,
        suppress("n", threshold).alias("people_with_amount"),
        F.when(F.col("n") >= threshold, F.bround("q_0", digits)).alias("person_median"),
    )


def person_share(
    df: DataFrame, key: str, person: str, amount: str, threshold: int = SUPPRESSION_THRESHOLD
) -> DataFrame:
    """Share of people with a known amount; null when either count is below the threshold."""
    people = person_amounts(df, key, person, amount)
    counts = people.groupBy(key).agg(
        F.count(F.lit(1)).alias("people"), F.count(amount).alias("with_amount")
    )
    return counts.select(
        key,
        suppress("people", threshold).alias("unique_people"),
        gated_ratio("with_amount", "people", threshold).alias("share"),
    )


def derive_stay_columns(
    df: DataFrame,
    start: str,
    end: str,
    birth_year: str,
    bands: Sequence[tuple[float, float, str]] = AGE_BANDS,
) -> DataFrame:
    """Add age, age_band and los_days."""
    with_age = df.withColumns(
        {"age": age_at(start, birth_year), "los_days": duration_days(start, end)}
    )
    return with_age.withColumn("age_band", band("age", bands))


def profile(
    df: DataFrame,
    key: str,
    person: str,
    dims: Mapping[str, str],
    top_dims: Mapping[str, str],
    amount_set: str,
    amount_posted: str,
    threshold: int = SUPPRESSION_THRESHOLD,
    k: int = TOP_VALUES,
    keep: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Per-entity profile of events that already carry age, age_band and los_days.

    Returns ``stats`` (one wide row per entity) and ``cells`` (long suppressed counts
    ``key, dim, value, n``).  ``dims`` and ``top_dims`` map a published dimension name to
    its column.  ``stays_in_window`` is published raw by design.

    The events are read five times.  A pruned parquet scan is best simply read again; set
    ``keep`` when they come out of a join, and they are checkpointed first.
    """
    columns = {**dims, **top_dims}
    df = with_known_key(df, key).select(
        key, F.col(person).alias("_person"), "age", "los_days",
        F.col(amount_set).alias("_set"), F.col(amount_posted).alias("_posted"),
        F.col("age_band").alias("age_bands"),
        *[F.col(column).alias(name) for name, column in columns.items()],
    )
    if keep:
        df = cut_lineage(df)
    people = df.groupBy(key, "_person").agg(
        F.count(F.lit(1)).alias("stays"), F.count("age").alias("ages"),
        F.count("los_days").alias("completed"), F.count("_set").alias("set"),
        F.count("_posted").alias("posted"), F.min("_set").alias("lowest"),
    )
    known = F.col("_person").isNotNull()
    counted = people.groupBy(key).agg(
        F.sum("stays").alias("stays_in_window"),
        suppress(F.sum("ages"), threshold).alias("age_known"),
        suppress(F.sum("completed"), threshold).alias("n_completed"),
        suppress(F.sum("set"), threshold).alias("n_set"),
        suppress(F.sum("posted"), threshold).alias("n_posted"),
        F.count("_person").alias("people"),
        F.count_if(known & F.col("lowest").isNotNull()).alias("with_amount"),
    )
    digits = {"age": 1, "los_days": 1, "_set": 2, "_posted": 2, "lowest": 2}

    def figure(measure: str, q: int, name: str) -> Column:
        wanted = (F.col("measure") == measure) & (F.col("n") >= threshold)
        return F.max(F.when(wanted, F.bround(F.col(f"q_{q}"), digits[measure]))).alias(name)

    spread = group_quantiles(df, [key], ["age", "los_days", "_set", "_posted"], [0.5, 0.9])
    figures = spread.groupBy(key).agg(
        figure("age", 0, "age_median"),
        figure("los_days", 0, "los_median"), figure("los_days", 1, "los_p90"),
        figure("_set", 0, "median_set"), figure("_posted", 0, "median_posted"),
    )
    person_figures = group_quantiles(people.filter(known), [key], ["lowest"], [0.5]).groupBy(key).agg(
        figure("lowest", 0, "person_median_set")
    )
    stats = counted.join(by_shuffle(figures), key, "left").join(by_shuffle(person_figures), key, "left").select(
        "*",
        suppress("people", threshold).alias("unique_people"),
        suppress("with_amount", threshold).alias("people_with_recorded_set"),
        gated_ratio("with_amount", "people", threshold).alias("person_recorded_set_share"),
    ).drop("people", "with_amount")

    cells = value_counts(df, key, ["age_bands", *dims])
    if top_dims:
        ranked = top_rows_per_key(
            value_counts(df, key, list(top_dims)), [key, "dim"],
            [F.col("n").desc(), F.col("value")], k,
        )
        cells = cells.unionByName(ranked)
    return stats, suppress_counts(cells, threshold)


def windowed_profile(
    events: DataFrame,
    basis: str = "longest",
    days: int = WINDOW_DAYS,
    threshold: int = SUPPRESSION_THRESHOLD,
) -> tuple[DataFrame, DataFrame]:
    """The whole roll-up of a stay table: window, derived columns, profile.

    ``basis`` picks which of the three attributions of a stay is used.
    """
    start, end = "stay_book_in_date_time", "stay_book_out_date_time"
    window = trailing_window(events, start, days)
    stays = derive_stay_columns(window, start, end, "birth_year")
    return profile(
        stays.withColumnRenamed(BASIS_COLUMNS[basis], "code"),
        "code",
        "unique_identifier",
        dims={
            "gender": "gender",
            "release_reason": "stay_release_reason",
            "book_in_criminality": "book_in_criminality",
            "classification": "detainee_classification",
        },
        top_dims={"top_citizenship": "citizenship_country"},
        amount_set="initial_bond_set_amount_lowest_seen",
        amount_posted="bond_posted_amount_lowest_seen",
        threshold=threshold,
    )


def window_metadata(events: DataFrame, ts: str, days: int = WINDOW_DAYS) -> DataFrame:
    """One row: rows read, newest date and the first date of the window."""
    newest = F.max(ts).cast("date")
    return events.agg(
        F.count(F.lit(1)).alias("rows_total"),
        newest.cast("string").alias("data_cutoff"),
        F.date_sub(newest, days).cast("string").alias("window_start"),
    )


def value_frequency(
    df: DataFrame, key: str, value: str, column: str, check: bool = True
) -> DataFrame:
    """Audit of one entity's figure: every amount with its count, ascending, and the median.

    Recomputes the published median by another route, from the frequency table.
    """
    chosen = df.filter(F.col(key) == value)
    if check and chosen.isEmpty():
        raise ValueError(f"no rows for {key} = {value!r}")
    known = chosen.filter(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double")))
    counts = known.groupBy(F.col(column).alias("amount")).agg(F.count(F.lit(1)).alias("n"))
    middle = group_quantiles(known.select(F.col(column).alias("amount")), [], ["amount"], [0.5])
    return counts.select(
        "amount",
        "n",
        counts.select(F.sum("n")).scalar().alias("records"),
        middle.select("q_0").scalar().alias("median"),
    ).orderBy("amount")
