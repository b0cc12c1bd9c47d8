"""What changed between two releases; a figure no longer published is not a fall to zero."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    ATTRIBUTE_LABELS, NOT_PUBLISHED, SWING_MIN_ABS, SWING_MIN_SHARE, UNNAMED,
)
from ..functions.base import blank_to_null
from ..functions.display import display_avg
from .frames import explode_rows

IDENTITY = ("name", "city", "state")


def join_releases(before: DataFrame, after: DataFrame, key: str = "code") -> DataFrame:
    """Full outer join on the key: ``key, was, now`` with a null struct where a side is absent."""

    def side(df: DataFrame, alias: str) -> DataFrame:
        return df.select(key, F.struct(*[c for c in df.columns if c != key]).alias(alias))

    return side(before, "was").join(side(after, "now"), key, "full_outer")


def _label(row: Column, key: Column) -> Column:
    name = F.coalesce(blank_to_null(row["name"]), blank_to_null(key.cast("string")), F.lit(UNNAMED))
    place = F.concat_ws(", ", blank_to_null(row["city"]), blank_to_null(row["state"]))
    return F.when(place != "", F.concat(name, F.lit(" ("), place, F.lit(")"))).otherwise(name)


def _people(value: Column) -> Column:
    return display_avg(value, style="report")


def _change(kind: str, detail: Column, field: str | None = None) -> Column:
    return F.struct(
        F.lit(kind).alias("change_type"),
        F.lit(field).cast("string").alias("field"),
        detail.alias("detail"),
    )


def classify_changes(
    joined: DataFrame,
    key: str = "code",
    value: str = "adp",
    min_abs: float = SWING_MIN_ABS,
    min_share: float = SWING_MIN_SHARE,
    fields: Mapping[str, str] = ATTRIBUTE_LABELS,
) -> DataFrame:
    """``(key, label, change_type, field, detail, old_value, new_value)``, several rows per key.

    Kinds: added, removed, reporting_started, reporting_stopped, swings, attributes.  A swing
    clears both floors; from a published zero only the absolute one applies.
    """
    was, now = F.col("was"), F.col("now")
    both = was.isNotNull() & now.isNotNull()
    old, new = was[value], now[value]
    delta = F.abs(new - old)
    share = F.when(old != 0, F.try_divide(delta, old))
    percent = F.concat(
        F.lit(" ("), F.bround(share * 100, 0).cast("bigint").cast("string"), F.lit("%)")
    )
    swing = F.concat(
        F.when(new > old, "up ").otherwise("down "), _people(delta),
        F.coalesce(percent, F.lit("")), F.lit(", "), _people(old), F.lit(" to "), _people(new),
    )
    is_swing = (delta >= min_abs) & (share.isNull() | (share >= min_share))
    changes = [
        F.when(was.isNull(), _change("added", F.coalesce(
            F.when(new.isNotNull(), F.concat(
                F.lit("new facility, "), _people(new), F.lit(" average daily population"))),
            F.lit("new facility, population not reported"),
        ))),
        F.when(now.isNull(), _change("removed", F.coalesce(
            F.when(old.isNotNull(), F.concat(
                F.lit("no longer in the release, last reported "), _people(old), F.lit(" held"))),
            F.lit("no longer in the release, population was not reported"),
        ))),
        F.when(both & old.isNull() & new.isNotNull(), _change(
            "reporting_started", F.concat(F.lit("population now reported as "), _people(new)))),
        F.when(both & old.isNotNull() & new.isNull(), _change(
            "reporting_stopped", F.concat(F.lit("population no longer reported, was "), _people(old)))),
        F.when(both & is_swing, _change("swings", swing)),
    ]
    for field, description in fields.items():
        shown = [
            F.coalesce(blank_to_null(side[field].cast("string")), F.lit(NOT_PUBLISHED))
            for side in (was, now)
        ]
        text = F.concat(F.lit(description + ": "), shown[0], F.lit(" → "), shown[1])
        changes.append(
            F.when(both & ~was[field].eqNullSafe(now[field]), _change("attributes", text, field))
        )
    label = F.when(now.isNull(), _label(was, F.col(key))).otherwise(_label(now, F.col(key)))
    columns = [key, label.alias("label"), old.alias("old_value"), new.alias("new_value")]
    listed = explode_rows(joined, columns, F.array(*changes), "change")
    return listed.select(key, "label", "change.*", "old_value", "new_value")


def release_diff(before: DataFrame, after: DataFrame, key: str = "code", value: str = "adp",
                 min_abs: float = SWING_MIN_ABS, min_share: float = SWING_MIN_SHARE,
                 fields: Mapping[str, str] = ATTRIBUTE_LABELS) -> DataFrame:
    """All changes between two releases; identical releases give no rows."""
    return classify_changes(
        join_releases(before, after, key), key, value, min_abs, min_share, fields
    )


def release_summary(before: DataFrame, after: DataFrame, changes: DataFrame) -> DataFrame:
    """``(figure, n, as_of)``: both releases' sizes and dates, and the changes of each kind."""

    def size(df: DataFrame, name: str) -> DataFrame:
        day = F.max("as_of") if "as_of" in df.columns else F.lit(None).cast("string")
        counted = df.agg(F.count(F.lit(1)).alias("n"), day.alias("as_of"))
        return counted.select(F.lit(name).alias("figure"), "n", "as_of")

    per_kind = changes.groupBy(F.col("change_type").alias("figure")).agg(
        F.count(F.lit(1)).alias("n"), F.lit(None).cast("string").alias("as_of")
    )
    return size(before, "before").unionByName(size(after, "after")).unionByName(per_kind)
