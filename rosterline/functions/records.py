"""Nested record parts: categories, map links and location statements."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import (
    BOOKING_CATEGORIES, DERIVED_LOCATION_NOTE, PRECISION_NOTES, UNPLACED_NOTE,
)
from .base import as_col, literal_map


def category_struct(
    code: Column | str, categories: Mapping[str, tuple[str, str]] = BOOKING_CATEGORIES
) -> Column:
    """``{code, label, note}`` of a category; label and note are null for an unknown code."""
    code = as_col(code)
    labels = literal_map({k: v[0] for k, v in categories.items()})
    notes = literal_map({k: v[1] for k, v in categories.items()})
    return F.struct(
        code.alias("code"),
        F.try_element_at(labels, code).alias("label"),
        F.try_element_at(notes, code).alias("note"),
    )


def geo_uri(lat: Column | str, lon: Column | str) -> Column:
    """A directions link, only for a published coordinate."""
    point = F.concat_ws(",", as_col(lat).cast("string"), as_col(lon).cast("string"))
    both = as_col(lat).isNotNull() & as_col(lon).isNotNull()
    return F.when(both, F.concat(F.lit("geo:"), point, F.lit("?q="), point))


def location_fields(
    lat: Column | str,
    lon: Column | str,
    located: Column | str,
    notes: Mapping[str, str] = PRECISION_NOTES,
) -> Column:
    """How a row got its point: a struct of coordinates, precision, sentence and source.

    A published coordinate always wins.  ``located`` is the struct made by the geocoder.
    """
    lat, lon, located = as_col(lat), as_col(lon), as_col(located)
    exact = lat.isNotNull() & lon.isNotNull()
    derived = ~exact & located.isNotNull()
    template = F.coalesce(
        F.try_element_at(literal_map(notes), located["precision"]), F.lit(notes["city_centroid"])
    )
    return F.struct(
        F.when(exact, lat).otherwise(located["latitude"]).alias("latitude"),
        F.when(exact, lon).otherwise(located["longitude"]).alias("longitude"),
        F.when(exact, F.lit("exact"))
        .when(derived, located["precision"])
        .otherwise(F.lit("none"))
        .alias("location_precision"),
        F.when(derived, located["matched_to"]).alias("location_matched_to"),
        F.when(derived, F.replace(template, F.lit("{place}"), located["matched_to"]))
        .when(~exact, F.lit(UNPLACED_NOTE))
        .alias("location_note"),
        F.when(exact, F.lit(0)).otherwise(F.lit(1)).alias("approx"),
        F.when(derived, located["source"]).alias("location_source"),
        F.when(derived, F.lit(DERIVED_LOCATION_NOTE)).alias("location_source_note"),
    )
