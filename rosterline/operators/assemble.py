"""One nested, provenance-carrying record per registry entity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    ABSENT_GUARD_COUNT, COMPANY_STATUS, MEASURE, MEASURE_NOTE, STALE_NOTE, SUPPRESSION_THRESHOLD,
)
from ..functions.base import blank_to_null
from ..functions.numeric import is_stale, total_skip_null
from ..functions.records import geo_uri, location_fields
from ..session import by_shuffle

POPULATION_PARTS = ("Male Crim", "Male Non-Crim", "Female Crim", "Female Non-Crim")
STAY_LENGTH_MARK = "ALOS"


def attach_attributes(registry: DataFrame, matches: DataFrame, listing: DataFrame,
                      code: str = "code", listing_id: str = "l_id") -> DataFrame:
    """Registry with a struct ``attributes`` of its matched listing row, null without a match.

    Of several listing rows on one code the last one counts, as in the published records.
    """
    fields = [F.col(f"`{c}`") for c in listing.columns if c != listing_id]
    rows = listing.select(F.col(listing_id).alias("l_id"), F.struct(*fields).alias("row"))
    attached = (
        matches.filter(F.col("code").isNotNull()).select("l_id", F.col("code").alias(code))
        .join(by_shuffle(rows), "l_id").groupBy(code).agg(F.max_by("row", "l_id").alias("attributes"))
    )
    return registry.join(by_shuffle(attached), code, "left")


def attach_profiles(registry: DataFrame, profiles: DataFrame, code: str = "code") -> DataFrame:
    """Registry with the profile columns of its entity, null where there is none."""
    return registry.join(by_shuffle(profiles), code, "left")


def orphans(profiles: DataFrame, shipped: DataFrame, code: str = "code") -> DataFrame:
    """Profile keys that the shipped set does not hold."""
    return profiles.select(code).distinct().join(shipped.select(code), code, "left_anti")


def count_value(count: Column) -> Column:
    """A publishable count as it ships: the number itself, or ``{"suppressed": true, "lt": t}``."""
    hidden = F.concat(F.lit('{"suppressed":true,"lt":'), count["lt"].cast("string"), F.lit("}"))
    return F.parse_json(F.when(count["suppressed"], hidden).otherwise(count["n"].cast("string")))


def profile_records(
    stats: DataFrame,
    cells: DataFrame,
    key: str = "code",
    dims: Sequence[str] = (
        "age_bands", "gender", "top_citizenship", "release_reason", "book_in_criminality",
        "classification",
    ),
    window: Mapping[str, str | None] | None = None,
    threshold: int = SUPPRESSION_THRESHOLD,
    basis: str = "longest",
) -> DataFrame:
    """``(key, demographics)``: the two profile tables as one nested struct per entity."""
    window = window or {}
    maps = (
        cells.withColumn("n", count_value(F.col("n")))
        .groupBy(key)
        .pivot("dim", list(dims))
        .agg(F.map_from_entries(F.array_sort(
            F.collect_list(F.struct("value", "n")),
            lambda a, b: F.when(a["value"] < b["value"], -1).when(a["value"] > b["value"], 1).otherwise(0),
        )))
    )

    def shown(column: str) -> Column:
        return count_value(F.col(column)).alias(column)

    record = F.struct(
        F.lit(MEASURE).alias("measure"),
        F.lit(MEASURE_NOTE).alias("measure_note"),
        F.lit(window.get("window_start")).cast("string").alias("window_start"),
        F.lit(window.get("data_cutoff")).cast("string").alias("window_end"),
        F.lit(basis).alias("attribution_basis"),
        F.lit(threshold).alias("suppression_threshold"),
        "stays_in_window", shown("age_known"), "age_median",
        *dims,
        F.struct(
            F.col("los_median").alias("median"), F.col("los_p90").alias("p90"), shown("n_completed")
        ).alias("length_of_stay_days"),
        F.struct(
            "median_set", "median_posted", shown("n_set"), shown("n_posted"),
            shown("unique_people"), shown("people_with_recorded_set"), "person_median_set",
            "person_recorded_set_share",
        ).alias("bond"),
    )
    return stats.join(by_shuffle(maps), key, "left").select(key, record.alias("demographics"))


def assemble(
    registry: DataFrame,
    sources: Mapping[str, Mapping[str, str | None]] | None = None,
    code: str = "code",
) -> DataFrame:
    """``(code, latitude, longitude, properties)`` from a registry that carries ``attributes``,
    ``demographics`` and ``located`` where known.

    Two population vintages stand side by side and are never blended.  ``sources`` names the
    origin of the blocks ``registry``, ``listing`` and ``events``.
    """
    sources = sources or {}
    have = set(registry.columns)
    listing_fields = (
        {f.name: f for f in registry.schema["attributes"].dataType.fields}
        if "attributes" in have else {}
    )

    def own(name: str, kind: str = "string") -> Column:
        return F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)

    def listed(name: str, kind: str = "string") -> Column:
        if name not in listing_fields:
            return F.lit(None).cast(kind)
        return F.col("attributes").getField(name).cast(kind)

    stay_length = next((n for n in listing_fields if STAY_LENGTH_MARK in n), "")
    has_listing = F.col("attributes").isNotNull() if listing_fields else F.lit(False)
    profiled = F.col("demographics").isNotNull() if "demographics" in have else F.lit(False)
    adp = own("average_daily_population_last_year", "double")
    peak = own("max_daily_population_last_year", "double")
    total = total_skip_null(*[listed(p, "double") for p in POPULATION_PARTS])
    stale = F.replace(F.lit(STALE_NOTE), F.lit("{peak}"), F.format_number(peak, 0))
    located = F.col("located") if "located" in have else F.lit(None).cast(
        "struct<latitude: double, longitude: double, precision: string, matched_to: string, source: string>"
    )
    lat, lon = own("latitude", "double"), own("longitude", "double")

    def origin(block: str) -> Column:
        given = sources.get(block, {})
        return F.struct(*[
            F.lit(given.get(part)).cast("string").alias(part) for part in ("source", "url", "as_of", "note")
        ])

    placed = registry.withColumn("_place", location_fields(lat, lon, located))
    place = F.col("_place")
    location_origin = F.struct(
        F.coalesce(place["location_source"], origin("registry")["source"]).alias("source"),
        F.when(place["approx"] == 0, origin("registry")["as_of"]).alias("as_of"),
        place["location_source_note"].alias("note"),
    )
    properties = F.struct(
        adp.alias("adp"),
        listed("Last Final Rating").alias("rating"),
        listed("Type Detailed").alias("contract"),
        F.col(code).alias("code"),
        own("name").alias("name"),
        F.coalesce(blank_to_null(own("address_full")), own("address")).alias("address"),
        *[own(c).alias(c) for c in ("city", "county", "state", "zip", "field_office")],
        own("federal_court_district_of_confinement").alias("federal_court_district"),
        own("federal_court_circuit_of_confinement").alias("federal_court_circuit"),
        F.struct(
            adp.alias("ddp_avg_daily_trailing_year"),
            peak.alias("ddp_max_daily_trailing_year"),
            total.alias("ice_fy_adp_total"),
            listed("Male Crim", "double").alias("ice_fy_adp_male_criminal"),
            listed("Male Non-Crim", "double").alias("ice_fy_adp_male_noncriminal"),
            listed("Female Crim", "double").alias("ice_fy_adp_female_criminal"),
            listed("Female Non-Crim", "double").alias("ice_fy_adp_female_noncriminal"),
            listed("Mandatory", "double").alias("ice_fy_adp_mandatory"),
            F.when(is_stale(total, peak), stale).alias("ddp_figure_stale"),
        ).alias("population"),
        F.struct(*[
            listed(f"Level {x.upper()}", "double").alias(f"level_{x}") for x in "abcd"
        ]).alias("classification_adp"),
        F.struct(
            listed("Type Detailed").alias("contract_type"),
            F.lit(None).cast("string").alias("company"),
            F.lit(COMPANY_STATUS).alias("company_status"),
        ).alias("operator"),
        F.struct(
            listed("Last Inspection Type").alias("last_type"),
            listed("Last Inspection End Date").alias("last_end_date"),
            listed("Last Inspection Standard").alias("last_standard"),
            listed("Last Final Rating").alias("last_rating"),
        ).alias("inspection"),
        listed(stay_length, "double").alias("avg_length_of_stay_days"),
        listed("Guaranteed Minimum", "double").alias("guaranteed_minimum_beds"),
        listed("Male/Female").alias("sex_designation"),
        (F.col("demographics") if "demographics" in have else F.lit(None).cast("string")).alias("demographics"),
        F.struct(F.lit(ABSENT_GUARD_COUNT).alias("guard_count")).alias("not_publicly_reported"),
        F.struct(
            location_origin.alias("location"),
            origin("registry").alias("population.ddp_*"),
            F.when(has_listing, origin("listing")).alias("population.ice_*"),
            F.when(profiled, origin("events")).alias("demographics"),
        ).alias("sources"),
        has_listing.alias("has_ice_attributes"),
        geo_uri(lat, lon).alias("directions_url"),
        *[place[f].alias(f) for f in ("location_precision", "location_matched_to", "location_note", "approx")],
    )
    return placed.select(
        F.col(code).alias("code"), place["latitude"].alias("latitude"),
        place["longitude"].alias("longitude"), properties.alias("properties"),
    )


def coverage_counts(records: DataFrame) -> DataFrame:
    """One row of build figures over assembled records, placed and unplaced together."""
    p = F.col("properties")
    mapped = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    precision = p["location_precision"]
    return records.agg(
        F.count(F.lit(1)).alias("facilities_total"),
        F.count_if(mapped).alias("mapped"),
        F.count_if(~mapped).alias("unplaced"),
        F.count_if(precision == "exact").alias("exact_location"),
        F.count_if(~precision.isin("exact", "none")).alias("approximate_location"),
        F.count_if(mapped & p["has_ice_attributes"]).alias("with_ice_attributes"),
        F.count_if(mapped & p["demographics"].isNotNull()).alias("with_demographics"),
    )


def precision_histogram(records: DataFrame) -> DataFrame:
    per = records.groupBy(F.col("properties.location_precision").alias("location_precision"))
    return per.agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "location_precision")


def build_report(records: DataFrame, report: DataFrame, by_method: DataFrame) -> DataFrame:
    """``(section, figure, value)``: counts, crosswalk figures, methods and precisions.

    The records are read once: one row per precision feeds both counts and histogram.
    """
    p = F.col("properties")
    mapped = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    per = records.groupBy(p["location_precision"].alias("precision")).agg(
        F.count(F.lit(1)).alias("facilities_total"),
        F.count_if(mapped).alias("mapped"),
        F.count_if(~mapped).alias("unplaced"),
        F.count_if(mapped & p["has_ice_attributes"]).alias("with_ice_attributes"),
        F.count_if(mapped & p["demographics"].isNotNull()).alias("with_demographics"),
    )
    total = F.col("facilities_total")
    exact, unknown = F.col("precision") == "exact", F.col("precision") == "none"
    plain = ("facilities_total", "mapped", "unplaced", "with_ice_attributes", "with_demographics")
    figures = {
        **{name: F.col(name) for name in plain},
        "exact_location": F.when(exact, total).otherwise(0),
        "approximate_location": F.when(~exact & ~unknown, total).otherwise(0),
    }

    def entry(section: str, figure: Column, value: Column) -> Column:
        return F.struct(
            F.lit(section).alias("section"), figure.alias("figure"), value.cast("double").alias("value")
        )

    entries = [entry("counts", F.lit(name), value) for name, value in figures.items()]
    entries.append(entry("location_precision", F.col("precision"), total))
    counted = per.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    matched = report.select(
        F.explode(F.array(
            entry("crosswalk", F.lit("total"), F.col("total")),
            entry("crosswalk", F.lit("matched"), F.col("matched")),
            entry("crosswalk", F.lit("rate"), F.bround("rate", 4)),
        )).alias("e")
    ).select("e.*")
    methods = by_method.select(entry("methods", F.col("method"), F.col("n")).alias("e")).select("e.*")
    return (
        counted.groupBy("section", "figure").agg(F.sum("value").alias("value"))
        .unionByName(matched)
        .unionByName(methods)
    )
