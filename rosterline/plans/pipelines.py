"""The three end-to-end plans: profile the stays, build the release, refresh the publication."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import (
    CAMPAIGN_FIELDS, MIN_EVENT_ROWS, MIN_LISTING_ROWS, MIN_REGISTRY_ROWS, SUPPRESSION_THRESHOLD,
)
from ..operators import assemble as asm
from ..operators import campaign, checks, geocode, linkage, profile
from ..session import cut_lineage, pin_utc
from ..sources import contract, manifest, readers, sinks

KEY = "detention_facility_code"
REGISTRY_COLUMNS = (KEY, "name", "state", "latitude", "longitude", "average_daily_population_last_year")
STAY_TIMES = ("stay_book_in_date_time", "stay_book_out_date_time")
STAY_COLUMNS = (
    "unique_identifier", *profile.BASIS_COLUMNS.values(), *STAY_TIMES, "birth_year", "gender",
    "citizenship_country", "stay_release_reason", "book_in_criminality",
    "detainee_classification", "initial_bond_set_amount_lowest_seen",
    "bond_posted_amount_lowest_seen",
)
LISTING_NUMBERS = (
    *asm.POPULATION_PARTS, "Mandatory", "Level A", "Level B", "Level C", "Level D", "Guaranteed Minimum",
)


@dataclass(frozen=True)
class SourcePaths:
    """Where the sources lie.  Overrides and campaigns may be absent."""

    registry: str
    listing: str
    stays: str
    places: str
    counties: str
    key_overrides: str
    location_overrides: str
    campaigns: str | None = None
    #: Address and publication date of a source by its name, where its publisher gives them.
    urls: Mapping[str, str] = field(default_factory=dict)
    published: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class RowFloors:
    """Fewest rows a source may have before a build refuses it."""

    registry: int = MIN_REGISTRY_ROWS
    listing: int = MIN_LISTING_ROWS
    stays: int = MIN_EVENT_ROWS


def load_stays(spark: SparkSession, path: str, floor: int = MIN_EVENT_ROWS) -> DataFrame:
    stays = readers.load_events(spark, path, STAY_COLUMNS, STAY_TIMES)
    return contract.require_contract(stays, STAY_COLUMNS, floor)


def load_registry(spark: SparkSession, path: str, floor: int = MIN_REGISTRY_ROWS) -> DataFrame:
    """The registry with its row order; checkpointed, so that the order is the same everywhere."""
    rows = readers.load_registry(spark, path, KEY, order="r_order")
    return cut_lineage(contract.require_contract(rows, REGISTRY_COLUMNS, floor).withColumnRenamed(KEY, "code"))


def load_listing(spark: SparkSession, path: str, floor: int = MIN_LISTING_ROWS) -> DataFrame:
    """The listing with typed figures and a row id; checkpointed, so that the id is stable."""
    rows = contract.require_contract(
        readers.read_located_header(spark, path, ["name", "address"]), ["Name", "State"], floor
    )
    numbers = {c for c in rows.columns if c in LISTING_NUMBERS or asm.STAY_LENGTH_MARK in c}
    typed = rows.select(
        F.monotonically_increasing_id().alias("l_id"),
        *[
            (F.col(f"`{c}`").try_cast("double") if c in numbers else F.col(f"`{c}`")).alias(c)
            for c in rows.columns
        ],
    )
    return cut_lineage(typed)


def link(
    listing: DataFrame, registry: DataFrame, overrides: DataFrame, method: str = "difflib"
) -> DataFrame:
    """The crosswalk, computed once and kept: every later step reads it."""
    def with_zip(df: DataFrame, name: str) -> DataFrame:
        return df if name in df.columns else df.withColumn(name, F.lit(None).cast("string"))

    left, right = linkage.prepare(
        with_zip(listing, "Zip"), with_zip(registry, "zip"),
        listing_columns=("l_id", "Name", "State", "Zip"),
    )
    return cut_lineage(linkage.crosswalk(left, right, overrides, method=method))


def build_records(
    spark: SparkSession,
    paths: SourcePaths,
    registry: DataFrame,
    listing: DataFrame,
    matches: DataFrame,
    profiles: DataFrame,
    as_of: dict[str, str | None],
) -> tuple[DataFrame, DataFrame]:
    """The registry with attached attributes, and the assembled records made from it."""
    attached = asm.attach_attributes(registry, matches, listing)
    places = geocode.gazetteer(readers.load_places(spark, paths.places))
    counties = geocode.county_points(readers.load_counties(spark, paths.counties))
    overrides = readers.load_location_overrides(spark, paths.location_overrides)
    located = geocode.geocode(attached, places, counties, overrides)
    origins = {
        block: {"source": block, "as_of": as_of.get(block)} for block in ("registry", "listing", "events")
    }
    return attached, asm.assemble(asm.attach_profiles(located, profiles), origins)


def profile_stays(
    stays: DataFrame, basis: str = "longest", threshold: int = SUPPRESSION_THRESHOLD
) -> tuple[DataFrame, DataFrame, dict[str, str | None]]:
    """Gated profile tables and their window."""
    stats, cells = profile.windowed_profile(stays, basis, threshold=threshold)
    stats, cells = cut_lineage(stats), cut_lineage(cells)
    checks.enforce({"profiles": checks.check_profiles(stats, cells, threshold=threshold)})
    window = profile.window_metadata(stays, STAY_TIMES[0]).first().asDict()
    return stats, cells, window


def source_files(paths: SourcePaths) -> dict[str, manifest.Source]:
    """All sources as their files lie, with what their publishers say about them."""
    tables = {"registry": (), "stays": STAY_COLUMNS}
    names = ("registry", "stays", "listing", "places", "counties", "key_overrides", "location_overrides", "campaigns")
    return {
        name: manifest.Source(
            getattr(paths, name), "parquet" if name in tables else "text", tables.get(name, ()),
            paths.urls.get(name), paths.published.get(name),
        )
        for name in names
    }


def refresh(
    spark: SparkSession,
    paths: SourcePaths,
    target: str,
    as_of: str,
    force: bool = False,
    floors: RowFloors = RowFloors(),
    method: str = "difflib",
) -> str | None:
    """Rebuild and publish when a source or an input of the build changed; None when there is nothing to do.

    A publication that lost an output is rebuilt too. Linkage and profile gates stop the build before
    anything is written.  The other gates read the staged files, and only if all pass does the
    publication move to the new version, whose ``release`` can be read with ``load_release``.
    """
    pin_utc(spark)
    current = sinks.current_version(spark, target)
    whole = current is not None and sinks.is_whole(spark, target, current)
    known = cut_lineage(sinks.read_published(spark, target, "manifest")) if whole else None
    found = cut_lineage(manifest.file_manifest(
        spark, source_files(paths), known, {"as_of": as_of, "method": method, "threshold": SUPPRESSION_THRESHOLD}
    ))
    if whole and not force:
        if not contract.needs_build(manifest.source_states(known), manifest.source_states(found)):
            return None

    stats, cells, window = profile_stays(load_stays(spark, paths.stays, floors.stays))
    registry = load_registry(spark, paths.registry, floors.registry)
    listing = load_listing(spark, paths.listing, floors.listing)
    overrides = readers.load_key_overrides(spark, paths.key_overrides)
    matches = link(listing, registry, overrides, method)
    checks.enforce({
        "match rate": checks.check_match_rate(matches),
        "collisions": checks.check_collisions(matches),
    })
    profiles = cut_lineage(asm.profile_records(stats, cells, window=window))
    dates = {"registry": as_of, "listing": as_of, "events": window["data_cutoff"]}
    attached, records = build_records(spark, paths, registry, listing, matches, profiles, dates)
    records = cut_lineage(records)
    placed, unplaced = sinks.split_placed(records)
    report = asm.build_report(records, linkage.match_report(matches), linkage.matches_by_method(matches))
    origins = spark.createDataFrame([(name, paths.urls.get(name), date) for name, date in dates.items()],
                                    "source string, url string, as_of string")
    outputs = {
        "features": sinks.feature_lines(placed),
        "unplaced": sinks.feature_lines(unplaced),
        "matches": matches,
        "unmatched": linkage.unmatched_rows(matches),
        "stats": stats,
        "cells": cells,
        "report": report,
        "sources": origins.coalesce(1),
        "window": spark.createDataFrame([window], ", ".join(f"{k} string" for k in window)),
        "manifest": found,
    }
    if paths.campaigns is not None:
        rows = readers.read_contract_csv(spark, paths.campaigns, CAMPAIGN_FIELDS)
        checks.enforce({"campaigns": campaign.check_campaigns(rows, as_of)})
        outputs["feed"] = campaign.campaign_feed(rows, as_of)

    expected = checks.expected_population(attached)
    figures = [c for c in expected.columns if c != "code"]

    def release(staged: dict[str, DataFrame], path: str) -> DataFrame:
        staged["features"].select("value").write.text(path + "/features")
        staged["sources"].agg(F.collect_list(F.struct("source", "url", "as_of")).alias("sources")).write.json(
            path + "/metadata"
        )
        return spark.read.text(path + "/features")

    def shipped(staged: dict[str, DataFrame]) -> DataFrame:
        return staged["release"].unionByName(staged["unplaced"].select("value"))

    gates = {
        "build": lambda staged: checks.check_build(
            checks.shipped_records(staged["release"]), checks.shipped_records(staged["unplaced"]), registry
        ),
        "suppression": lambda staged: checks.check_suppression(shipped(staged)),
        "fidelity": lambda staged: checks.check_fidelity(
            checks.shipped_population(shipped(staged)), expected, figures
        ).unionByName(checks.check_shipped_profiles(shipped(staged), profiles, registry)),
    }
    return sinks.publish(spark, outputs, gates, target, {"release": release})


def cross_checks(
    matches: DataFrame, listing: DataFrame, registry: DataFrame, stats: DataFrame, counties: DataFrame
) -> dict[str, DataFrame]:
    """The report-only comparisons with figures nobody in this pipeline computed."""
    pairs = cut_lineage(checks.population_pairs(matches, listing, registry))
    stay_length = next((c for c in listing.columns if asm.STAY_LENGTH_MARK in c), None)
    results = {
        "population": checks.agreement(pairs),
        "divergent": checks.divergent_ratios(pairs),
        "stale": checks.stale_rows(pairs),
        "outside state": geocode.outside_bounds(
            registry.select("code", "name", "state", "latitude", "longitude"),
            geocode.bounding_boxes(counties),
        ),
        "weak matches": linkage.weak_matches(matches, registry),
        "orphans": asm.orphans(stats, registry),
    }
    if stay_length is not None:
        theirs = listing.select("l_id", F.col(f"`{stay_length}`").alias("theirs"))
        stays = (
            matches.filter(F.col("code").isNotNull()).select("l_id", "code").join(theirs, "l_id")
            .join(stats.select("code", F.col("los_median").alias("ours")), "code")
        )
        results["stay length"] = checks.within_share(stays)
        results["stay length extremes"] = checks.difference_extremes(stays)
    return results
