"""One query per operator on the given tables, each over whole tables and whole texts."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import (
    candidate_places, code_label, display_avg, funding_progress, gated_ratio, haversine_miles,
    normalize_name, place_keys, public_status, rating_class, rating_paint, shared_tokens,
    slug_key, strict_iso_date, suppress, title_case, total_skip_null, total_strict,
    whole_dollars, zip5,
)
from ..functions.text import normalize_tokens
from ..operators import assemble as asm
from ..operators import campaign, checks, frames, geocode, linkage, profile, release, serve, usage
from ..operators.quantiles import group_quantiles
from ..session import by_shuffle, cut_lineage, shared_dir
from ..sources import contract, manifest, readers, sinks
from ..streaming import drain, engagement_stream, ingest_releases, sessions_stream, usage_windows
from . import standins as s

AS_OF = "2026-07-15"
EMAIL = r"[\w.]+@[\w.]+"
CONTRACTS = {"ECONOMY": "Economy line", "PROMO": "Promotional line"}

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def _n(df: DataFrame, column: str = "n") -> DataFrame:
    """A publishable count as scalar columns."""
    return df.select(
        *[c for c in df.columns if c != column],
        F.col(column)["n"].alias("n"), F.col(column)["suppressed"].alias("suppressed"),
        F.col(column)["lt"].alias("lt"),
    )


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --- profiles ---------------------------------------------------------------

def _aged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.derive_stay_columns(s.stays(spark, sf_dir), "book_in", "book_out", "birth_year")


@query
def q_profile_bands(spark, sf_dir):
    """Flagship: window, age bands, one shuffle, suppression, gate input."""
    return _n(profile.band_histogram(_aged(spark, sf_dir), "code", "age_band")).drop("dim")


@query
def q_profile_stats(spark, sf_dir):
    stays = profile.with_known_key(_aged(spark, sf_dir), "code")
    stats = stays.groupBy("code").agg(
        F.count(F.lit(1)).alias("stays_in_window"),
        profile.suppressed_count("age").alias("n"),
        profile.gated_median("age").alias("age_median"),
    )
    return _n(stats)


@query
def q_window_instant(spark, sf_dir):
    events = s.table(spark, sf_dir, "events")
    recent = frames.trailing_window(events, "ts", days=7, align="instant")
    return recent.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("events"), F.min("event_id").alias("first_id"),
        F.max("event_id").alias("last_id"),
    )


@query
def q_profile_top_values(spark, sf_dir):
    stays = s.stays(spark, sf_dir).select("code", "person")
    customers = s.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = s.table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    named = stays.join(customers, F.col("person") == F.col("c_custkey")).join(
        nations, F.col("c_nationkey") == F.col("n_nationkey")
    )
    return _n(profile.top_values(named, "code", "n_name")).drop("dim")


@query
def q_profile_value_counts(spark, sf_dir):
    dims = ["gender", "criminality", "release_reason", "classification"]
    counts = profile.value_counts(s.stays(spark, sf_dir), "code", dims)
    return _n(profile.suppress_counts(counts))


@query
def q_profile_quantiles(spark, sf_dir):
    spread = group_quantiles(
        _aged(spark, sf_dir), ["code"], ["los_days", "amount_set", "amount_posted"], [0.5, 0.9]
    )
    enough = F.col("n") >= 5
    return _n(spread.select(
        "code", "measure", suppress("n").alias("n"),
        F.when(enough, F.bround("q_0", 4)).alias("median"),
        F.when(enough, F.bround("q_1", 4)).alias("p90"),
    ))


@query
def q_profile_two_level(spark, sf_dir):
    stays = s.stays(spark, sf_dir)
    people = profile.person_level_median(stays, "code", "person", "amount_set", digits=4)
    share = profile.person_share(stays, "code", "person", "amount_set")
    both = share.join(people, "code", "left")
    return both.select(
        "code", F.col("unique_people.n").alias("unique_people"),
        F.col("people_with_amount.n").alias("people_with_amount"), "person_median", "share",
    )


@query
def q_distinct_people(spark, sf_dir):
    return profile.distinct_people(s.stays(spark, sf_dir, windowed=False), "code", "person")


@query
def q_value_frequency(spark, sf_dir):
    lines = s.table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity")
    return profile.value_frequency(lines, "l_returnflag", "A", "l_quantity", check=False)


@query
def q_age_bands(spark, sf_dir):
    stays = profile.derive_stay_columns(
        s.stays(spark, sf_dir, windowed=False), "book_in", "book_out", "birth_year"
    )
    return stays.groupBy("age_band").agg(
        F.count(F.lit(1)).alias("events"), F.sum("age").cast("bigint").alias("age_sum"),
        F.sum(F.col("los_days").cast("bigint")).alias("los_sum"),
    )


@query
def q_profile_full(spark, sf_dir):
    """The whole profile as one wide and long result: every cell of both tables by name."""
    stats, cells = _profiles(spark, sf_dir)
    counts = ["age_known", "n_completed", "n_set", "n_posted", "unique_people", "people_with_recorded_set"]
    wide = stats.select(
        "code", F.col("stays_in_window").cast("double").alias("stays_in_window"),
        *[F.col(c)["n"].cast("double").alias(c) for c in counts],
    ).unpivot(["code"], ["stays_in_window", *counts], "value", "n")
    long = cells.select("code", "dim", "value", F.col("n.n").cast("double").alias("n"))
    figures = [
        "age_median", "los_median", "los_p90", "median_set", "median_posted", "person_median_set",
        "person_recorded_set_share",
    ]
    spread = stats.select("code", *[F.col(c).cast("double").alias(c) for c in figures]).unpivot(
        ["code"], figures, "value", "n"
    )
    return wide.unionByName(spread).select(
        "code", F.lit("stats").alias("dim"), "value", "n"
    ).unionByName(long)


def _profiles(spark: SparkSession, sf_dir: str, key: str = "l_suppkey") -> tuple[DataFrame, DataFrame]:
    stays = profile.derive_stay_columns(
        s.stays(spark, sf_dir, key), "book_in", "book_out", "birth_year"
    )
    return profile.profile(
        stays, "code", "person",
        dims={"gender": "gender", "release_reason": "release_reason",
              "book_in_criminality": "criminality", "classification": "classification"},
        top_dims={"top_citizenship": "birth_year"},
        amount_set="amount_set", amount_posted="amount_posted", keep=True,
    )


# --- text -------------------------------------------------------------------

@query
def q_normalize_names(spark, sf_dir):
    rows = s.listing(spark, sf_dir)
    return rows.select(
        "l_id", normalize_name("name").alias("norm"), slug_key("name").alias("slug"),
        zip5("zip").alias("zip5"),
        F.size(shared_tokens(normalize_tokens("name"), F.array(F.lit("CENTER"), F.lit("RING")))).alias("shared"),
    )


@query
def q_generic_tokens(spark, sf_dir):
    return linkage.generic_tokens(s.table(spark, sf_dir, "documents"), "text").select("token", "df")


@query
def q_token_frequency(spark, sf_dir):
    return linkage.token_frequency(s.registry(spark, sf_dir), "name").select("token", "df")


@query
def q_display(spark, sf_dir):
    parts = s.table(spark, sf_dir, "part")
    price = (F.col("p_retailprice") - F.lit(900)) / F.lit(10)
    return parts.select(
        "p_partkey",
        title_case(F.concat("p_name", F.lit("'s us "), F.lower("p_brand"))).alias("title"),
        code_label("p_type", CONTRACTS).alias("label"),
        display_avg(F.when(F.col("p_size") != 7, F.floor(price))).alias("shown_web"),
        display_avg(F.floor(price), style="report").alias("shown_report"),
    )


@query
def q_rating_class(spark, sf_dir):
    docs = s.table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id", rating_class("text").alias("rating_class"), rating_paint("text").alias("rating_paint")
    )


# --- linkage ----------------------------------------------------------------

def _prepared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return linkage.prepare(s.listing(spark, sf_dir), s.registry(spark, sf_dir))


def _matches(spark: SparkSession, sf_dir: str, method: str = "levenshtein") -> DataFrame:
    left, right = _prepared(spark, sf_dir)
    return linkage.crosswalk(left, right, s.key_overrides(spark, sf_dir), method=method)


def _linked(df: DataFrame) -> DataFrame:
    return df.select("l_id", "code", "method", "score")


@query
def q_link_override(spark, sf_dir):
    left, _ = _prepared(spark, sf_dir)
    return _linked(linkage.link_override(left, s.key_overrides(spark, sf_dir)))


@query
def q_link_key_token(spark, sf_dir):
    return _linked(linkage.link_key_token(*_prepared(spark, sf_dir)))


@query
def q_link_strict_winner(spark, sf_dir):
    return _linked(linkage.link_strict_winner(*_prepared(spark, sf_dir)))


@query
def q_link_exact(spark, sf_dir):
    return _linked(linkage.link_exact(*_prepared(spark, sf_dir)))


@query
def q_link_containment(spark, sf_dir):
    return _linked(linkage.link_containment(*_prepared(spark, sf_dir)))


@query
def q_link_levenshtein(spark, sf_dir):
    return _linked(linkage.link_fuzzy(*_prepared(spark, sf_dir), method="levenshtein"))


@query
def q_link_difflib(spark, sf_dir):
    return _linked(linkage.link_fuzzy(*_prepared(spark, sf_dir), method="difflib"))


@query
def q_crosswalk(spark, sf_dir):
    return _matches(spark, sf_dir).select("l_id", "state", "code", "method", "score")


@query
def q_crosswalk_difflib(spark, sf_dir):
    return _matches(spark, sf_dir, "difflib").select("l_id", "state", "code", "method", "score")


@query
def q_match_report(spark, sf_dir):
    matches = _matches(spark, sf_dir)
    report = linkage.match_report(matches).withColumn("rate", F.bround("rate", 6))
    totals = report.select(
        F.explode(F.array(*[
            F.struct(F.lit(c).alias("figure"), F.col(c).cast("double").alias("value"))
            for c in ("total", "matched", "rate")
        ])).alias("r")
    ).select("r.*")
    methods = linkage.matches_by_method(matches).select(
        F.concat(F.lit("method:"), "method").alias("figure"), F.col("n").cast("double").alias("value")
    )
    return totals.unionByName(methods)


@query
def q_unmatched(spark, sf_dir):
    return linkage.unmatched_rows(_matches(spark, sf_dir))


@query
def q_collisions(spark, sf_dir):
    return linkage.collisions(_matches(spark, sf_dir))


@query
def q_weak_matches(spark, sf_dir):
    return linkage.weak_matches(_matches(spark, sf_dir), s.registry(spark, sf_dir))


@query
def q_check_match_rate(spark, sf_dir):
    return checks.check_match_rate(_matches(spark, sf_dir))


# --- geocoding --------------------------------------------------------------

@query
def q_place_keys(spark, sf_dir):
    return frames.explode_rows(s.places(spark, sf_dir), ["row_id"], place_keys("name"), "place", "pos")


@query
def q_candidates(spark, sf_dir):
    found = candidate_places("name", "state")
    return frames.explode_rows(s.entities(spark, sf_dir), ["p_partkey"], found, "place", "pos")


@query
def q_gazetteer(spark, sf_dir):
    return geocode.gazetteer(s.places(spark, sf_dir))


@query
def q_county_points(spark, sf_dir):
    return geocode.county_points(s.counties(spark, sf_dir))


@query
def q_centroids(spark, sf_dir):
    county = geocode.county_points(s.counties(spark, sf_dir))
    return geocode.centroids(county).join(geocode.bounding_boxes(county), "state").withColumns(
        {c: F.bround(c, 9) for c in ("latitude", "longitude")}
    )


def _geocoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geocode.geocode(
        s.entities(spark, sf_dir),
        geocode.gazetteer(s.places(spark, sf_dir)),
        geocode.county_points(s.counties(spark, sf_dir)),
        s.location_overrides(spark, sf_dir),
        key="p_partkey",
    )


@query
def q_geocode(spark, sf_dir):
    from ..functions import geo_uri, location_fields

    rows = _geocoded(spark, sf_dir)
    place = location_fields("latitude", "longitude", "located")
    return rows.select("p_partkey", place.alias("p"), geo_uri("latitude", "longitude").alias("uri")).select(
        "p_partkey", F.bround("p.latitude", 9).alias("latitude"),
        F.bround("p.longitude", 9).alias("longitude"), "p.location_precision",
        "p.location_matched_to", "p.location_note", "p.approx", "p.location_source", "uri",
    )


@query
def q_outside_bounds(spark, sf_dir):
    nations = s.table(spark, sf_dir, "nation")
    customers = s.table(spark, sf_dir, "customer")
    county = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.upper("n_name").alias("state"),
        (F.col("n_nationkey") * 3 - 30 + F.pmod("c_custkey", F.lit(7)) * 0.5).alias("latitude"),
        (F.col("n_nationkey") * 5 - 60 + F.pmod("c_custkey", F.lit(5)) * 0.5).alias("longitude"),
    )
    suppliers = s.table(spark, sf_dir, "supplier").join(
        nations, F.col("s_nationkey") == F.col("n_nationkey")
    ).select(
        "s_suppkey",
        F.when(F.pmod("s_suppkey", F.lit(10)) == 9, "Atlantis").otherwise(F.col("n_name")).alias("state"),
        (F.col("n_nationkey") * 3 - 33 + F.pmod("s_suppkey", F.lit(13))).cast("double").alias("latitude"),
        (F.col("n_nationkey") * 5 - 60).cast("double").alias("longitude"),
    )
    return geocode.outside_bounds(suppliers, geocode.bounding_boxes(county))


# --- releases ---------------------------------------------------------------

def _releases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return s.release_at(spark, sf_dir, later=False), s.release_at(spark, sf_dir, later=True)


@query
def q_release_diff(spark, sf_dir):
    return release.release_diff(*_releases(spark, sf_dir))


@query
def q_release_attributes(spark, sf_dir):
    changes = release.release_diff(*_releases(spark, sf_dir))
    return changes.filter("change_type = 'attributes'").groupBy("field", "detail").agg(
        F.count(F.lit(1)).alias("n")
    )


@query
def q_release_counts(spark, sf_dir):
    before, after = _releases(spark, sf_dir)
    summary = release.release_summary(before, after, release.release_diff(before, after))
    return summary.select("figure", "n")


@query
def q_key_sets(spark, sf_dir):
    return frames.key_sets(*_releases(spark, sf_dir), "code")


# --- agreement --------------------------------------------------------------

def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.population(spark, sf_dir).select(
        "code", "ours", "peak", total_strict("part_a", "part_n", "part_r").alias("theirs")
    )


@query
def q_agreement(spark, sf_dir):
    return checks.agreement(_pairs(spark, sf_dir)).withColumns(
        {c: F.bround(c, 6) for c in ("correlation", "median_ratio")}
    )


def _durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean stay of an entity over all its events, and over those of one kind, kept apart by the source."""
    days = profile.derive_stay_columns(s.stays(spark, sf_dir), "book_in", "book_out", "birth_year")
    return days.groupBy("code").agg(
        F.avg("los_days").alias("ours"), F.avg(F.when(F.col("criminality") == "O", F.col("los_days"))).alias("theirs")
    )


@query
def q_within_share(spark, sf_dir):
    return checks.within_share(_durations(spark, sf_dir), tol=0.1).withColumns(
        {c: F.bround(c, 6) for c in ("correlation", "within_share")}
    )


@query
def q_duration_extremes(spark, sf_dir):
    found = checks.difference_extremes(_durations(spark, sf_dir))
    return found.select("end", "code", F.bround("difference", 6).alias("difference"))


@query
def q_extremes(spark, sf_dir):
    return checks.divergent_ratios(_pairs(spark, sf_dir)).select(
        "end", "code", F.bround("ratio", 9).alias("ratio")
    )


@query
def q_stale(spark, sf_dir):
    return frames.with_place(checks.stale_rows(_pairs(spark, sf_dir))).select(
        "code", "theirs", "peak", F.bround("ratio", 9).alias("ratio"), "place"
    )


@query
def q_totals(spark, sf_dir):
    lines = s.table(spark, sf_dir, "lineitem").select(
        "l_returnflag", "l_linestatus",
        F.when(F.col("l_quantity") > 3, F.col("l_discount")).otherwise(F.lit(float("nan"))).alias("a"),
        F.when(F.col("l_discount") > 0.02, F.col("l_tax")).alias("b"),
        F.col("l_shipdate"),
    )
    clean = frames.clean(lines)
    totals = clean.withColumns({"loose": total_skip_null("a", "b"), "strict": total_strict("a", "b")})
    return totals.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("loose").alias("loose_known"), F.count("strict").alias("strict_known"),
        F.sum(F.col("loose").cast("decimal(18,2)")).cast("double").alias("loose_sum"),
        F.max("l_shipdate").alias("last_day"),
    )


# --- assembled records ------------------------------------------------------

def _attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asm.attach_attributes(
        s.full_registry(spark, sf_dir), s.key_matches(spark, sf_dir), s.full_listing(spark, sf_dir)
    )


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    located = _geocoded(spark, sf_dir).select(F.col("p_partkey").alias("code"), "located")
    stats, cells = _profiles(spark, sf_dir, key="l_partkey")
    registry = _attached(spark, sf_dir).join(by_shuffle(located), "code", "left")
    profiled = asm.attach_profiles(registry, asm.profile_records(stats, cells))
    return asm.assemble(profiled, {"registry": {"source": "parts", "as_of": AS_OF}})


@query
def q_assemble(spark, sf_dir):
    p = F.col("properties")
    population = p["population"]
    return _records(spark, sf_dir).select(
        "code", p["name"].alias("name"), p["adp"].alias("adp"), p["rating"].alias("rating"),
        population["ddp_max_daily_trailing_year"].alias("peak"),
        population["ice_fy_adp_total"].alias("total"),
        population["ddp_figure_stale"].isNotNull().alias("stale"),
        p["classification_adp"]["level_a"].alias("level_a"),
        p["has_ice_attributes"].alias("has_attributes"),
        p["demographics"]["stays_in_window"].alias("stays"),
        p["location_precision"].alias("precision"),
    )


@query
def q_placed_split(spark, sf_dir):
    placed, unplaced = sinks.split_placed(_records(spark, sf_dir))
    return placed.withColumn("placed", F.lit(True)).unionByName(
        unplaced.withColumn("placed", F.lit(False))
    ).groupBy("placed", F.col("properties.state").alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query
def q_build_report(spark, sf_dir):
    matches = s.key_matches(spark, sf_dir).withColumn("method", F.lit("key"))
    report = linkage.match_report(matches)
    by_method = linkage.matches_by_method(matches)
    return asm.build_report(_records(spark, sf_dir), report, by_method)


@query
def q_provenance(spark, sf_dir):
    orders = s.table(spark, sf_dir, "orders")
    newest = orders.select(F.max("o_orderdate").cast("date").alias("d")).scalar()
    return contract.provenance(orders, "orders", url="https://data.example/orders", as_of=newest).select(
        "source", "url", "as_of", "rows"
    )


@query
def q_orphans(spark, sf_dir):
    profiles = s.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("code"))
    shipped = s.table(spark, sf_dir, "customer").filter("c_acctbal >= 0").select(
        F.col("c_custkey").alias("code")
    )
    return asm.orphans(profiles, shipped)


# --- gates ------------------------------------------------------------------

@query
def q_gate_suppression(spark, sf_dir):
    """The gate on unsuppressed records: it must find every small cell, by path."""
    bands = profile.value_counts(_aged(spark, sf_dir), "code", ["age_band"])
    maps = bands.groupBy("code").agg(
        F.map_from_entries(F.collect_list(F.struct("value", "n"))).alias("age_bands")
    )
    demographics = F.struct("age_bands", F.lit(2).alias("stays_in_window"))
    feature = F.struct(F.struct("code", demographics.alias("demographics")).alias("properties"))
    return checks.check_suppression(maps.select(F.to_json(feature).alias("value")))


@query
def q_gate_profiles(spark, sf_dir):
    """The gate on profiles whose suppression threshold was set too low."""
    stays = s.stays(spark, sf_dir, "l_partkey")
    cells = profile.value_counts(stays, "code", ["release_reason"])
    low = profile.suppress_counts(cells, threshold=3)
    stats = stays.groupBy("code").agg(
        suppress(F.count("amount_set"), 3).alias("n_set"),
        (F.max("amount_set") - F.lit(50000)).alias("median_set"),
    )
    return checks.check_profiles(stats, low, counts=["n_set"], medians={"median_set": "n_set"})


@query
def q_gate_build(spark, sf_dir):
    """The gate on records bent in four known ways; half of the doubled codes lie on the unplaced side."""
    parts = s.table(spark, sf_dir, "part")
    way = F.pmod("p_partkey", F.lit(50))
    records = parts.select(
        F.when(way == 1, F.col("p_partkey") - 1).otherwise(F.col("p_partkey")).alias("code"),
        F.when(way == 2, F.lit(95.0)).otherwise(F.lit(10.0)).alias("latitude"),
        F.when(way == 3, F.lit(None)).otherwise(F.lit(20.0)).cast("double").alias("longitude"),
        F.struct(
            F.struct(F.when(way == 4, F.col("p_brand")).alias("company")).alias("operator"),
            F.when(way > 25, 1).otherwise(0).alias("approx"),
            F.when(way > 27, F.lit("near")).alias("location_note"),
        ).alias("properties"),
        way.isin(0, 5).alias("unplaced"),
    )
    return checks.check_build(
        records.filter("not unplaced"), records.filter("unplaced"), s.table(spark, sf_dir, "supplier")
    )


@query
def q_fidelity(spark, sf_dir):
    """Shipped lines against their sources, after a known error in some shipped figures."""
    expected = checks.expected_population(_attached(spark, sf_dir))
    records = asm.assemble(_attached(spark, sf_dir))
    lines = records.select(
        F.to_json(F.struct("properties"), {"ignoreNullFields": "false"}).alias("value")
    )
    shipped = checks.shipped_population(lines).withColumn("code", F.col("code").cast("bigint"))
    bent = shipped.withColumn(
        "ice_fy_adp_total",
        F.when(F.pmod("code", F.lit(10)) == 0, F.col("ice_fy_adp_total") + 1).otherwise(F.col("ice_fy_adp_total")),
    )
    fields = [c for c in shipped.columns if c != "code"]
    return checks.check_fidelity(bent, expected, fields).select("rule", "key")


@query
def q_duplicates(spark, sf_dir):
    return frames.duplicate_keys(s.table(spark, sf_dir, "part"), "p_name").select(
        F.col("duplicates").cast("bigint").alias("duplicates")
    )


# --- campaigns --------------------------------------------------------------

@query
def q_contract_rows(spark, sf_dir):
    return campaign.check_campaigns(s.campaigns(spark, sf_dir), AS_OF, identifier=EMAIL)


@query
def q_campaign_feed(spark, sf_dir):
    rows = s.campaigns(spark, sf_dir).withColumn("public_summary", F.col("short_summary"))
    broken = campaign.check_campaigns(rows, AS_OF, identifier=EMAIL)
    good = rows.join(broken.select("row_id").distinct(), "row_id", "left_anti")
    feed = frames.with_place(campaign.order_feed(campaign.campaign_feed(good, AS_OF)))
    return feed.select(
        "case_id", "region", "bond_amount", "amount_raised", "place",
        F.col("booking_category.label").alias("label"), "verified_on", "contribution_url", "status",
        funding_progress("bond_amount", "amount_raised")["remaining"].alias("remaining"),
        funding_progress("bond_amount", "amount_raised")["percent"].alias("percent"),
    )


@query
def q_status(spark, sf_dir):
    rows = s.campaigns(spark, sf_dir)
    expires = strict_iso_date("verification_expires_on")
    shown = public_status("status", expires, "2026-08-10")
    return rows.groupBy(shown.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query
def q_feed_totals(spark, sf_dir):
    feed = s.campaigns(spark, sf_dir).withColumns(
        {"bond_amount": whole_dollars("bond_amount"), "amount_raised": whole_dollars("amount_raised")}
    )
    return campaign.feed_totals(feed)


# --- serving ----------------------------------------------------------------

def _served(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as published rows with nullable figures and formula points."""
    nations = s.table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    customers = s.table(spark, sf_dir, "customer")
    rating = F.element_at(
        F.array(F.lit("Pass"), F.lit("Fail"), F.lit(None).cast("string"), F.lit("Meets standard")),
        (F.pmod("c_custkey", F.lit(4)) + 1).cast("int"),
    )
    return customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("code"), F.col("c_name").alias("name"),
        F.col("n_name").alias("state"), F.col("c_mktsegment").alias("contract"),
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("adp"),
        rating.alias("rating"),
        F.pmod("c_custkey", F.lit(3)).cast("int").alias("approx"),
        F.when(F.pmod("c_custkey", F.lit(11)) != 0, F.pmod("c_custkey", F.lit(50)) * 0.7 - 20).alias("latitude"),
        (F.pmod("c_custkey", F.lit(70)) * 0.9 - 30).alias("longitude"),
    )


@query
def q_search(spark, sf_dir):
    rows = _served(spark, sf_dir)
    found = serve.filter_registry(
        rows, text=" nation_1 ", rating="Pass", exact_only=True, text_columns=("name", "state", "contract")
    )
    open_rating = serve.filter_registry(rows, contract="BUILDING", rating=serve.NO_RATING)
    return found.select("code", "name", "state", "rating").unionByName(
        open_rating.select("code", "name", "state", "rating")
    )


@query
def q_facets(spark, sf_dir):
    return serve.facets(_served(spark, sf_dir), ["state", "contract", "rating"])


@query
def q_top_n(spark, sf_dir):
    return frames.top_n(_served(spark, sf_dir), "adp", "code").select("code", "adp")


@query
def q_sorted_nulls_last(spark, sf_dir):
    rows = _served(spark, sf_dir)
    ordered = frames.sort_missing_last(rows, "rating", "desc", ["code"])
    return frames.with_place(ordered).select("code", "rating", "place")


@query
def q_histogram(spark, sf_dir):
    return frames.with_place(frames.ranked_histogram(s.table(spark, sf_dir, "orders"), "o_orderpriority"))


@query
def q_distribution(spark, sf_dir):
    counts = profile.value_counts(_served(spark, sf_dir), "state", ["contract", "rating"])
    cells = profile.suppress_counts(counts)
    shares = serve.display_distribution(cells, ["state", "dim"], limit=3)
    return shares.select("state", "dim", "value", "shown", F.bround("share", 6).alias("share"))


@query
def q_grid_rollup(spark, sf_dir):
    return serve.grid_rollup(_served(spark, sf_dir), cell=5.0)


@query
def q_distance(spark, sf_dir):
    rows = _served(spark, sf_dir).filter(F.col("latitude").isNotNull())
    centre = rows.groupBy("state").agg(
        (F.sum(F.col("latitude").cast("decimal(20,6)")) / F.count(F.lit(1))).cast("double").alias("lat0"),
        (F.sum(F.col("longitude").cast("decimal(20,6)")) / F.count(F.lit(1))).cast("double").alias("lon0"),
    )
    near = F.bround(haversine_miles("lat0", "lon0", "latitude", "longitude"), 3)
    return rows.join(centre, "state").select("code", near.alias("miles"))


@query
def q_ratio(spark, sf_dir):
    per = s.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("finished")
    )
    return per.select("o_custkey", gated_ratio("finished", "orders").alias("share"))


# --- ranking helpers --------------------------------------------------------

@query
def q_strict_winner(spark, sf_dir):
    per = s.table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(
        F.count(F.lit(1)).alias("score")
    )
    return frames.strict_winner(per, ["o_custkey"], "score", "o_orderpriority")


@query
def q_first_in_order(spark, sf_dir):
    orders = s.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return frames.first_in_order(orders, ["o_custkey"], "o_orderkey")


@query
def q_union_prefer(spark, sf_dir):
    orders = s.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("code")).agg(
        F.count(F.lit(1)).alias("n")
    )
    customers = s.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("code"), F.lit(0).cast("bigint").alias("n")
    )
    return frames.union_prefer(orders, customers, ["code"])


# --- usage ------------------------------------------------------------------

@query
def q_sessions(spark, sf_dir):
    return usage.sessions(s.usage_events(spark, sf_dir))


@query
def q_sessions_6h(spark, sf_dir):
    return usage.sessions(s.usage_events(spark, sf_dir), gap_minutes=360)


@query
def q_sessionize(spark, sf_dir):
    tagged = usage.sessionize(s.usage_events(spark, sf_dir), gap_minutes=360)
    return tagged.select("event_id", "user_id", "session_no")


@query
def q_engagement(spark, sf_dir):
    tagged = usage.sessionize(s.usage_events(spark, sf_dir), gap_minutes=360)
    return usage.engagement(tagged)


@query
def q_consented(spark, sf_dir):
    kept = usage.only_consented(s.usage_events(spark, sf_dir), s.consents(spark, sf_dir), "user_id")
    return usage.usage(kept)


@query
def q_usage(spark, sf_dir):
    return usage.usage(s.usage_events(spark, sf_dir))


# --- streaming --------------------------------------------------------------

SENTINEL_USER = -1


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, followed by one far later row that closes all windows."""
    events = s.table(spark, sf_dir, "events").select("ts", "user_id", "event_type", "value")
    late = _scratch(spark, "sentinel")
    events.agg((F.max("ts") + timedelta(days=3650)).alias("ts")).select(
        "ts", F.lit(SENTINEL_USER).cast("bigint").alias("user_id"), F.lit("end").alias("event_type"),
        F.lit(None).cast(events.schema["value"].dataType).alias("value"),
    ).write.parquet(late)
    schema = events.schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    closing = spark.readStream.schema(schema).parquet(late)
    return stream.unionByName(closing).withColumn("ts", F.col("ts").cast("timestamp"))


@query
def q_sessions_stream(spark, sf_dir):
    out = drain(
        sessions_stream(_event_stream(spark, sf_dir), "10 minutes"), _scratch(spark, "sessions"), _scratch(spark, "state")
    )
    return out.filter(F.col("user_id") != SENTINEL_USER)


@query
def q_engagement_stream(spark, sf_dir):
    """Streamed sessions with their engagement, numbered within the client once they are written."""
    stream = _event_stream(spark, sf_dir).withColumn("engagement_ms", F.round(F.col("value") * 100, 0).cast("bigint"))
    out = drain(
        engagement_stream(stream, "10 minutes", gap_minutes=360), _scratch(spark, "engaged"), _scratch(spark, "state")
    )
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("start_us")).cast("bigint")
    return out.filter(F.col("user_id") != SENTINEL_USER).select(
        "user_id", number.alias("session_no"), "pings", "engaged_ms", "engaged"
    )


@query
def q_usage_stream(spark, sf_dir):
    consents = s.consents(spark, sf_dir).unionByName(
        spark.range(1).select(F.lit(SENTINEL_USER).cast("bigint").alias("user_id"))
    )
    kept = usage.only_consented(_event_stream(spark, sf_dir), consents, "user_id")
    out = drain(usage_windows(kept, "10 minutes"), _scratch(spark, "usage"), _scratch(spark, "state"))
    return out.filter(F.col("event_type") != "end")


@query
def q_release_stream(spark, sf_dir):
    """The second release arrives in two parts, in two runs; its gate and its changes wait for the whole."""
    arriving, target = _scratch(spark, "arriving"), _scratch(spark, "releases")
    was, now = (
        snapshot.withColumns({"release": F.lit(name), "release_rows": F.lit(snapshot.count()).cast("bigint")})
        for name, snapshot in (("2026-01", s.release_at(spark, sf_dir, False)), ("2026-02", s.release_at(spark, sf_dir, True)))
    )
    gates = {"unique codes": lambda df: df.groupBy("code").count().filter("count > 1")}
    half = F.pmod("code", F.lit(2)) == 0
    for part in (was.unionByName(now.filter(half)), now.filter(~half)):
        part.write.mode("append").parquet(arriving)
        ingest_releases(spark, arriving, target, part.schema, gates=gates, size="release_rows")
    return spark.read.parquet(f"{target}/changes").select("code", "change_type", "detail")


@query
def q_diff_sink(spark, sf_dir):
    path = _scratch(spark, "diff")
    sinks.write_diff(release.release_diff(*_releases(spark, sf_dir)), path)
    return spark.read.json(path).select(F.col("code").cast("bigint").alias("code"), "change_type", "detail")


@query
def q_profile_sink(spark, sf_dir):
    """Counts and bands of all profiles, from the tables that the sink has written."""
    path = _scratch(spark, "profiles")
    sinks.write_profiles(*_profiles(spark, sf_dir), path)
    cells = spark.read.parquet(path + "/cells")
    return cells.filter("dim = 'age_bands'").select("code", "value", F.col("n.n").alias("n"), F.col("n.suppressed").alias("suppressed"), F.col("n.lt").alias("lt"))


@query
def q_feed_sink(spark, sf_dir):
    """The published feed as it lies on disk."""
    path = _scratch(spark, "feed")
    rows = s.campaigns(spark, sf_dir).withColumn("public_summary", F.col("short_summary"))
    broken = campaign.check_campaigns(rows, AS_OF, identifier=EMAIL)
    good = rows.join(broken.select("row_id").distinct(), "row_id", "left_anti")
    sinks.write_feed(campaign.campaign_feed(good, AS_OF), path)
    feed = spark.read.json(path)
    progress = funding_progress("bond_amount", "amount_raised")
    return feed.select(
        "case_id", "region", "bond_amount", "amount_raised", F.col("booking_category.label").alias("label"),
        "verified_on", "contribution_url", "status", progress["remaining"].alias("remaining"),
        progress["percent"].alias("percent"),
    )


@query
def q_event_scan(spark, sf_dir):
    """Orders as an event file with text times: only the named columns, unreadable times as null."""
    path = _scratch(spark, "scan")
    odd = F.pmod("o_orderkey", F.lit(13)) == 0
    s.table(spark, sf_dir, "orders").withColumn(
        "o_orderdate", F.when(odd, F.lit("unknown")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    ).write.parquet(path)
    events = readers.load_events(spark, path, ["o_orderkey", "o_custkey", "o_orderdate"], ["o_orderdate"])
    return events.select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query
def q_registry_scan(spark, sf_dir):
    """Parts as a registry file, some without a key: a key is made from the name."""
    path = _scratch(spark, "registry")
    s.table(spark, sf_dir, "part").select(
        F.when(F.pmod("p_partkey", F.lit(10)) > 0, F.col("p_partkey").cast("string")).alias("code"),
        F.concat("p_name", F.lit(" no. "), F.col("p_partkey").cast("string")).alias("name"),
        F.when(F.pmod("p_partkey", F.lit(7)) == 0, F.lit(float("nan"))).otherwise(F.col("p_retailprice")).alias("adp"),
    ).write.parquet(path)
    return readers.load_registry(spark, path, "code").select("code", "name", "adp")


@query
def q_key_overrides(spark, sf_dir):
    """Human decisions as a text file: lines without a code are ignored, keys are trimmed and upper-cased."""
    path = _scratch(spark, "overrides")
    s.table(spark, sf_dir, "part").select(
        F.concat(F.lit(" "), "p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("ice_name"),
        F.lower("p_brand").alias("state"),
        F.when(F.pmod("p_partkey", F.lit(5)) > 0, F.concat(F.lit("P"), F.col("p_partkey").cast("string")))
        .otherwise("").alias("detention_facility_code"),
    ).write.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path)
    return readers.load_key_overrides(spark, path)


@query
def q_gate_collisions(spark, sf_dir):
    return checks.check_collisions(_matches(spark, sf_dir)).select("rule", "key", "detail")


@query
def q_fidelity_profiles(spark, sf_dir):
    """Shipped profiles against their sources: a tenth is not shipped, another tenth with a wrong figure."""
    stats, cells = _profiles(spark, sf_dir)
    profiles = cut_lineage(asm.profile_records(stats, cells))
    registry = s.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("code")).filter(F.pmod("code", F.lit(7)) > 0)
    shipped = profiles.join(registry, "code", "left_semi").filter(F.pmod("code", F.lit(10)) > 0)
    wrong = F.when(F.pmod("code", F.lit(10)) == 1, 1).otherwise(0)
    bent = shipped.withColumn(
        "demographics", F.col("demographics").withField("stays_in_window", F.col("demographics.stays_in_window") + wrong)
    )
    lines = bent.select(F.to_json(
        F.struct(F.struct("code", "demographics").alias("properties")), {"ignoreNullFields": "false"}
    ).alias("value"))
    return checks.check_shipped_profiles(lines, profiles, registry).select("rule", "key").distinct()


# --- sources ----------------------------------------------------------------

@query
def q_fingerprint(spark, sf_dir):
    names = ("region", "nation", "customer", "orders")
    return contract.fingerprint_table({n: s.table(spark, sf_dir, n) for n in names}, "md5")


@query
def q_changed_sources(spark, sf_dir):
    """Two file manifests: a file that went, one that came, one with other rows, and one each with another
    address and another publication date; two inputs of the build, one of them changed."""
    def source(name: str, **said: str) -> manifest.Source:
        return manifest.Source(f"{sf_dir}/{name}.parquet", "parquet", **said)

    moved = _scratch(spark, "supplier")
    s.table(spark, sf_dir, "supplier").withColumn("s_acctbal", F.col("s_acctbal") + 1).write.parquet(moved)
    old = {n: source(n) for n in ("region", "nation", "supplier")}
    old |= {"customer": source("customer", url="https://data.example/1"), "part": source("part", published="2026-07-01")}
    new = {"nation": source("nation"), "orders": source("orders"), "supplier": manifest.Source(moved, "parquet")}
    new |= {"customer": source("customer", url="https://data.example/2"), "part": source("part", published="2026-08-01")}
    before = cut_lineage(manifest.file_manifest(spark, old, None, {"as_of": "2026-07-01", "method": "difflib"}))
    after = manifest.file_manifest(spark, new, before, {"as_of": AS_OF, "method": "difflib"})
    return contract.changed_sources(manifest.source_states(before), manifest.source_states(after))


@query
def q_located_header(spark, sf_dir):
    """Parts written as text files with title lines above the header, and read back."""
    path = _scratch(spark, "titled")
    rows = s.table(spark, sf_dir, "part").select(
        F.to_csv(F.struct("p_partkey", "p_name", "p_brand", F.col("p_size").cast("string"))).alias("value")
    )
    titles = ["Parts of the fiscal year", "", "revised, see notes", "Key,Name,Address ,Size"]

    def with_titles(batches):
        import pandas as pd

        yield pd.DataFrame({"value": titles})
        yield from batches

    rows.mapInPandas(with_titles, "value string").write.text(path)
    table = readers.read_located_header(spark, path, ["name", "address"])
    return table.select(
        F.col("Key").cast("bigint").alias("p_partkey"), F.col("Name").alias("p_name"),
        F.col("Address").alias("p_brand"), F.col("Size").cast("int").alias("p_size"),
    )


@query
def q_newest_release(spark, sf_dir):
    """File names made from all order dates, some without a readable date."""
    day = F.date_format("o_orderdate", "MMddyyyy")
    stamp = F.when(F.pmod("o_orderkey", F.lit(7)) == 0, F.lit("99992030")).otherwise(day)
    files = s.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("FY_detail"), stamp, F.lit(".xlsx")).alias("file_name")
    ).distinct()
    return readers.newest_release(files).select(
        "file_name", F.col("release_date").cast("string").alias("release_date")
    )


@query
def q_release_features(spark, sf_dir):
    """Records written as feature lines and read back as a flat release."""
    path = _scratch(spark, "release")
    sources = contract.provenance(s.table(spark, sf_dir, "part"), "parts", as_of=AS_OF)
    placed, _ = sinks.split_placed(_records(spark, sf_dir))
    sinks.write_features(placed, path, sources)
    return readers.load_release(spark, path).select(
        F.col("code").cast("bigint").alias("code"), "name", "state", "adp", "last_rating", "as_of"
    )
